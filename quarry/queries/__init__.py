"""Queries of the library's operators by name, and their DuckDB SQL."""

from . import corpus, extraction, links, mentions, provenance, reviews, search, sources, streams

QUERIES = {**links.QUERIES, **corpus.QUERIES, **reviews.QUERIES, **streams.QUERIES, **sources.QUERIES, **search.QUERIES, **provenance.QUERIES, **extraction.QUERIES, **mentions.QUERIES}
ORACLE_SQL = {**links.ORACLE_SQL, **corpus.ORACLE_SQL, **reviews.ORACLE_SQL, **streams.ORACLE_SQL, **sources.ORACLE_SQL, **search.ORACLE_SQL, **provenance.ORACLE_SQL, **extraction.ORACLE_SQL, **mentions.ORACLE_SQL}
