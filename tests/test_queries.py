"""Every query against its SQL in DuckDB, over whole tables."""

import decimal

import duckdb
import pytest

from quarry.queries import ORACLE_SQL, QUERIES

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def value(v):
        return f"{float(v):.6f}" if isinstance(v, (float, decimal.Decimal)) else str(v)

    return sorted(columns), sorted(tuple(value(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, name):
    df = QUERIES[name](spark, DIR)
    rows = [tuple(r) for r in df.collect()]
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DIR}/{t}.parquet')")
    found = con.execute(ORACLE_SQL[name])
    assert plain(rows, df.columns) == plain(found.fetchall(), [c[0] for c in found.description])


def test_graph_queries_run_over_the_whole_graph(spark):
    from collections import Counter

    from quarry.queries.base import Tables

    edges = [tuple(r) for r in Tables(spark, DIR).graph().collect()]
    least = {n: n for e in edges for n in e}
    moved = True
    while moved:
        moved = False
        for a, b in edges:
            m = min(least[a], least[b])
            moved |= m != least[a] or m != least[b]
            least[a] = least[b] = m
    got = {r.node: r.component for r in QUERIES["graph_components"](spark, DIR).collect()}
    assert got == least and max(Counter(got.values()).values()) > 2
    assert {"pagerank_10", "ppr_10", "hits_10"} <= set(QUERIES)


def test_queries_without_sql_are_few():
    assert set(QUERIES) - set(ORACLE_SQL) == {"louvain_communities", "resolution_sweep", "semantic_communities", "vec_lsh"}
