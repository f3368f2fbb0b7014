"""Queries that run as streams to their end and must equal the batch."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import jobs
from .base import Registry

query = Registry()
QUERIES, ORACLE_SQL = query.queries, query.sql


@query("SELECT CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS start_s, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_windows(t):
    schema = t.events.schema
    stream = t.spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(_watched(t))
    got = jobs.run_once(jobs.windows(stream), ["start", "event_type"])
    return got.select(F.unix_timestamp("start").alias("start_s"), "event_type", "n", F.round("total", 4).alias("total"))


def _watched(t) -> str:
    """A streaming source takes a folder: the table's own, or for a one-file table a pattern that holds it alone."""
    return f"{t.sf_dir}/events.parque[t]"
