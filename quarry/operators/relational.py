"""Filters, facets, overlaps, windows and unions over papers and links."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def paper_filter(df: DataFrame, year: str | None = None, year_min=None, year_max=None, equals: dict | None = None, contains: dict | None = None, ilike: dict | None = None) -> DataFrame:
    """Rows that pass all given conditions: a year range, equalities, array containment, case-blind substrings."""
    if year_min is not None:
        df = df.where(F.col(year) >= year_min)
    if year_max is not None:
        df = df.where(F.col(year) <= year_max)
    for c, v in (equals or {}).items():
        df = df.where(F.col(c) == v)
    for c, v in (contains or {}).items():
        df = df.where(F.array_contains(c, v))
    for c, v in (ilike or {}).items():
        df = df.where(F.col(c).ilike(f"%{v}%"))
    return df


def facet(df: DataFrame, value: str | Column, limit: int, name: str = "value") -> DataFrame:
    """Counts by value, most first, ties by value; nulls are left out."""
    value = F.col(value) if isinstance(value, str) else value
    counts = df.select(value.alias(name)).where(F.col(name).isNotNull()).groupBy(name).agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), F.asc(name)).limit(limit)


def neighbours(edges: DataFrame, papers: DataFrame, at, start: str, end: str, key: str, rank: str, limit: int) -> DataFrame:
    """Papers at the other end of a paper's links, by ``rank`` descending with nulls last, then key. Ends without a paper drop out."""
    found = edges.where(F.col(start) == at).select(F.col(end).alias(key)).distinct().join(papers, key)
    return found.orderBy(F.desc_nulls_last(rank), F.asc(key)).limit(limit)


def overlap(edges: DataFrame, at, shared: str, other: str, minimum: int, limit: int) -> DataFrame:
    """What shares most ``shared`` ends with ``at``: co-citation by sources, coupling by targets.

    Only the links of ``at`` are joined back, so the join's size is that of
    its second neighbourhood, not of all pairs.
    """
    own = edges.where(F.col(other) == at).select(shared).distinct()
    counts = edges.join(own, shared, "left_semi").where(F.col(other) != at).groupBy(other).agg(F.count_distinct(shared).alias("n_shared"))
    return counts.where(F.col("n_shared") >= minimum).orderBy(F.desc("n_shared"), F.asc(other)).limit(limit)


def top_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int, rank: str = "rn") -> DataFrame:
    """The first ``k`` rows of each group; ``order`` must be total. Spark prunes each group before the shuffle."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col(rank) <= k)


def edge_diff(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Full outer union of two link sets, with in_a and in_b."""
    left, right = a.select(*keys).distinct().withColumn("in_a", F.lit(True)), b.select(*keys).distinct().withColumn("in_b", F.lit(True))
    return left.join(right, list(keys), "full").fillna(False, ["in_a", "in_b"])


def noisy_or(links: DataFrame, keys: Sequence[str], confidence: str, weight: Column) -> DataFrame:
    """1 - product of (1 - confidence * weight) by key, each factor held to 0.999999; a null confidence counts as 0. Six places, halves up."""
    p = F.least(F.greatest(F.coalesce(F.col(confidence), F.lit(0.0)) * weight, F.lit(0.0)), F.lit(0.999999))
    return links.groupBy(*keys).agg(F.round(1 + 1e-9 - F.exp(F.sum(F.log(1 - p))), 6).alias("fused"), F.count("*").alias("link_count"))


def dense_counts(counts: DataFrame, group: str, year: str, first: int, last: int) -> DataFrame:
    """Counts ``n`` of every group in every year from ``first`` to ``last``, zero where there were none."""
    every = counts.select(group).distinct().withColumn(year, F.explode(F.sequence(F.lit(first), F.lit(last))))
    return every.join(counts, [group, year], "left").fillna(0, ["n"])


def drawn(df: DataFrame, group: Sequence[str], key: str, k: int) -> DataFrame:
    """``k`` rows of each group, drawn by the digest of their key: the same ones in every session."""
    return top_per_group(df, group, [F.md5(F.col(key).cast("string")).asc(), F.asc(key)], k)
