"""Closed-form statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def wilson(hits: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Wilson interval of a share; null for no trials."""
    p = hits / n
    mid = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return F.when(n > 0, mid - half), F.when(n > 0, mid + half)


def kappa(df: DataFrame, a: str, b: str) -> DataFrame:
    """Cohen's kappa of two ratings of the same rows; 1 where both are one class throughout."""
    cells = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count("*").alias("n"))
    n = cells.agg(F.sum("n").alias("total"), F.sum(F.when(F.col(a) == F.col(b), F.col("n")).otherwise(0)).alias("same"))
    left = cells.groupBy(F.col(a).alias("k")).agg(F.sum("n").alias("na"))
    right = cells.groupBy(F.col(b).alias("k")).agg(F.sum("n").alias("nb"))
    chance = left.join(right, "k").agg(F.coalesce(F.sum(F.col("na") * F.col("nb")), F.lit(0)).alias("chance"))
    po, pe = F.col("same") / F.col("total"), F.col("chance") / (F.col("total") * F.col("total"))
    return n.crossJoin(F.broadcast(chance)).select(F.round(F.when(pe == 1, 1.0).otherwise((po - pe) / (1 - pe)), 6).alias("kappa"))  # one row each


def running(df: DataFrame, order: list[str], amount: Column) -> DataFrame:
    """``df`` with ``before``, the sum of ``amount`` over all rows that stand before by ``order``, and ``whole``, over all rows.

    Rows are dealt into ranges of the order, written once, summed range by
    range and moved by what the ranges before hold, so that no task sees all
    rows. ``order`` should be unique.
    """
    from ..operators.graph import _saved

    ranged = _saved(df.withColumn("__n", amount).repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    own = F.sum("__n").over(Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    sizes = [tuple(r) for r in ranged.groupBy("__part").agg(F.sum("__n")).orderBy("__part").collect()]  # a row a range
    total, rows = 0, []
    for part, n in sizes:
        rows.append((part, total))
        total += n
    offsets = df.sparkSession.createDataFrame(rows, "__part int, __offset long")
    out = ranged.withColumn("before", F.coalesce(own, F.lit(0))).join(F.broadcast(offsets), "__part")
    return out.select(*df.columns, (F.col("before") + F.col("__offset")).alias("before"), F.lit(total).alias("whole"))


def ntile(df: DataFrame, order: list[str], n: int, name: str) -> DataFrame:
    """``df`` with the number, 1 to ``n``, of each row's share of the order; the first shares take what is over."""
    small, extra = F.floor(F.col("whole") / n), F.col("whole") % n
    head = extra * (small + 1)
    tier = F.when(F.col("before") < head, F.floor(F.col("before") / (small + 1))).otherwise(extra + F.floor((F.col("before") - head) / F.greatest(small, F.lit(1)))) + 1
    return running(df, order, F.lit(1)).withColumn(name, tier.cast("int")).drop("before", "whole")


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """Rank correlation with averaged ties, of rows that have both. Ranks come from counts of distinct values, dealt into ranges."""
    both = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(a, b)

    def ranked(c: str) -> DataFrame:
        counts = both.groupBy(c).agg(F.count("*").alias("n"))
        return running(counts, [c], F.col("n")).select(c, (F.col("before") + (F.col("n") + 1) / 2).alias(f"r_{c}"))

    placed = both.join(ranked(a), a).join(ranked(b), b)
    return placed.agg(F.round(F.corr(f"r_{a}", f"r_{b}"), 6).alias("spearman"))


def ranking(hits: DataFrame, query: str, rank: str, relevant: str, total: str, k: int) -> DataFrame:
    """(query, precision, recall, rr, ndcg) at ``k`` of hits with a rank and a 0 / 1 relevance; ``total`` is how many are relevant at all."""
    gain = F.col(relevant) / F.log2(F.col(rank) + 1)
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.least(F.col("__t"), F.lit(k)).cast("int"), F.lit(1))), F.lit(0.0), lambda x, i: x + 1 / F.log2(i + 1))
    g = hits.groupBy(query).agg(F.sum(relevant).alias("__s"), F.max(F.coalesce(total, F.lit(0))).alias("__t"), F.max(F.col(relevant) / F.col(rank)).alias("rr"), F.sum(gain).alias("__g"))
    return g.select(query, F.round(F.col("__s") / k, 6).alias(f"precision_{k}"), F.round(F.when(F.col("__t") > 0, F.col("__s") / F.col("__t")).otherwise(0.0), 6).alias(f"recall_{k}"), F.round("rr", 6).alias("rr"), F.round(F.when(F.col("__t") > 0, F.col("__g") / ideal).otherwise(0.0), 6).alias("ndcg"))


def entropy_terms(df: DataFrame, a: str, b: str) -> DataFrame:
    """Normalised mutual information of two labelings, 2 I / (Ha + Hb), natural logs; 1 where both entropies are 0."""
    cells = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count("*").alias("n"))
    total = cells.agg(F.sum("n").alias("t"))
    ca = cells.groupBy(a).agg(F.sum("n").alias("na"))
    cb = cells.groupBy(b).agg(F.sum("n").alias("nb"))
    j = cells.join(ca, a).join(cb, b).crossJoin(F.broadcast(total))  # one row
    mi = j.agg(F.sum(F.col("n") / F.col("t") * F.log(F.col("n") * F.col("t") / (F.col("na") * F.col("nb")))).alias("mi"))
    h = [c.crossJoin(F.broadcast(total)).agg((-F.sum(F.col(n) / F.col("t") * F.log(F.col(n) / F.col("t")))).alias(o)) for c, n, o in ((ca, "na", "ha"), (cb, "nb", "hb"))]
    one = mi.crossJoin(h[0]).crossJoin(h[1])
    return one.select(F.round(F.when(F.col("ha") + F.col("hb") == 0, 1.0).otherwise(2 * F.col("mi") / (F.col("ha") + F.col("hb"))), 6).alias("nmi"))


def weighted_kappa(df: DataFrame, a: str, b: str) -> DataFrame:
    """Kappa with quadratic weights of two integer ratings; 1 where no disagreement can be expected."""
    own = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b"))
    # The expected square of a difference follows from the ratings' moments: no pairs are formed.
    m = own.agg(F.count("*").alias("n"), F.sum((F.col("a") - F.col("b")) * (F.col("a") - F.col("b"))).alias("o"), F.sum("a").alias("sa"), F.sum("b").alias("sb"), F.sum(F.col("a") * F.col("a")).alias("qa"), F.sum(F.col("b") * F.col("b")).alias("qb"))
    expected = F.col("qa") + F.col("qb") - 2 * F.col("sa") * F.col("sb") / F.col("n")
    return m.select(F.round(F.when(expected == 0, 1.0).otherwise(1 - F.col("o") / expected), 6).alias("weighted_kappa"))


def divergence(rows: DataFrame, gate: float) -> DataFrame:
    """Of (q, id, a, b), whether two lanes answer query q with id: queries, mean and 90th percentile of 1 - Jaccard, and whether the latter passes."""
    each = rows.groupBy("q", "id").agg(F.max("a").alias("a"), F.max("b").alias("b"))
    j = each.groupBy("q").agg(F.count_if(F.col("a") & F.col("b")).alias("both"), F.count_if(F.col("a") | F.col("b")).alias("any")).where("any > 0")
    d = j.select((1 - F.col("both") / F.col("any")).alias("d"))
    out = d.agg(F.count("*").alias("queries"), F.round(F.avg("d"), 6).alias("mean_divergence"), F.round(F.expr("percentile(d, 0.9)"), 6).alias("p90"))
    return out.withColumn("passed", F.col("p90") <= gate)
