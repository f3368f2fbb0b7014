"""Reviews of a claim's citations, working sets, loads and ledgers."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Cues of hedging, of each relation, and the weights of a citation's intent.
HEDGES = ["may", "might", "could", "suggests", "suggesting", "appears", "appear", "preliminary", "tentative", "tentatively", "possibly", "perhaps", "likely", "unclear", "seem", "seems"]
AGREES = ["agrees with", "consistent with", "confirm", "reproduce", "replicate", "in agreement with"]
REFUTES = ["contradicts", "disagrees with", "inconsistent with", "refutes", "refuted", "rules out", "excludes", "in tension with"]
QUALIFIES = ["extends", "qualifies", "narrows", "clarifies", "revises", "supersedes"]
PARTIAL = ["partially", "mixed", "in part", "qualified support"]
INTENT_WEIGHTS = {"result_comparison": 1.0, "method": 0.6, "background": 0.3}
OTHER_WEIGHT = 0.3


def hedged(text: Column) -> Column:
    """Whether one of a text's words is a hedge; a null text has none."""
    return F.coalesce(F.arrays_overlap(F.split(F.lower(text), "[^a-z]+"), F.array(*map(F.lit, HEDGES))), F.lit(False))


def relation(text: Column) -> Column:
    """How a citing text stands to what it cites: partial, refutes, qualifies, replicates or unknown; agreement with a hedge qualifies."""
    low = F.lower(F.coalesce(text, F.lit("")))

    def holds(cues: list[str]) -> Column:
        return reduce(lambda a, b: a | b, (low.contains(c) for c in cues))

    agrees = F.when(hedged(text), "qualifies").otherwise("replicates")
    return F.when(holds(PARTIAL), "partial").when(holds(REFUTES), "refutes").when(holds(QUALIFIES), "qualifies").when(holds(AGREES), agrees).otherwise("unknown")


def intent_weight(intent: Column) -> Column:
    return reduce(lambda c, kv: c.when(intent == kv[0], kv[1]), list(INTENT_WEIGHTS.items())[1:], F.when(intent == "result_comparison", INTENT_WEIGHTS["result_comparison"])).otherwise(OTHER_WEIGHT)


def replications(contexts: DataFrame, target, cited: str, text: str, intent: str, year: str, key: Sequence[str], limit: int, only: str | None = None) -> DataFrame:
    """What cites ``target``, weightiest intent first, then earliest (years that are null last), then ``key``; ``only`` keeps one relation of the limited rows."""
    own = contexts.where(F.col(cited) == target).withColumn("intent_weight", intent_weight(F.col(intent)))
    own = own.orderBy(F.desc("intent_weight"), F.asc_nulls_last(year), *key).limit(limit)
    judged = own.withColumn("relation", relation(F.col(text))).withColumn("hedged", hedged(F.col(text)))
    return judged if only is None else judged.where(F.col("relation") == only)


def working_set(edges: DataFrame, seeds: list) -> DataFrame:
    """Distinct nodes one link away from the seeds, either way, with the seeds."""
    out = edges.where(F.col("src").isin(seeds)).select(F.col("dst").alias("node"))
    into = edges.where(F.col("dst").isin(seeds)).select(F.col("src").alias("node"))
    own = edges.sparkSession.createDataFrame([(s,) for s in seeds], f"node {edges.schema['src'].dataType.simpleString()}")
    return out.union(into).union(own).distinct()


def fresh_rows(incoming: DataFrame, held: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row for each new key, the first by ``order``; keys that ``held`` has, null among them, are left out, so a repeated load adds nothing."""
    had = held.select(*[F.col(k).alias(f"__had_{k}") for k in key]).distinct()
    new = incoming.join(had, reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"__had_{k}")) for k in key)), "left_anti")
    return new.withColumn("__rn", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("__rn = 1").drop("__rn")


def gaps(expected: DataFrame, held: DataFrame, key: str) -> DataFrame:
    """Keys, null among them, whose counts differ: (key, expected, held, missing)."""
    both = expected.select(key, F.lit(1).alias("e"), F.lit(0).alias("h")).union(held.select(key, F.lit(0), F.lit(1)))
    counts = both.groupBy(key).agg(F.sum("e").alias("expected"), F.sum("h").alias("held"))
    return counts.withColumn("missing", F.col("expected") - F.col("held")).where("missing <> 0")


def inverted_index(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id, index): a map of each word of a text (cut at single spaces) to its places. Ids must be unique; a null text has no row."""
    words = df.where(F.col(text).isNotNull()).select(id_col, F.posexplode(F.split(text, " ")).alias("p", "w"))
    placed = words.groupBy(id_col, "w").agg(F.sort_array(F.collect_list("p")).alias("at"))
    return placed.groupBy(id_col).agg(F.map_from_entries(F.collect_list(F.struct("w", "at"))).alias("index"))


def from_inverted_index(index: Column) -> Column:
    """The text of a map of words to places, words in order of place joined by spaces."""
    placed = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.array_join(F.transform(F.array_sort(placed), lambda x: x["w"]), " ")


def corrections(events: DataFrame, key: str, kind: str, when: str, retraction: str) -> DataFrame:
    """Of each key: its distinct corrections counted, and the date of the earliest retraction, or null."""
    own = events.select(key, kind, F.to_date(when).alias("day")).distinct()
    return own.groupBy(key).agg(F.count("*").alias("n_corrections"), F.min(F.when(F.col(kind) == retraction, F.col("day"))).alias("retracted_at"))


def freshness(runs: DataFrame, source: str, status: str, when: str, done: str, now: Column, hours: int = 24) -> DataFrame:
    """Of each source: its last run's status, and whether its last completed run is longer ago than ``hours`` or was never."""
    last = runs.groupBy(source).agg(F.max_by(status, when).alias("last_status"), F.max(F.when(F.col(status) == done, F.col(when))).alias("completed"))
    return last.withColumn("stale", F.coalesce(F.col("completed") + F.make_dt_interval(hours=F.lit(hours)) < now, F.lit(True)))


def ledger(costs: DataFrame, day: Column, order: Sequence[str], cost: str, cap: float) -> DataFrame:
    """Each cost with what its day has spent so far, itself included, and whether that is within ``cap``."""
    spent = F.sum(cost).over(Window.partitionBy("day").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return costs.withColumn("day", day).withColumn("spent", spent).withColumn("within", F.col("spent") <= cap)
