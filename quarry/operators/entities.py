"""Entity linking, resolution and curation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .retrieval import tokens


def resolve(mentions: DataFrame, names: DataFrame) -> DataFrame:
    """(mention, entity, score): canonical names score 1, aliases 0.9 where no canonical name matches; case-blind.

    ``names``: (entity, name, kind) with kind ``canonical`` or ``alias``.
    """
    m = mentions.select(F.lower("mention").alias("key"), "mention").distinct()
    n = names.select(F.lower("name").alias("key"), "entity", "kind").distinct()
    hit = m.join(n, "key")
    exact = hit.where("kind = 'canonical'").select("mention", "entity", F.lit(1.0).alias("score"))
    rest = hit.where("kind = 'alias'").join(exact.select("mention").distinct(), "mention", "left_anti").select("mention", "entity", F.lit(0.9).alias("score"))
    return exact.union(rest).groupBy("mention", "entity").agg(F.max("score").alias("score"))


def keyword_links(docs: DataFrame, id_col: str, keywords: str, names: DataFrame) -> DataFrame:
    """(id, entity, match_source) of keywords equal to names; of several sources the first in the alphabet."""
    words = docs.select(id_col, F.explode(F.transform(keywords, F.lower)).alias("key")).distinct()
    hit = words.join(names.select(F.lower("name").alias("key"), "entity", "kind"), "key")
    return hit.groupBy(id_col, "entity").agg(F.min("kind").alias("match_source"))


def ngrams(df: DataFrame, id_col: str, text: str, longest: int = 4) -> DataFrame:
    """(id, gram) of all runs of one to ``longest`` tokens."""
    t = df.select(id_col, tokens(text).alias("t"))
    every = F.flatten(F.array(*[_runs(n) for n in range(1, longest + 1)]))
    return t.select(id_col, F.explode(every).alias("gram"))


def _runs(n: int):
    at = F.when(F.size("t") >= n, F.sequence(F.lit(1), F.size("t") - (n - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.array_join(F.slice(F.col("t"), i, F.lit(n)), " "))
