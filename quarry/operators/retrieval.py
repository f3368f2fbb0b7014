"""Lexical and vector ranking, fusion and snippets."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def tokens(text: str | Column) -> Column:
    """Lower-cased runs of ASCII letters and digits."""
    text = F.col(text) if isinstance(text, str) else text
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda x: x != "")


def cosine(vector: str | Column, query: list[float]) -> Column:
    """Cosine with a fixed vector; null where either is zero."""
    v = F.transform(vector, lambda x: x.cast("double"))
    norm = sum(x * x for x in query) ** 0.5
    q = F.array(*[F.lit(float(x)) for x in query])
    dot = F.aggregate(F.zip_with(v, q, lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    own = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    return F.when((own > 0) & F.lit(norm > 0), dot / (own * F.lit(norm)))


def nearest_centroid(df: DataFrame, id_col: str, vector: str, centroids: DataFrame, name: str) -> DataFrame:
    """(id, name) of the nearest centroid (name, c) by cosine, ties by name; a null or zero vector has none. Centroids, one a community, are broadcast as one array."""
    def norm(v):
        return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))

    packed = centroids.agg(F.sort_array(F.collect_list(F.struct(name, "c"))).alias("__all"))
    own = df.select(id_col, F.col(vector).alias("__v")).crossJoin(F.broadcast(packed)).where(norm(F.col("__v")) > 0)
    scored = F.transform("__all", lambda z: F.struct((-F.round(F.aggregate(F.zip_with("__v", z["c"], lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x) / (norm(F.col("__v")) * norm(z["c"])), 9)).alias("d"), z[name].alias(name)))
    return own.select(id_col, F.array_min(scored)[name].alias(name))


def vector_search(df: DataFrame, id_col: str, vector: str, query: list[float], k: int, where: Column | None = None) -> DataFrame:
    """The ``k`` nearest by cosine, ties by id. A filter given as ``where`` is applied before any vector is read."""
    df = df if where is None else df.where(where)
    return df.select(id_col, F.round(cosine(vector, query), 6).alias("score")).where("score is not null").orderBy(F.desc("score"), F.asc(id_col)).limit(k)


def nearest_in_blocks(df: DataFrame, queries: DataFrame, id_col: str, vector: str, k: int, block: int = 1024) -> DataFrame:
    """(q, id, score, rk): the ``k`` nearest rows of each query by cosine to six places, ties by id, the query itself left out.

    Queries are taken in blocks of their ids' order, each block broadcast and
    compared with all rows; a task keeps ``k`` rows a query. Ids must be unique
    among queries; zero and null vectors are near nothing.
    """
    kind, made, after = df.schema[id_col].dataType.simpleString(), None, None

    def against(held: list) -> DataFrame:
        ids = np.array([r[0] for r in held])
        q = np.array([r[1] for r in held], np.float64)
        q /= np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)
        shared = df.sparkSession.sparkContext.broadcast((ids, q))

        def run(batches):
            ids, q = shared.value
            for batch in batches:
                own = batch.column(0).to_numpy(zero_copy_only=False)
                v = np.array(batch.column(1).to_pylist(), np.float64)
                norm = np.linalg.norm(v, axis=1) if len(v) else np.zeros(0)
                own, v = own[norm > 0], v[norm > 0] / norm[norm > 0][:, None]
                rows: list = []
                s = np.round(q @ v.T, 6) if len(v) else np.zeros((len(q), 0))
                for i, line in zip(ids, s):
                    order = np.lexsort((own, -line))
                    order = order[own[order] != i][:k]
                    rows += zip([i] * len(order), own[order], line[order])
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(list(x)) for x in zip(*rows)], names=["q", id_col, "score"])

        return df.where(F.col(vector).isNotNull()).select(id_col, vector).mapInArrow(run, f"q {kind}, `{id_col}` {kind}, score double")

    while True:
        page = queries.where(F.col(vector).isNotNull()) if after is None else queries.where(F.col(vector).isNotNull() & (F.col(id_col) > after))
        held = [r for r in page.select(id_col, F.transform(vector, lambda x: x.cast("double"))).orderBy(id_col).limit(block).collect()]
        if not held:
            break
        part, after = against(held), held[-1][0]
        made = part if made is None else made.union(part)
        if len(held) < block:
            break
    if made is None:
        made = df.sparkSession.createDataFrame([], f"q {kind}, `{id_col}` {kind}, score double")
    w = Window.partitionBy("q").orderBy(F.desc("score"), F.asc(id_col))
    return made.withColumn("rk", F.row_number().over(w)).where(F.col("rk") <= k)


def section_score(text: str, terms: list[str]) -> Column:
    """Whole-word hits of terms of two letters or more, by length plus 50."""
    terms = [t.lower() for t in terms if len(t) >= 2]
    pattern = r"\b(?:" + "|".join(map(re.escape, terms)) + r")\b"
    return F.regexp_count(F.lower(F.col(text)), F.lit(pattern)) / (F.length(text) + 50)


def match_all(df: DataFrame, id_col: str, text: str, terms: list[str], k: int) -> DataFrame:
    """Texts that hold every term, by section score, ties by id."""
    found = df.withColumn("__w", tokens(text)).where(F.size(F.array_except(F.array(*map(F.lit, terms)), "__w")) == 0)
    return found.select(id_col, F.round(section_score(text, terms), 6).alias("score")).orderBy(F.desc("score"), F.asc(id_col)).limit(k)


def rrf(lanes: list[DataFrame], id_col: str, score: str, k: int = 60, top: int = 20) -> DataFrame:
    """Reciprocal rank fusion: the sum of 1 / (k + rank) over the lanes; lanes are short ranked lists."""
    ranked = []
    for lane in lanes:
        rank = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc(score), F.asc(id_col)))
        ranked.append(lane.select(id_col, (1.0 / (k + rank)).alias("part")))
    both = ranked[0]
    for r in ranked[1:]:
        both = both.unionByName(r)
    return both.groupBy(id_col).agg(F.round(F.sum("part"), 6).alias("rrf")).orderBy(F.desc("rrf"), F.asc(id_col)).limit(top)


def snippet(text: str, term: str, around: int = 150) -> Column:
    """``around`` characters on both sides of the first hit, or the text's start."""
    at = F.instr(F.lower(F.col(text)), term.lower())
    return F.when(at > 0, F.substring(F.col(text), F.greatest(at - around, F.lit(1)), F.lit(2 * around + len(term)))).otherwise(F.substring(F.col(text), F.lit(1), F.lit(2 * around)))


def chunks(df: DataFrame, id_col: str, text: str, window: int = 512, lap: int = 64) -> DataFrame:
    """(id, chunk, n) of windows of tokens that overlap by ``lap``; a tail shorter than ``lap`` is dropped unless it is all there is."""
    sized = df.select(id_col, F.size(tokens(text)).alias("total"))
    step = window - lap
    starts = F.sequence(F.lit(0), F.greatest(F.col("total") - 1, F.lit(0)), F.lit(step))
    cut = sized.where("total > 0").select(id_col, "total", F.posexplode(starts).alias("chunk", "start"))
    n = F.least(F.lit(window), F.col("total") - F.col("start"))
    return cut.select(id_col, "chunk", n.alias("n")).where(f"n >= {lap} or chunk = 0")
