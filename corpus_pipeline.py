"""A corpus pipeline: quality rules, quality classifier, near-duplicates, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last return the columns of ``documents`` for the rows they keep. Stages may be
run one by one, each over what the one before has written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import frames, jaccard_join, mil_classifier, packing, quality_rules, secrets

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the n-gram model."""
    model = quality_rules.fit(docs, _labels(spark, sf_dir))
    judged = quality_rules.judge(docs.select(*COLUMNS), model, COLUMNS, prefix="__")
    return judged.where("__kept").select(*COLUMNS)


def classifier_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores at 0.5 or more."""
    model = mil_classifier.fit(docs, _labels(spark, sf_dir))
    return mil_classifier.score(docs.select(*COLUMNS), model, COLUMNS, name="__score").where("__score >= 0.5").select(*COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: the one with the smallest id, then the smallest class of equal n-gram sets.

    Whether a row stays goes by its id and its text, so two texts under one id
    are two documents. Rows alike in id and n-gram set are one; a row without an
    id comes after those with one. Texts without words are copies of nothing
    and stay, once for each id and text.
    """
    classed = jaccard_join.signatures(docs.select(*COLUMNS), keep=COLUMNS)
    sig = frames.written(classed.select("doc_id", "n_shingles", "class"), "signatures")
    comps = jaccard_join.links(docs, sig=sig)[1]
    keys = [F.col("doc_id").isNull().alias("__none"), F.coalesce("doc_id", F.lit(0)).alias("__id"), F.coalesce("class", F.xxhash64("text")).alias("__class")]
    names = ["__none", "__id", "__class"]
    stays = jaccard_join.winners(sig, comps, "doc_id").select(*keys[:2], F.col("class").alias("__class"), F.lit(True).alias("__stays"))
    placed = classed.select(*COLUMNS, F.col("class").isNull().alias("__bare"), *keys).join(stays, names, "left")
    return placed.where("__bare or __stays").dropDuplicates(names).select(*COLUMNS)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by their kind; n_chars follows the text."""
    clean = secrets.redact(docs.select(*COLUMNS))
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and the bins they are in."""
    return packing.best_fit(docs)


STAGES = [
    ("quality_rules", quality_stage),
    ("quality_classifier", classifier_stage),
    ("ngram_jaccard_join", near_duplicate_stage),
    ("secret_scan", secrets_stage),
    ("best_fit_packing", packing_stage),
]

#: The classifiers' verdicts cannot be said in SQL; tests/llm runs the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = frames.written(docs, name)
    return docs
