"""Queries of the operators, each over its whole table, and their SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, jaccard_join, kneser_ney, licenses, mil_classifier, packing, quality_rules, secrets, token_counts, vector_neighbours


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def remainder(n: int, at: int) -> F.Column:
    """Whether crc32 of doc_id as text leaves ``at``; a null id does not."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(n)) == at, F.lit(False))


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = bpe.read_ranks(_tokenizer("byte_bpe_multi_50k.tiktoken"))
    ids = bpe.encode(_table(spark, sf_dir, "documents"), ranks, keep=["doc_id"])
    ids = ids.withColumn("ids_sha256", F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256))
    back = bpe.decode(ids, ranks, keep=["doc_id", "n_tokens", "ids_sha256"])
    return back.select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality_rules.judge(docs, quality_rules.fit(docs, _table(spark, sf_dir, "labels")), ["doc_id"])


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(_table(spark, sf_dir, "documents"), ["doc_id"])
    span = F.transform("licenses", lambda x: F.concat_ws(":", x["template"], F.round(x["coverage"], 4).cast("string"), x["start"].cast("string"), x["end"].cast("string")))
    return found.select("doc_id", F.size("licenses").cast("long").alias("n_licenses"), F.array_join(span, ",").alias("spans"))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(_table(spark, sf_dir, "documents"), ["doc_id"])

    def text(x):
        return F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))

    def number(kind: str):
        return F.size(F.filter("secrets", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    kinds = [number(k) for k in secrets.BASE_KINDS]
    base = F.filter("secrets", lambda x: x["kind"].isin(*secrets.BASE_KINDS))
    return found.select("doc_id", *kinds, F.sha2(F.array_join(F.transform(base, text), ","), 256).alias("base_sha256"), F.array_join(F.transform("secrets", text), ",").alias("spans"))


def op5_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", remainder(5, 1))
    model = kneser_ney.train(docs.where(~F.col("held_out")))
    return kneser_ney.score(docs, model, ["doc_id", "held_out"])


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.membership(_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "n_links")


def op7_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit(_table(spark, sf_dir, "documents"))


def op8_vector_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_neighbours.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op9_mil_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", remainder(3, 1))
    model = mil_classifier.fit(docs.where(~F.col("held_out")), _table(spark, sf_dir, "labels"))
    scored = mil_classifier.score(docs, model, ["doc_id", "held_out"])
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"), token_counts.read_vocabulary(_tokenizer("piece_bpe_32k.model")), ["doc_id"])


def quality_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts of op2, which SQL can say."""
    return op2_quality_rules(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def secret_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many secrets of each base kind op4 finds."""
    return op4_secrets(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex")


def shingle_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sizes of op6's sets."""
    return jaccard_join.signatures(_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles")


def packing_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op7 has packed of each document."""
    sums = op7_best_fit(spark, sf_dir).groupBy("doc_id").agg(F.sum("n_tokens").alias("n_tokens"), F.count("*").alias("n_pieces"))
    return sums.select("doc_id", "n_tokens", "n_pieces")


def token_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and digest of each text after op1's encoding and decoding."""
    ranks = bpe.read_ranks(_tokenizer("byte_bpe_multi_50k.tiktoken"))
    back = bpe.decode(bpe.encode(_table(spark, sf_dir, "documents"), ranks, keep=["doc_id"]), ranks, keep=["doc_id"])
    return back.select("doc_id", F.octet_length("decoded").cast("long").alias("n_bytes"), F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES = {f.__name__: f for f in (op1_bpe, op2_quality_rules, op3_licenses, op4_secrets, op5_kneser_ney, op6_jaccard_join, op7_best_fit, op8_vector_neighbours, op9_mil_classifier, op10_token_counts)}
QUERIES |= {f.__name__: f for f in (quality_base, secret_counts, shingle_counts, packing_totals, token_lengths)}

_W = "regexp_extract_all(coalesce({0}, ''), '[^\\x20\\x09-\\x0D]+')"
_FIVE = "list_transform(range(1, len(w) - 3), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] || ' ' || w[i + 4])"

#: What DuckDB can say of the operators over whole tables. The verdicts of models, links and spans it cannot, or not
#: quickly; tests/llm compares those with brute force, a library, a round trip or held-out labels.
ORACLE_SQL: dict[str, str] = {
    "quality_base": f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, {_W.format("text")} AS w FROM documents),
        l AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM d),
        g AS (SELECT doc_id, unnest({_FIVE}) AS g, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) > 4),
        r AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g),
        c AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM r, (SELECT unnest(range(5)) AS k) WHERE n > 1 GROUP BY doc_id),
        x AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
            CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words FROM d JOIN l USING (doc_id) LEFT JOIN c USING (doc_id))
        SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM x""",
    "secret_counts": """SELECT doc_id, CAST(len(list_filter(regexp_extract_all(coalesce(text, ''), '(?i:password|passwd|secret|token|api_?key)["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)', 1), lambda x: length(x) >= 6)) AS BIGINT) AS n_assign,
        CAST(len(list_filter(regexp_extract_all(coalesce(text, ''), 'AKIA[A-Z0-9]+'), lambda x: length(x) >= 20)) AS BIGINT) AS n_access,
        CAST(len(list_filter(regexp_extract_all(coalesce(text, ''), '[0-9a-f]+'), lambda x: length(x) >= 24)) AS BIGINT) AS n_hex FROM documents""",
    "shingle_counts": f"""WITH d AS (SELECT doc_id, {_W.format("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents)
        SELECT doc_id, CAST(CASE WHEN len(w) > 4 THEN len(list_distinct({_FIVE})) ELSE least(len(w), 1) END AS BIGINT) AS n_shingles FROM d""",
    "packing_totals": f"SELECT doc_id, CAST(len({_W.format('text')}) + 1 AS BIGINT) AS n_tokens, CAST(ceil((len({_W.format('text')}) + 1) / 2048.0) AS BIGINT) AS n_pieces FROM documents",
    "token_lengths": "SELECT doc_id, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n_bytes, sha256(coalesce(text, '')) AS decoded_sha256 FROM documents",
}
