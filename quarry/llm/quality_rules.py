"""Quality rules: base counts and a calibrated hashed n-gram logistic regression.

Word unigrams and bigrams and 4-grams of characters of each whole text are hashed into
buckets; a text's features are the shares of its n-grams in each bucket, by
kind. The regression is fitted on a bounded sample of labelled rows, its margin
turned into a probability by a logistic curve fitted on rows held back, and
every text is scored in Arrow batches against a fixed threshold.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import frames, textkit

#: Buckets of each kind of n-gram (a power of two), and the most labelled rows that a fit reads.
BUCKETS, FIT_ROWS = 1 << 15, 2000
#: A text is kept if its probability of being good is at least this.
KEEP_AT = 0.5
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 10, 20, 5

_SYMBOLS = re.compile(rb"[#*$%&|<>]")
_SPACES = bytes([0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D])


def base_counts(text: bytes) -> tuple[int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of one UTF-8 text."""
    words = text.split()
    n = len(words)
    chars = len(text.translate(None, _SPACES).decode())
    symbols = len(_SYMBOLS.findall(text))
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    dup = len(lines) - len(set(lines))
    repeat = 0
    if n > WINDOW:
        runs = list(zip(*(words[i:] for i in range(WINDOW))))
        often = Counter(runs)
        if len(often) < len(runs):
            upto = 0
            for i, r in enumerate(runs):
                if often[r] > 1:
                    repeat += i + WINDOW - max(i, upto)
                    upto = i + WINDOW
    return n, chars, symbols, dup, repeat


def _grams(texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(text, bucket) of every n-gram, by kind: words, word pairs, 4 characters (code points)."""
    w = textkit.words(texts)
    shift = np.uint64(64 - (BUCKETS.bit_length() - 1))
    one = (w.hash >> shift).astype(np.int32)
    pair = textkit.windows(w.hash, 2)
    within = w.doc[1:] == w.doc[:-1]
    two = (pair[within] >> shift).astype(np.int32)
    first = np.flatnonzero((w.data & 0xC0) != 0x80)  # the byte in which each character begins
    c = np.frombuffer(w.data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    four, at = c[: len(c) - 3], first[: len(c) - 3]
    with np.errstate(over="ignore"):
        for i in (1, 2, 3):
            four = four * np.uint32(0x9E3779B1) + c[i : len(c) - 3 + i]
        four = (((four ^ four >> np.uint32(15)) * np.uint32(2654435761)) >> np.uint32(32 - (BUCKETS.bit_length() - 1))).astype(np.int32)
    # 4 characters that reach beyond their text are left out.
    last = np.searchsorted(w.doc_start, at, side="right") - 1
    inside = first[3 : 3 + len(at)] < w.doc_start[last + 1] - 1
    return [(w.doc, one), (w.doc[1:][within], two + BUCKETS), (last[inside], four[inside] + 2 * BUCKETS)]


def margins(texts: list[bytes], weights: np.ndarray, bias: float) -> np.ndarray:
    out = np.full(len(texts), bias)
    for doc, bucket in _grams(texts):
        n = np.bincount(doc, minlength=len(texts))
        out += np.bincount(doc, weights[bucket], len(texts)) / np.maximum(n, 1)
    return out


@dataclass
class QualityModel:
    weights: np.ndarray
    bias: float
    scale: float
    shift: float

    def probability(self, texts: list[bytes]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * margins(texts, self.weights, self.bias) + self.shift, -40, 40)))


def labelled(documents: DataFrame, labels: DataFrame, rows: int, label: str = "quality") -> DataFrame:
    """(doc_id, text, label) of at most ``rows`` labelled documents, those whose id hashes lowest.

    Ids labelled both ways, and nulls, are left out; of several texts of one
    id the least is taken, so ``rows`` bounds what comes out.
    """
    ids = (
        labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull())
        .groupBy("doc_id").agg(F.min(label).alias("lo"), F.max(label).alias("hi")).where("lo = hi")
        .select(F.col("doc_id").alias("__id"), F.col("lo").cast("int").alias("label"))
        .orderBy(F.xxhash64("__id"), "__id").limit(rows)
    )
    held = documents.select("doc_id", "text").join(F.broadcast(ids), F.col("doc_id") == F.col("__id"))  # ``rows`` ids
    return held.groupBy("doc_id").agg(F.min("text").alias("text"), F.min("label").alias("label"))


def _sparse(df: DataFrame) -> list:
    def run(batch: pa.RecordBatch) -> dict:
        out = []
        for _, texts in textkit.text_slices(batch):
            found = []
            for doc, bucket in _grams(texts):
                key, n = np.unique(doc * (3 * BUCKETS) + bucket, return_counts=True)
                total = np.bincount(doc, minlength=len(texts))
                at = key // (3 * BUCKETS)
                found.append((at, key % (3 * BUCKETS), n / total[at]))
            at, bucket, share = (np.concatenate(x) for x in zip(*found))
            for i in range(len(texts)):
                own = at == i
                out.append(bucket[own].astype(np.int32).tobytes() + share[own].astype(np.float32).tobytes())
        return {"features": pa.array(out, pa.binary())}

    return frames.arrow_map(df, run, ["doc_id", "label"], "features binary").collect()


def _adam(score_grad, size: int, steps: int, rate: float) -> np.ndarray:
    w, m, v = np.zeros(size), np.zeros(size), np.zeros(size)
    for t in range(1, steps + 1):
        g = score_grad(w)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-12)
    return w


def fit(documents: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, steps: int = 60) -> QualityModel:
    """Fits on at most ``rows`` labelled documents; a quarter of them only calibrates.

    Without labelled rows, or with one class only, the model gives that class
    (without any, good) everywhere.
    """
    got = sorted(_sparse(labelled(documents, labels, rows)), key=lambda r: (r.doc_id, r.features))
    y = np.array([r.label for r in got], float)
    if len(set(y)) < 2:
        return QualityModel(np.zeros(3 * BUCKETS), 0.0, 0.0, -20.0 if len(y) and y[0] == 0 else 20.0)
    n = np.array([len(r.features) // 8 for r in got])
    col = np.concatenate([np.frombuffer(r.features, np.int32, k) for r, k in zip(got, n)])
    val = np.concatenate([np.frombuffer(r.features, np.float32, k, 4 * k) for r, k in zip(got, n)])
    del got
    filled = np.flatnonzero(n)
    starts = (np.cumsum(n) - n)[filled]
    held = np.arange(len(y)) % 4 == 3
    if len(set(y[held])) < 2 or len(set(y[~held])) < 2:
        held[:] = False
    use = np.where(held, 0.0, np.where(y > 0, 0.5 / max(1, (y[~held] > 0).sum()), 0.5 / max(1, (y[~held] == 0).sum())))

    def margin(w: np.ndarray) -> np.ndarray:
        m = np.full(len(y), w[-1])
        m[filled] += np.add.reduceat(val * w[col], starts) if len(starts) else 0.0
        return m

    def grad(w: np.ndarray) -> np.ndarray:
        e = use * (1 / (1 + np.exp(-np.clip(margin(w), -40, 40))) - y)
        g = np.append(np.bincount(col, val * np.repeat(e, n), 3 * BUCKETS), e.sum())
        return g + 1e-7 * w

    w = _adam(grad, 3 * BUCKETS + 1, steps, 0.5)
    at, truth = (margin(w)[held], y[held]) if held.any() else (margin(w), y)
    # Platt's targets keep the curve finite where the classes are apart.
    hi, lo = (truth.sum() + 1) / (truth.sum() + 2), 1 / ((1 - truth).sum() + 2)
    aim, spread = np.where(truth > 0, hi, lo), max(at.std(), 1e-9)

    def curve(c: np.ndarray) -> np.ndarray:
        e = (1 / (1 + np.exp(-np.clip(c[0] * at / spread + c[1], -40, 40))) - aim) / len(at)
        return np.array([(e * at).sum() / spread, e.sum()])

    c = _adam(curve, 2, 400, 0.1)
    frames.release()
    return QualityModel(w[:-1], float(w[-1]), float(c[0] / spread), float(c[1]))


OUT = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, quality_p double, kept boolean"


def judge(df: DataFrame, model: QualityModel, keep: list[str], text: str = "text", keep_at: float = KEEP_AT, prefix: str = "") -> DataFrame:
    """``keep`` of each row beside the base counts, the probability and the verdict (names after ``prefix``).

    A null text is an empty one: no words, failed. Equal rows are judged alike
    and each keeps its row; an empty table gives an empty result. Nothing is
    read but the text. A ``keep`` column of a made name raises; ``prefix``
    avoids that.
    """
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(model)  # 3 * BUCKETS doubles at every size of the input
    names = [x.split()[0] for x in OUT.split(", ")]

    def run(batch: pa.RecordBatch) -> dict:
        counts, p = [], []
        for _, texts in textkit.text_slices(batch, text):
            counts += [base_counts(t) for t in texts]
            p.append(shared.value.probability(texts))
        c, p = np.array(counts, np.int64), np.concatenate(p)
        failed = (c[:, 0] < MIN_WORDS) | (100 * c[:, 4] > MAX_REPEAT_PERCENT * c[:, 0])
        return dict(zip([prefix + n for n in names], [*c.T, failed, p, ~failed & (p >= keep_at)]))

    cols = list(dict.fromkeys([*keep, text]))
    return frames.arrow_map(df.select(*cols), run, keep, ", ".join(prefix + x for x in OUT.split(", ")))
