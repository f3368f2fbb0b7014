"""Quality classifier: attention-based multiple-instance learning over passages.

A text is cut into passages of 64 words. Each is encoded from hashed words and
byte trigrams and a few surface shares, one of them how much of it the text repeats; gated attention weighs the encoded
passages and a logistic unit scores their weighted sum. Encoder, attention and
unit are learned together from labels of documents.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import frames, textkit
from .quality_rules import labelled

PASSAGE_WORDS, HASHED, SURFACE, HIDDEN, ATTENTION = 64, 256, 13, 32, 16
#: Bytes of a word, mean and deviation, that a feature tells apart at most.
LONGEST = 100
#: The most labelled documents that a fit reads, and passes over them.
FIT_ROWS, EPOCHS = 1500, 15
_SIZE = 2 * HASHED + SURFACE
_CLASS = np.zeros(256, np.int64)
for _chars, _k in ((range(48, 58), 1), (range(65, 91), 2), (range(97, 123), 3), (b"#*$%&|<>~^@\\{}[]=+", 4), (b".,;:!?", 5), (range(128, 256), 6), (b"\n", 7)):
    _CLASS[list(_chars)] = _k


def passages(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(features, text number) of all passages; a text without words has one, all zero."""
    w = textkit.words(texts)
    n = w.counts()
    per = np.maximum(1, -(-n // PASSAGE_WORDS))
    first = np.concatenate(([0], np.cumsum(per)))
    rank = np.arange(len(w.doc)) - w.first()[w.doc]
    own = first[w.doc] + rank // PASSAGE_WORDS
    total = int(first[-1])
    x = np.zeros((total, _SIZE), np.float32)
    n_words = np.maximum(np.bincount(own, minlength=total), 1)
    bucket = (w.hash >> np.uint64(56)).astype(np.int64)
    x[:, :HASHED] = (np.bincount(own * HASHED + bucket, minlength=total * HASHED).reshape(total, HASHED) / n_words[:, None])
    if len(w.start):
        # Bytes belong to the passage of the word that they are in or follow.
        at = np.zeros(len(w.data), np.int64)
        at[w.start] = 1
        word = np.cumsum(at) - 1
        owner = own[np.maximum(word, 0)]
        d = w.data.astype(np.uint32)
        tri = d[:-2] | d[1:-1] << np.uint32(8) | d[2:] << np.uint32(16)
        tri = ((tri * np.uint32(2654435761)) >> np.uint32(24)).astype(np.int64)
        n_bytes = np.maximum(np.bincount(owner, minlength=total), 1)
        x[:, HASHED : 2 * HASHED] = np.bincount(owner[:-2] * HASHED + tri, minlength=total * HASHED).reshape(total, HASHED) / n_bytes[:, None]
        kinds = np.bincount(owner * 8 + _CLASS[w.data], minlength=total * 8).reshape(total, 8) / n_bytes[:, None]
        x[:, 2 * HASHED : 2 * HASHED + 8] = kinds
        size = w.end - w.start
        mean = np.bincount(own, size, total) / n_words
        # Lengths are held to LONGEST, so that one endless word outweighs nothing.
        x[:, 2 * HASHED + 8] = np.minimum(mean, LONGEST) / 10
        x[:, 2 * HASHED + 9] = np.minimum(np.sqrt(np.maximum(np.bincount(own, size * size.astype(float), total) / n_words - mean**2, 0)), LONGEST) / 10
        order = np.lexsort((w.hash, own))
        o, h = own[order], w.hash[order]
        again = np.concatenate(([False], (o[1:] == o[:-1]) & (h[1:] == h[:-1])))
        x[:, 2 * HASHED + 10] = np.bincount(o[again], minlength=total) / n_words
        x[:, 2 * HASHED + 11] = np.bincount(own, minlength=total) / PASSAGE_WORDS
        # What the passage shares with the rest of its text: 5-word runs that the text has twice or more.
        run = textkit.windows(w.hash, 5)
        within = w.doc[4:] == w.doc[:-4] if len(run) else np.zeros(0, bool)
        with np.errstate(over="ignore"):
            key = textkit.mix(run[within] + w.doc[: len(run)][within].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        twice = order[np.concatenate((same, [False])) | np.concatenate(([False], same))] if len(key) else order
        x[:, 2 * HASHED + 12] = np.bincount(own[: len(run)][within][twice], minlength=total) / n_words
    return x, np.repeat(np.arange(len(texts)), per)


@dataclass
class MilModel:
    mean: np.ndarray
    scale: np.ndarray
    p: dict

    def score(self, texts: list[bytes]) -> np.ndarray:
        x, doc = passages(texts)
        return _forward(self.p, _standard(x, self.mean, self.scale), doc, len(texts))[-1]

    def weights(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The attention weight of each passage, and its text."""
        x, doc = passages(texts)
        return _forward(self.p, _standard(x, self.mean, self.scale), doc, len(texts))[4], doc


#: Standardised features are held within this, so that a rare bucket can't outweigh the rest.
_MOST = 4.0


def _standard(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    return np.clip((x - mean) * scale, -_MOST, _MOST)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _sum(x: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Sums of rows by text; ``doc`` is sorted and has every text."""
    return np.add.reduceat(x, np.searchsorted(doc, np.arange(doc[-1] + 1)), axis=0)


def _forward(p: dict, x: np.ndarray, doc: np.ndarray, n: int):
    h = np.tanh(x @ p["W"] + p["b"])
    t, g = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
    e = (t * g) @ p["w"]
    top = np.full(n, -np.inf)
    np.maximum.at(top, doc, e)
    a = np.exp(e - top[doc])
    a = a / _sum(a, doc)[doc]
    z = _sum(a[:, None] * h, doc)
    return h, t, g, z, a, _sigmoid(z @ p["c"] + p["d"])


def _backward(p: dict, x: np.ndarray, doc: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict:
    h, t, g, z, a, s = _forward(p, x, doc, len(y))
    ds = weight * (s - y)
    dz = ds[:, None] * p["c"]
    da = (h * dz[doc]).sum(1)
    de = a * (da - _sum(a * da, doc)[doc])
    dtg = de[:, None] * p["w"]
    dt, dg = dtg * g * (1 - t * t), dtg * t * g * (1 - g)
    dh = (a[:, None] * dz[doc] + dt @ p["V"].T + dg @ p["U"].T) * (1 - h * h)
    return {"W": x.T @ dh + 1e-4 * p["W"], "b": dh.sum(0), "V": h.T @ dt, "U": h.T @ dg, "w": (t * g).T @ de, "c": z.T @ ds, "d": ds.sum(keepdims=True)}


def fit(documents: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, epochs: int = EPOCHS, label: str = "quality") -> MilModel:
    """Learns from at most ``rows`` labelled documents, those whose ids hash lowest. Without labels of both classes every score is the only class's (0.5 without any)."""

    def run(batch: pa.RecordBatch) -> dict:
        out = []
        for _, texts in textkit.text_slices(batch):
            x, doc = passages(texts)
            out += [x[doc == i].astype(np.float32).tobytes() for i in range(len(texts))]
        return {"features": pa.array(out, pa.binary())}

    got = frames.arrow_map(labelled(documents, labels, rows, label), run, ["doc_id", "label"], "features binary").collect()
    got.sort(key=lambda r: (r.doc_id, r.features))
    bags = [np.frombuffer(r.features, np.float32).reshape(-1, _SIZE) for r in got]
    return learn(bags, np.array([r.label for r in got], float), epochs)


def learn(bags: list[np.ndarray], y: np.ndarray, epochs: int = EPOCHS) -> MilModel:
    """A model of texts given as the features of their passages, with labels 0 and 1."""
    rng = np.random.default_rng(7)
    p = {"W": rng.normal(0, _SIZE**-0.5, (_SIZE, HIDDEN)), "b": np.zeros(HIDDEN), "V": rng.normal(0, HIDDEN**-0.5, (HIDDEN, ATTENTION)), "U": rng.normal(0, HIDDEN**-0.5, (HIDDEN, ATTENTION)), "w": rng.normal(0, 0.3, ATTENTION), "c": rng.normal(0, 0.3, HIDDEN), "d": np.zeros(1)}
    if len(set(y)) < 2:
        p = {k: np.zeros_like(v) for k, v in p.items()} | {"d": np.array([0.0 if not len(y) else 20.0 if y[0] else -20.0])}
        return MilModel(np.zeros(_SIZE), np.ones(_SIZE), p)
    every = np.concatenate(bags)
    mean, scale = every.mean(0), 1 / (every.std(0) + 1e-3)
    del every
    weight = np.ones(len(y))
    m, v, step = {k: 0.0 for k in p}, {k: 0.0 for k in p}, 0
    for epoch in range(epochs):
        order = rng.permutation(len(bags))
        for i in range(0, len(order), 64):
            take = order[i : i + 64]
            x = _standard(np.concatenate([bags[j] for j in take]), mean, scale)
            doc = np.repeat(np.arange(len(take)), [len(bags[j]) for j in take])
            g = _backward(p, x, doc, y[take], weight[take] / len(take))
            step += 1
            for k in p:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                p[k] = p[k] - 0.003 * (1 - 0.9 * epoch / epochs) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return MilModel(mean, scale, {k: x.astype(np.float32) for k, x in p.items()})


def score(df: DataFrame, model: MilModel, keep: list[str], text: str = "text", name: str = "score") -> DataFrame:
    """``keep`` of each row beside its score, 0 to 1, rows one for one; an empty table gives an empty result.

    Null texts score as empty ones; nothing is read but the text; equal texts
    score alike up to rounding, so ties stay ties. A ``keep`` column of the
    name made raises.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)  # some 20,000 numbers

    def run(batch: pa.RecordBatch) -> dict:
        return {name: np.concatenate([shared.value.score(t) for _, t in textkit.text_slices(batch, text)]).astype(np.float64)}

    return frames.arrow_map(df.select(*dict.fromkeys([*keep, text])), run, keep, f"`{name}` double")
