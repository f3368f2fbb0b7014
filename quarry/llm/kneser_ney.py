"""N-gram language model with interpolated modified Kneser-Ney smoothing.

Tokens are the lower-cased words of a text and one end; order - 1 begin marks
stand before a text. Words are counted first and numbered in the order of their
hashes. Then each task counts the longest n-grams of its texts and packs them by
hash range; the shuffle moves packed rows, one per group of texts and range, in
which a frequent n-gram stands once, as compressed columns of word numbers. A
range's merged counts are written to the shared folder as sorted arrays, which
workers map into memory to score, and its distinct n-grams go on as continuation
counts of the next shorter ones, which are merged in the same way.
The ranges are treated in ROUNDS rounds, and what a round has shuffled and read
is removed after it, so that it is not all on disk at once; the rounds of the
longest n-grams read the texts again.
A context that is followed once in all keeps that word beside it and needs no
n-gram of its own. Of keys, the arrays hold 48 bits; the top 16 choose a bucket.
Contexts so frequent that they hold 1/4096 of all tokens are split over the
ranges by the whole n-gram; at most 8192 of each length are.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import frames, textkit

#: A context with this share of all tokens is split over all ranges.
FREQUENT_SHARE = 1 / 4096
#: Bytes of texts counted together, numbered or scored together, and for each range of hashes.
GROUP_BYTES, SCORE_BYTES, RANGE_BYTES = 16 << 20, 4 << 20, 4 << 20
#: Into how many rounds the ranges are cut.
ROUNDS = 2
BEGIN, END = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
#: The longest n-grams that are counted, where the caller does not say.
ORDER = 3
#: Kinds of packed rows beside n-grams, whose kind is their length: words, continuations of words, numbers of a range.
_WORDS, _CONT, _NUMBERS = 0, 50, 51
#: Statistics of split contexts and candidates for splitting: these and the length of the n-gram.
_STATS, _OFTEN = 100, 200
_ROWS = "fragment int, kind int, a binary, b binary, c binary"
_TOP = np.uint64(0xFFFF000000000000)
_MULT = np.uint64(0x9E3779B97F4A7C15)
_TYPES = [np.dtype(t) for t in (np.uint8, np.uint16, np.uint32, np.uint64, np.int64)]
_CODEC = pa.Codec("zstd", 1)


def token_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, text number) of all tokens of some texts, each text's end included."""
    w = textkit.words(texts, lower=True)
    n = w.counts()
    h = np.full(len(w.hash) + len(texts), END, np.uint64)
    doc = np.repeat(np.arange(len(texts)), n + 1)
    at = np.arange(len(w.hash)) + w.doc
    h[at] = w.hash
    return h, doc


def before(w: np.ndarray, doc: np.ndarray, order: int, begin: int) -> list[np.ndarray]:
    """The tokens 1, 2, ... order - 1 places before each token, ``begin`` before a text."""
    start = _starts(doc)
    place = np.arange(len(w)) - np.repeat(start, np.diff(np.append(start, len(w))))
    out = []
    for k in range(1, order):
        x = np.full_like(w, begin)
        x[k:] = w[:-k]
        x[place < k] = begin
        out.append(x)
    return out


def contexts(columns: list[np.ndarray]) -> Iterator[np.ndarray]:
    """Hashes of the 1, 2, ... tokens before each token."""
    h = np.uint64(0)
    for c in columns:
        with np.errstate(over="ignore"):
            h = textkit.mix(h * _MULT + c.astype(np.uint64) + np.uint64(1))
        yield h


def pair_keys(v: np.ndarray, w: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """64-bit keys of context ``v`` and word ``w``; the top 16 bits, which choose the range, are the context's unless it is frequent."""
    with np.errstate(over="ignore"):
        pair = textkit.mix(v * _MULT + w.astype(np.uint64))
    top = v
    if len(frequent):
        near = np.zeros(1 << 16, bool)
        near[frequent >> np.uint64(48)] = True
        at = np.flatnonzero(near[v >> np.uint64(48)])  # the others share no top bits with a frequent context
        at = at[frequent[np.minimum(np.searchsorted(frequent, v[at]), len(frequent) - 1)] == v[at]]
        top = v.copy()
        top[at] = pair[at]
    return (top & _TOP) | (pair >> np.uint64(16))


def part_of(h: np.ndarray, parts: int) -> np.ndarray:
    return ((h >> np.uint64(48)) * np.uint64(parts) >> np.uint64(16)).astype(np.int64)


def _first_bucket(f: int, parts: int) -> int:
    """The least top 16 bits of range ``f``."""
    return -(-(int(f) << 16) // parts)


def _starts(sorted_key: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate(([True], sorted_key[1:] != sorted_key[:-1]))) if len(sorted_key) else np.zeros(0, int)


def _order(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(stable order, keys in that order). Sorts the high bits with the places in the low ones, which is faster than argsort; then keys that differ in low bits alone."""
    if not len(key):
        return np.zeros(0, np.int64), key
    low = np.uint64((1 << (len(key) - 1).bit_length()) - 1)
    packed = key.astype(np.uint64) << np.uint64(64 - max(int(key.max()).bit_length(), 1))
    packed &= ~low
    packed |= np.arange(len(key), dtype=np.uint64)
    packed.sort()
    order = (packed & low).view(np.int64)
    key = key[order]
    wrong = np.flatnonzero(key[1:] < key[:-1])
    if len(wrong):
        packed &= ~low
        run = np.cumsum(np.concatenate(([0], packed[1:] != packed[:-1])))
        mixed = np.zeros(run[-1] + 1, bool)
        mixed[run[wrong]] = True
        at = np.flatnonzero(mixed[run])
        again = at[np.lexsort((order[at], key[at]))]
        order[at], key[at] = order[again], key[again]
    return order, key


def _distinct(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sorted distinct keys, which of them each key is, the first place of each)."""
    order, key = _order(key)
    start = _starts(key)
    which = np.empty(len(key), np.int64)
    which[order] = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(key))))
    return key[start], which, order[start]


def _sum_by(key: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    order, key = _order(key)
    start = _starts(key)
    return (key[start], *(np.add.reduceat(v[order], start) if len(key) else v for v in values))


def _record(rows: list[tuple]) -> pa.RecordBatch:
    arrow = pa.schema([("fragment", pa.int32()), ("kind", pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary())])
    return pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*rows), arrow)], schema=arrow)


def _narrow(x: np.ndarray) -> np.ndarray:
    """Counts in the fewest bytes that hold them."""
    return x.astype(np.min_scalar_type(int(x.max(initial=0))))


def _squeeze(x: np.ndarray) -> bytes:
    """An array compressed byte by byte of its values."""
    return _CODEC.compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T), asbytes=True)


def _expand(data: bytes, n: int, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    planes = np.frombuffer(_CODEC.decompress(data, decompressed_size=n * size), np.uint8).reshape(size, n)
    return np.ascontiguousarray(planes.T).reshape(-1).view(dtype)


def _pack(rows: list, key: np.ndarray, columns: list[np.ndarray], parts: int) -> None:
    """Adds the distinct n-grams (columns: words before, then the word), with their numbers: one row for each range. Empties ``columns``."""
    order, key = _order(key)
    start = _starts(key)
    count = np.diff(np.append(start, len(key))).astype(np.int32)
    key, order = key[start], order[start]
    taken = [c[order] for c in columns]
    columns.clear()
    bounds = np.searchsorted(part_of(key, parts), np.arange(parts + 1))
    for f in np.flatnonzero(np.diff(bounds)):
        s = slice(bounds[f], bounds[f + 1])
        packed = [_squeeze(c[s]) for c in taken]
        sizes = np.array([s.stop - s.start, *map(len, packed)], np.int64)
        rows.append((int(f), len(taken), sizes.tobytes(), b"".join(packed), _squeeze(count[s])))


def _unpack(held: list[tuple], level: int, dtype) -> tuple[list[np.ndarray], np.ndarray]:
    """(columns, numbers) of packed rows, which are taken from ``held`` one by one."""
    got: list[list] = [[] for _ in range(level + 1)]
    while held:
        _, sizes, packed, count = held.pop()
        n, *sizes = np.frombuffer(sizes, np.int64).tolist()
        at = 0
        for x, size in zip(got, sizes):
            x.append(_expand(packed[at : at + size], n, dtype))
            at += size
        got[-1].append(_expand(count, n, np.int32))
    out = []
    for x in got:
        out.append(np.concatenate(x))
        x.clear()
    return out[:-1], out[-1]


def _cut(rows: list, kind: int, p: np.ndarray, *arrays: np.ndarray) -> None:
    """Adds one row for each of the ascending ranges ``p`` of the arrays' entries."""
    start = _starts(p)
    for i, j in zip(start, np.append(start[1:], len(p))):
        rows.append((int(p[i]), kind, *([a[i:j].tobytes() for a in arrays] + [b"", b""])[:3]))


def _save(folder: str, name: str, f: int, arrays: list[np.ndarray]) -> None:
    """Arrays of a range as one file: their number, types and lengths, then each at a multiple of 8 bytes."""
    head = np.array([len(arrays)] + [x for a in arrays for x in (_TYPES.index(a.dtype), len(a))], np.int64)
    data = b"".join(a.tobytes() + bytes(-a.nbytes % 8) for a in (head, *arrays))
    frames.save_array(f"{folder}/{name}-{f}.npy", np.frombuffer(data, np.uint8))


def _load(folder: str, name: str, f: int) -> list[np.ndarray]:
    data = np.asarray(frames.load_array(f"{folder}/{name}-{f}.npy"))
    n = int(data[:8].view(np.int64)[0])
    at = 8 * (2 * n + 1)
    out = []
    for kind, size in data[8:at].view(np.int64).reshape(n, 2).tolist():
        t = _TYPES[kind]
        out.append(data[at : at + size * t.itemsize].view(t))
        at += size * t.itemsize + -size * t.itemsize % 8
    return out


def _save_keyed(folder: str, name: str, f: int, parts: int, key: np.ndarray, *values: np.ndarray) -> None:
    """Sorted keys, cut into the ends of the buckets and 32 and 16 bits, and values by key."""
    buckets = np.arange(_first_bucket(f, parts), _first_bucket(f + 1, parts) + 1)
    ends = _narrow(np.searchsorted(key >> np.uint64(48), buckets))
    middle, low = (key >> np.uint64(16)).astype(np.uint32), key.astype(np.uint16)
    _save(folder, name, f, [ends, middle, low, *values])


def _locate(ends: np.ndarray, middle: np.ndarray, low: np.ndarray, key: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, whether it is there) of each key in keyed arrays."""
    if not len(middle):
        return np.zeros(len(key), np.int64), np.zeros(len(key), bool)
    b = (key >> np.uint64(48)).astype(np.int64) - first
    at, end = ends[b].astype(np.int64), ends[b + 1].astype(np.int64)
    m, t = (key >> np.uint64(16)).astype(np.uint32), key.astype(np.uint16)
    last, size = len(middle) - 1, end - at
    step = 1 << max(int(size.max(initial=0)).bit_length() - 1, 0) if len(key) else 0
    at -= 1  # the last place whose middle bits are less, by halved steps
    while step:
        to = at + step
        at = np.where((to < end) & (middle.take(to, mode="clip") < m), to, at)
        step >>= 1
    at += 1
    while True:  # equal middle bits are rare
        at_most = np.minimum(at, last)
        same, rest = (at < end) & (middle[at_most] == m), low[at_most]
        on = same & (rest < t)
        if not on.any():
            return at_most, same & (rest == t)
        at += on


@dataclass
class KneserNey:
    """What scoring needs beside the mapped arrays; ``discounts``, ``frequent`` and ``frequent_stats`` go by length of n-gram."""

    folder: str
    parts: int
    order: int = ORDER
    n: int = 0
    v: int = 0
    bigrams: int = 0
    #: The number of the first word of each range, and of all.
    offsets: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))
    discounts: dict = field(default_factory=dict)
    lower_share: float = 1.0
    frequent: dict = field(default_factory=dict)
    frequent_stats: dict = field(default_factory=dict)
    _open: dict = field(default_factory=dict)

    def __getstate__(self):
        return self.__dict__ | {"_open": {}}

    @property
    def id_type(self) -> type:
        """Of numbers of words; ``v`` stands for the begin mark, the next for unknown words."""
        return np.uint32 if self.v + 2 < 1 << 32 else np.uint64

    def _held(self, name: str, f: int) -> list[np.ndarray]:
        if (name, f) not in self._open:
            self._open[name, f] = _load(self.folder, name, f)
        return self._open[name, f]

    def _find(self, name: str, keys: np.ndarray, columns: int) -> list[np.ndarray]:
        """Whether each of sorted ``keys`` is in the arrays ``name``, and its values; zero where absent."""
        out = [np.zeros(len(keys), bool), *(np.zeros(len(keys)) for _ in range(columns))]
        bounds = np.searchsorted(part_of(keys, self.parts), np.arange(self.parts + 1))
        for f in np.flatnonzero(np.diff(bounds)):
            s = slice(bounds[f], bounds[f + 1])
            held = self._held(name, f)
            at, out[0][s] = _locate(*held[:3], keys[s], _first_bucket(f, self.parts))
            if len(held[1]):
                for o, v in zip(out[1:], held[3:]):
                    o[s] = np.where(out[0][s], v[at], 0)
        return out

    def _numbers(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(numbers, counts in training) of sorted hashes of words."""
        ids, count = np.full(len(words), self.v + 1, self.id_type), np.zeros(len(words), np.int64)
        bounds = np.searchsorted(part_of(words, self.parts), np.arange(self.parts + 1))
        for f in np.flatnonzero(np.diff(bounds)):
            s = slice(bounds[f], bounds[f + 1])
            ends, middle, low, times = self._held("words", f)
            at, hit = _locate(ends, middle, low, words[s], _first_bucket(f, self.parts))
            if len(middle):
                ids[s] = np.where(hit, at + self.offsets[f], self.v + 1)
                count[s] = np.where(hit, times[at], 0)
        ids[words == BEGIN] = self.v
        return ids, count

    def numbers(self, h: np.ndarray) -> np.ndarray:
        """The numbers of words by their hashes."""
        words, at, _ = _distinct(h)
        return self._numbers(words)[0][at]

    def _continued(self, ids: np.ndarray) -> np.ndarray:
        """In how many contexts each word stands."""
        out = np.zeros(len(ids))
        known = np.flatnonzero(ids < self.v)
        p = np.searchsorted(self.offsets, ids[known], side="right") - 1
        for f in np.unique(p):
            at = known[p == f]
            out[at] = self._held("continued", f)[0][ids[at].astype(np.int64) - self.offsets[f]]
        return out

    def _discount(self, c: np.ndarray, level: int) -> np.ndarray:
        return np.array([0.0, *self.discounts[level]])[np.minimum(c, 3).astype(int)]

    def tokens(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(text number, count in training, base log10, log10 probability) of each token, each text's end included."""
        h, doc = token_hashes(texts)
        words, word, _ = _distinct(h)
        ids, count = self._numbers(words)
        cont = self._continued(ids)
        base = np.log10((count + 0.5) / (self.n + 0.5 * (self.v + 1)))[word]
        # From here by distinct n-gram: its probability, its words from the last one back, and at each token which one ends there.
        p = np.maximum(cont - self._discount(cont, 1), 0) / max(self.bigrams, 1) + self.lower_share / (self.v + 1)
        columns, gram, first = [ids], word, _starts(doc)
        for level in range(2, self.order + 1):
            columns = [np.append(c, c.dtype.type(self.v)) for c in columns]  # the last stands for begin marks alone
            context = np.concatenate((gram[:1], gram[:-1]))
            context[first] = len(columns[0]) - 1
            *_, v = contexts(columns)
            own, which, _ = _distinct(v)
            once, only, stats = self._stats(own, level)
            once, only, total, *n = (x[which] for x in (once, only, *stats))
            seen = np.maximum(total, 1)
            rest = np.where(total > 0, sum(d * x for d, x in zip(self.discounts[level], n)) / seen, 1.0)
            pairs, at, place = _distinct(context.astype(np.uint64) * np.uint64(len(ids)) + word.astype(np.uint64))
            context, last = context[place], ids[word[place]]
            c = (only[context] == last).astype(float)
            more = np.flatnonzero(((total > 0) & ~once)[context])
            order, keys = _order(pair_keys(v[context[more]], last[more], self.frequent[level]))
            c[more[order]] = self._find(f"grams{level}", keys, 1)[1]
            p = np.maximum(c - self._discount(c, level), 0) / seen[context] + rest[context] * p[gram[place]]
            columns, gram = [last, *(x[context] for x in columns)], at
        return doc, count[word], base, np.log10(p)[gram]

    def _stats(self, own: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """Of sorted contexts: whether each is followed once, by which word (else -1), and how often and by how many words 1, 2, 3 or more times."""
        once, low, high = self._find(f"once{level}", own, 2)
        only = np.where(once, low + high * 65536, -1)
        stats = [once.astype(float), once.astype(float), np.zeros(len(own)), np.zeros(len(own))]
        for x, y in zip(stats, self._find(f"contexts{level}", own[~once], 4)[1:]):
            x[~once] = y
        often = self.frequent[level]
        if len(often):
            k = np.minimum(np.searchsorted(often, own), len(often) - 1)
            hit = often[k] == own
            stats = [np.where(hit, self.frequent_stats[level][k, j], x) for j, x in enumerate(stats)]
        return once, only, stats

    def score(self, texts: list[bytes]) -> dict[str, np.ndarray]:
        """n_tokens, n_known, base_score and score (log10) of each text."""
        doc, count, base, p = self.tokens(texts)
        size = len(texts)
        return {
            "n_tokens": np.bincount(doc, minlength=size),
            "n_known": np.bincount(doc, count > 0, size).astype(np.int64),
            "base_score": np.bincount(doc, base, size),
            "score": np.bincount(doc, p, size),
        }


def discounts(n: tuple) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts from the numbers of n-grams counted 1, 2, 3 and 4 times; D(k) = k / 2 where they are undefined."""
    n1, n2, n3, n4 = map(float, n)
    y = n1 / (n1 + 2 * n2) if n1 else 0.0
    out = []
    for k, (a, b) in enumerate(((n1, n2), (n2, n3), (n3, n4)), 1):
        d = k - (k + 1) * y * b / a if a and n1 else k / 2
        out.append(min(max(d, 0.0), float(k)) or k / 2)
    return tuple(out)


@contextmanager
def _shuffles_removed(spark: SparkSession):
    """Files of a shuffle are removed when its query ends; by default they stay until the driver collects garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    old = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if old is None else spark.conf.set(name, old)


def train(df: DataFrame, text: str = "text", order: int = ORDER) -> KneserNey:
    """A model of all texts of ``df``, its arrays in the shared folder; n-grams have up to ``order`` tokens, 2 at least.

    Null texts are empty (an end alone); without rows, all words are unknown.
    ``df`` is read once for its size, once for its words and ROUNDS times for its n-grams.
    """
    if order < 2:
        raise ValueError("order must be 2 or more")
    with _shuffles_removed(df.sparkSession):
        return _train(df, text, order)


def _train(df: DataFrame, text: str, order: int) -> KneserNey:
    spark = df.sparkSession
    size = df.agg(F.sum(F.octet_length(text))).first()[0] or 0
    parts = min(1 << 16, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // RANGE_BYTES)))
    frames.bound_batches(spark)
    folder = frames.new_folder(spark, "model")
    schema = T._parse_datatype_string(_ROWS)
    levels = range(2, order + 1)

    def words(batches):
        held, size = [], 0

        def counted():
            cols = [np.concatenate(x) for x in zip(*held)]
            held.clear()
            w, *cols = cols
            rows: list = []
            key, count = np.unique(w, return_counts=True)
            _cut(rows, _WORDS, part_of(key, parts), key, count.astype(np.int64))
            # Of a context with this share of all tokens, groups where it has half that share hold half at least.
            for level, c in enumerate(contexts(cols), 2):
                if level > 2:
                    at, sorted_c = _order(c)
                    start = _starts(sorted_c)
                    count = np.diff(np.append(start, len(c)))
                    often = count >= FREQUENT_SHARE / 2 * len(w)
                    one = at[start[often]]
                    _cut(rows, _OFTEN + level, part_of(c[one], parts), c[one], count[often].astype(np.int64), np.stack([x[one] for x in cols[: level - 1]], 1))
            return _record(rows)

        for batch in batches:
            for _, texts in textkit.text_slices(batch, text):
                h, doc = token_hashes(texts)
                held.append((h, *(before(h, doc, order, BEGIN) if order > 2 else ())))
                size += sum(map(len, texts))
                if size >= GROUP_BYTES:
                    yield counted()
                    size = 0
        if held:
            yield counted()
        frames.release()

    def merged_words(batches):
        got: dict[tuple, list] = {}
        for b in batches:
            for f, kind, a, c, x in zip(*(x.to_pylist() for x in b.columns)):
                a = np.frombuffer(a, np.uint64)
                got.setdefault((f, kind), []).append((a, np.frombuffer(c, np.int64), np.frombuffer(x, np.uint64).reshape(len(a), -1)))
        rows = []
        for (f, kind), x in got.items():
            keys, counts, columns = (np.concatenate(y) for y in zip(*x))
            key, count = _sum_by(keys, counts)
            if kind == _WORDS:
                _save_keyed(folder, "words", f, parts, key, _narrow(count))
                rows.append((f, kind, np.array([count.sum(), len(key)], np.int64).tobytes(), b"", b""))
            else:
                rows.append((f, kind, b"", count.tobytes(), columns[np.unique(keys, return_index=True)[1]].tobytes()))
        if rows:
            yield _record(rows)
        frames.release()

    texts = df.select(text)
    counted = frames.written(texts.mapInArrow(words, schema).repartition(parts, "fragment").mapInArrow(merged_words, schema), "words")
    n, per_range = 0, np.zeros(parts, np.int64)
    for r in counted.where(F.col("kind") == _WORDS).select("fragment", "a").collect():  # two numbers a range
        tokens, per_range[r.fragment] = np.frombuffer(r.a, np.int64).tolist()
        n += tokens
    model = KneserNey(folder, parts, order, n, int(per_range.sum()), offsets=np.concatenate(([0], np.cumsum(per_range))))
    _fill(spark, folder, parts, {"words": 1})

    def often(batches):
        for b in batches:
            for f, kind, _, count, x in zip(*(c.to_pylist() for c in b.columns)):
                if kind == _WORDS:
                    level, share, count = 2, FREQUENT_SHARE, model._held("words", f)[3]
                    columns = [np.arange(len(count)) + model.offsets[f]]
                else:
                    level, share, count = kind - _OFTEN, FREQUENT_SHARE / 2, np.frombuffer(count, np.int64)
                    columns = list(model.numbers(np.frombuffer(x, np.uint64)).reshape(-1, level - 1).T)
                on = count >= max(2, n * share)
                if on.any():
                    *_, key = contexts([c[on] for c in columns])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), level, np.int32)), pa.array(key.view(np.int64))], names=["level", "key"])

    found: dict[int, list] = {k: [] for k in levels}
    for r in counted.mapInArrow(often, "level int, key long").collect():  # at most 2 / FREQUENT_SHARE a level
        found[r.level].append(r.key)
    begin = next(contexts([np.array([model.v])]))  # as many texts, so many begin marks
    frequent = {k: np.unique(np.append(np.array(x, np.int64).view(np.uint64), begin if k == 2 else begin[:0])) for k, x in found.items()}

    def longest(turn: int):
        def run(batches):
            held, size = [], 0

            def packed():
                key, *columns = (np.concatenate(x) for x in zip(*held))
                held.clear()
                rows: list = []
                if len(key):
                    _pack(rows, key, columns, parts)
                return rows

            for batch in batches:
                for _, texts in textkit.text_slices(batch, text, SCORE_BYTES):  # each looks into all ranges of words
                    h, doc = token_hashes(texts)
                    w = model.numbers(h)
                    columns = [*before(w, doc, order, model.v), w]
                    *_, v = contexts(columns[:-1])
                    key = pair_keys(v, w, frequent[order])
                    on = part_of(key, parts) * ROUNDS // parts == turn
                    held.append((key[on], *(c[on] for c in columns)))
                    size += sum(map(len, texts))
                    if size >= GROUP_BYTES:
                        if rows := packed():
                            yield _record(rows)
                        size = 0
            if held and (rows := packed()):
                yield _record(rows)
            frames.release()

        return run

    def merge(level: int):
        def run(batches):
            for f, held in frames.runs_of(batches):
                columns, c = _unpack(held, level, model.id_type)
                *_, v = contexts(columns[:-1])
                key = pair_keys(v, columns[-1], frequent[level])
                at, key = _order(key)
                start = _starts(key)
                count = np.add.reduceat(c[at].astype(np.int64), start)
                key, at = key[start], at[start]
                columns, v = [x[at] for x in columns], v[at]
                at, v = _order(v)
                start = _starts(v)
                own, c = v[start], count[at]
                stats = [np.add.reduceat(x.astype(np.int64), start) for x in (c, c == 1, c == 2, c >= 3)]
                split = np.zeros(len(own), bool)
                near = np.minimum(np.searchsorted(own, frequent[level]), len(own) - 1)
                split[near[own[near] == frequent[level]]] = True
                once = (stats[0] == 1) & ~split
                only = at[start[once]]  # the n-grams of contexts that are followed once
                w = columns[-1][only]
                _save_keyed(folder, f"once{level}", f, parts, own[once], (w & w.dtype.type(0xFFFF)).astype(np.uint16), _narrow(w >> w.dtype.type(16)))
                rest = ~once & ~split
                _save_keyed(folder, f"contexts{level}", f, parts, own[rest], *(_narrow(x[rest]) for x in stats))
                kept = np.ones(len(key), bool)
                kept[only] = False
                _save_keyed(folder, f"grams{level}", f, parts, key[kept], _narrow(count[kept]))
                numbers = np.array([(count == k).sum() for k in (1, 2, 3, 4)] + [len(count)], np.int64)
                rows = [(f, _STATS + level, own[split].tobytes(), np.stack(stats, 1)[split].tobytes(), numbers.tobytes())]
                del key, at, count, c, own, stats, v, kept
                if level > 2:
                    del columns[level - 2]
                    *_, v = contexts(columns[:-1])
                    _pack(rows, pair_keys(v, columns[-1], frequent[level - 1]), columns, parts)
                else:
                    word, cont = np.unique(columns[-1], return_counts=True)
                    _cut(rows, _CONT, np.searchsorted(model.offsets, word, side="right") - 1, word.astype(np.uint64), cont.astype(np.int32))
                yield _record(rows)
            frames.release()

        return run

    turn_of = F.when(F.col("kind").between(2, order), F.floor(F.col("fragment") * F.lit(ROUNDS) / F.lit(parts)).cast("int")).otherwise(-1)
    tables = {k: frames.new_folder(spark, f"grams{k}") for k in levels}

    def table(level: int, turn: int) -> DataFrame:
        rows = spark.read.schema(f"{_ROWS}, turn int").parquet(tables[level])
        return rows.where(F.col("turn") == turn).drop("turn")

    for level in reversed(levels):
        for turn in range(ROUNDS):
            made = texts.mapInArrow(longest(turn), schema) if level == order else table(level + 1, turn)
            made = made.repartition(parts, "fragment").sortWithinPartitions("fragment").mapInArrow(merge(level), schema)
            made.withColumn("turn", turn_of).write.mode("append").partitionBy("turn").parquet(tables[level])
            if level < order:
                frames.remove(f"{tables[level + 1]}/turn={turn}")

    def finished(batches):
        cont: dict[int, list] = {}
        for b in batches:
            for f, a, x in zip(*(b.column(c).to_pylist() for c in ("fragment", "a", "b"))):
                cont.setdefault(f, []).append((np.frombuffer(a, np.uint64).astype(np.int64), np.frombuffer(x, np.int32).astype(np.int64)))
        rows = []
        for f, x in cont.items():
            word, times = _sum_by(*(np.concatenate(y) for y in zip(*x)))
            own = np.zeros(per_range[f], np.int64)
            own[word - model.offsets[f]] = times
            _save(folder, "continued", f, [_narrow(own)])
            rows.append((f, _NUMBERS, b"", b"", np.array([(own == k).sum() for k in (1, 2, 3, 4)] + [(own > 0).sum()], np.int64).tobytes()))
        if rows:
            yield _record(rows)

    def per_context(batches):
        for b in batches:
            for kind, a, x in zip(*(b.column(c).to_pylist() for c in ("kind", "a", "b"))):
                s = np.frombuffer(x, np.int64).reshape(-1, 4)
                level = pa.array(np.full(len(s), kind - _STATS, np.int32))
                yield pa.RecordBatch.from_arrays([level, pa.array(np.frombuffer(a, np.int64)), *(pa.array(np.ascontiguousarray(s[:, j])) for j in range(4))], names=["level", "key", "t", "n1", "n2", "n3"])

    words_done = table(2, -1).where(F.col("kind") == _CONT).repartition(parts, "fragment").mapInArrow(finished, schema).select("kind", "c").collect()
    stats: dict[tuple, tuple] = {}
    seen = {k: np.zeros(5, np.int64) for k in (_NUMBERS, *(_STATS + k for k in levels))}
    for level in levels:
        own = table(level, -1).where(F.col("kind") == _STATS + level)
        split = own.mapInArrow(per_context, "level int, key long, t long, n1 long, n2 long, n3 long")
        stats |= {(r.level, r.key): r[2:] for r in split.groupBy("level", "key").agg(*(F.sum(c).alias(c) for c in ("t", "n1", "n2", "n3"))).collect()}
        words_done += own.select("kind", "c").collect()  # five numbers a range
    for r in words_done:
        seen[r.kind] = seen[r.kind] + np.frombuffer(r.c, np.int64)
    _fill(spark, folder, parts, {"continued": 0} | {f"{name}{k}": columns for k in levels for name, columns in (("once", 2), ("contexts", 4), ("grams", 1))})
    model.discounts = {1: discounts(seen[_NUMBERS][:4])} | {k: discounts(seen[_STATS + k][:4]) for k in levels}
    n1, n2, *_, known = (int(x) for x in seen[_NUMBERS])
    pairs = int(seen[_STATS + 2][4])
    left = sum(d * k for d, k in zip(model.discounts[1], (n1, n2, known - n1 - n2)))
    model.bigrams, model.lower_share = pairs, left / pairs if pairs else 1.0
    model.frequent = frequent
    model.frequent_stats = {k: np.array([stats.get((k, int(x)), (0, 0, 0, 0)) for x in frequent[k].view(np.int64)], float).reshape(-1, 4) for k in levels}
    return model


def _fill(spark, folder: str, parts: int, names: dict[str, int]) -> None:
    """Empty arrays, with so many values by key, for ranges that nothing falls into."""
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(folder)
    there = {f.base_name for f in system.get_file_info(fs.FileSelector(path, allow_not_found=True))}
    none = np.zeros(0, np.uint8)
    for name, columns in names.items():
        for f in range(parts):
            if f"{name}-{f}.npy" not in there:
                if columns:
                    _save_keyed(folder, name, f, parts, np.zeros(0, np.uint64), *[none] * columns)
                else:
                    _save(folder, name, f, [none])


def score(df: DataFrame, model: KneserNey, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` of each row beside n_tokens, n_known, train_tokens, base_score and score (log10 of the text's probability).

    Rows come out one for one; a null or empty text is its end alone. The
    perplexity is ``10 ** (-score / n_tokens)``.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)  # at most 8192 contexts of each length and some numbers

    def run(batch: pa.RecordBatch) -> dict:
        got = [shared.value.score(texts) for _, texts in textkit.text_slices(batch, text, SCORE_BYTES)]
        out = {k: np.concatenate([g[k] for g in got]) for k in got[0]}
        return out | {"train_tokens": np.full(batch.num_rows, shared.value.n)}

    made = "n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return frames.arrow_map(df.select(*dict.fromkeys([*keep, text])), run, keep, made)
