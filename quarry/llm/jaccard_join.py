"""Jaccard self-join of word n-gram sets by vertical partitioning.

N-grams stand in one global order: by the number of distinct sets that hold
them, then by hash. A first pass deals all n-grams to ranges of hashes and
finds in how many sets each occurs; those of one set only are left out from
there on. A set's *prefix* is as many of its rarest n-grams as two linked sets
must share one of. The order of what is left is cut at pivots into fragments of
equal weight; each set is stored as one segment for each fragment, the overlap
of two sets is counted in each fragment apart, and the counts are summed.

Equal sets are one class throughout. Pairs of classes are first taken between
each prefix n-gram's most ordinary class and the others; what their links join
is a component already, and pairs between components follow in blocks whose
parity bitmaps rule out all but a few. Links inside the components are then
counted for blocks of classes against blocks, a matrix of partial overlaps for
each fragment, so that no group is expanded into rows of pairs and no link is
lost.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from . import frames, textkit

N, PERCENT = 5, 80
#: An n-gram in so many sets counts as common; how many more hold it changes nothing.
COMMON = 64
#: Bytes of text whose n-grams are packed together; n-grams aimed at in a range of hashes, and held by a task before common ones leave it.
GROUP_BYTES, RANGE_GRAMS, HELD_GRAMS = 4 << 20, 1 << 21, 1 << 22
#: N-grams of a task's ranges that are regrouped by class before they leave it.
EMIT = 1 << 19
#: Fragments of the global order; classes in a block of comparisons between components and within; words of a parity bitmap.
FRAGMENTS, BLOCK, WITHIN, BITS = 4, 128, 512, 64
_EMPTY = np.zeros(0, np.uint64)


def shingle_sets(texts: list[bytes], n: int = N) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's n-word runs, A-Z lower-cased; of fewer words, of all of them as one."""
    w = textkit.words(texts, lower=True)
    grams, first, out = textkit.windows(w.hash, n), w.first(), []
    for a, e in zip(first[:-1], first[1:]):
        if e - a >= n:
            out.append(np.unique(grams[a : e - n + 1]))
        else:
            out.append(textkit.windows(w.hash[a:e], e - a) if e > a else _EMPTY)
    return out


def class_key(grams: np.ndarray) -> int:
    """64 bits that stand for a set, as a signed number; of n sets, two differ unseen with a chance of about n**2 / 2**65."""
    with np.errstate(over="ignore"):
        x = np.array([textkit.mix(grams).sum(dtype=np.uint64) ^ (grams * grams).sum(dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(len(grams))], np.uint64)
    return int(textkit.mix(x).view(np.int64)[0])


def signatures(df: DataFrame, id_col: str = "doc_id", text: str = "text", n: int = N, keep: list[str] | None = None) -> DataFrame:
    """(id, n_shingles, class) of each row, after the columns ``keep`` if given; ``class`` is null for a text without words."""
    keep = [id_col] if keep is None else keep

    def run(batch: pa.RecordBatch) -> dict:
        size, key = [], []
        for _, texts in textkit.text_slices(batch, text):
            for s in shingle_sets(texts, n):
                size.append(len(s))
                key.append(class_key(s) if len(s) else None)
        return {"n_shingles": size, "class": pa.array(key, pa.int64())}

    return frames.arrow_map(df.select(*dict.fromkeys([*keep, id_col, text])), run, keep, "n_shingles long, class long")


def _low(h: np.ndarray) -> bytes:
    """The low 56 bits of each hash, packed; the number of its range holds the top bits."""
    return np.ascontiguousarray(h.view(np.uint8).reshape(-1, 8)[:, :7]).tobytes()


def _restore(data: bytes, number: int, bits: int) -> np.ndarray:
    """Hashes from their low 56 bits and the range's number: all 64 bits from 256 ranges on, 56 + ``bits`` below."""
    raw = np.frombuffer(data, np.uint8).reshape(-1, 7)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :7] = raw
    out = out.view(np.uint64).ravel()
    if bits < 8:  # the number's place overlaps nothing that is stored
        return out | np.uint64(number << (64 - bits))
    return out | np.uint64((number >> (bits - 8)) << 56)


def _runs(owner: np.ndarray, keys: np.ndarray) -> tuple[bytes, bytes]:
    """(keys, sizes) of the runs of equal owners; sizes take 2 bytes where they fit, else 4."""
    cut = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
    size = np.diff(np.append(cut, len(owner)))
    return keys[owner[cut]].tobytes(), size.astype(np.uint16 if size.max() < 1 << 16 else np.uint32).tobytes()


def _owners(keys: bytes, sizes: bytes) -> np.ndarray:
    k = np.frombuffer(keys, np.int64)
    return np.repeat(k, np.frombuffer(sizes, np.uint16 if len(sizes) == 2 * len(k) else np.uint32))


# What a row of packed n-grams holds: n-grams that are common in a group of texts, those that are not, and the sets of the former.
_HOT, _PLAIN, _PASS = 0, 1, 2


def _pack(df: DataFrame, text: str, n: int, bits: int) -> DataFrame:
    """(range, kind, keys, sizes, grams): one row for each group of texts, range of hashes and kind."""
    schema = T._parse_datatype_string("range long, kind int, keys binary, sizes binary, grams binary")
    arrow = to_arrow_schema(schema)

    def packed(groups: dict[int, np.ndarray]):
        keys = np.fromiter(groups, np.int64, len(groups))
        sizes = np.fromiter(map(len, groups.values()), np.int64, len(groups))
        h, o = np.concatenate([*groups.values(), _EMPTY]), np.repeat(np.arange(len(groups), dtype=np.int32), sizes)
        groups.clear()
        order = np.argsort(h, kind="stable")
        h, o = h[order], o[order]
        del order
        start = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
        count = np.diff(np.append(start, len(h)))
        often = np.repeat(count >= COMMON, count)
        rows = []

        def add(h: np.ndarray, o: np.ndarray, to: np.ndarray, kind: int) -> None:
            order = np.lexsort((o, to))  # stable, so hashes stay sorted in a set
            h, o, to = h[order], o[order], to[order]
            cut = np.flatnonzero(np.concatenate(([True], to[1:] != to[:-1])))
            for a, e in zip(cut, np.append(cut[1:], len(to))):
                if kind == _HOT:
                    rows.append((int(to[a]), kind, b"", b"", _low(h[a:e])))
                else:
                    rows.append((int(to[a]), kind, *_runs(o[a:e], keys), _low(h[a:e]) if kind == _PLAIN else h[a:e].tobytes()))

        range_of = (h >> np.uint64(64 - bits)).astype(np.int64)
        if not often.all():
            add(h[~often], o[~often], range_of[~often], _PLAIN)
        if often.any():
            s = start[count >= COMMON]
            add(h[s], o[s], range_of[s], _HOT)
            # The sets of common n-grams go to any range, so that none gets a set's worth of them from every text.
            add(h[often], o[often], (range_of[often] + o[often]) % (1 << bits), _PASS)
        return pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*rows), arrow)], schema=arrow)

    def run(batches):
        groups, size = {}, 0
        for batch in batches:
            for _, texts in textkit.text_slices(batch, text):
                for s in shingle_sets(texts, n):
                    if len(s):
                        groups.setdefault(class_key(s), s)
                size += sum(map(len, texts))
                if size >= GROUP_BYTES:
                    if groups:
                        yield packed(groups)
                    groups, size = {}, 0
        if groups:
            yield packed(groups)
        frames.release()

    frames.bound_batches(df.sparkSession)
    return df.select(text).mapInArrow(run, schema)


class _Range:
    """Finds in one range of hashes the n-grams of two sets or more, row by row.

    Common n-grams leave as soon as they are known to be common, so what is
    held is bounded by COMMON sets for each distinct n-gram of the range.
    """

    def __init__(self, number: int, bits: int):
        self.number, self.bits, self.hot = number, bits, _EMPTY
        self.own, self.gram, self.new, self.size, self.limit = [], [], 0, 0, HELD_GRAMS

    def add(self, kind: int, keys: bytes, sizes: bytes, grams: bytes):
        """What leaves at once, as (class, n-gram, weight)."""
        if kind == _HOT:
            self.hot = np.union1d(self.hot, _restore(grams, self.number, self.bits))
            return None
        own = _owners(keys, sizes)
        if kind == _PASS:
            gram = np.frombuffer(grams, np.uint64)
            if self.bits < 8:  # as the other rows restore them
                gram = gram & np.uint64((1 << 56) - 1) | gram >> np.uint64(64 - self.bits) << np.uint64(64 - self.bits)
            return own, gram, np.full(len(gram), COMMON, np.uint8)
        gram = _restore(grams, self.number, self.bits)
        out = None
        if len(self.hot):
            at = np.minimum(np.searchsorted(self.hot, gram), len(self.hot) - 1)
            hit = self.hot[at] == gram
            out = own[hit], gram[hit], np.full(int(hit.sum()), COMMON, np.uint8)
            own, gram = own[~hit], gram[~hit]
        self.own.append(own)
        self.gram.append(gram)
        self.size += len(own)
        return out

    def settle(self, last: bool):
        """Merges what is held; returns what leaves: common n-grams, at the end all that two sets hold."""
        own, gram = np.concatenate([*self.own, np.zeros(0, np.int64)]), np.concatenate([*self.gram, _EMPTY])
        self.own, self.gram = [], []
        order = np.lexsort((own, gram))
        own, gram = own[order], gram[order]
        del order
        new = np.concatenate(([True], (gram[1:] != gram[:-1]) | (own[1:] != own[:-1])))[: len(own)]
        own, gram = own[new], gram[new]
        start = np.flatnonzero(np.concatenate(([True], gram[1:] != gram[:-1]))[: len(gram)])
        sets = np.diff(np.append(start, len(gram)))
        weight = np.repeat(np.minimum(sets, COMMON), sets).astype(np.uint8)
        if last:
            keep = weight >= 2
            return own[keep], gram[keep], weight[keep]
        leave = weight == COMMON
        self.hot = np.union1d(self.hot, gram[start[sets >= COMMON]])
        self.own, self.gram, self.size = [own[~leave]], [gram[~leave]], int((~leave).sum())
        self.limit = max(HELD_GRAMS, 2 * self.size)
        return own[leave], gram[leave], weight[leave]


def shared_grams(df: DataFrame, text: str = "text", n: int = N, total: int | None = None) -> DataFrame:
    """(class, items): of each set with any, the n-grams that other sets hold as well.

    ``items`` packs the n-grams, 8 bytes each, and behind them in how many sets
    each occurs, as far as COMMON, 1 byte each. An n-gram may stand there twice.
    ``total`` is the number of n-grams of all texts, from which the number of
    ranges follows.
    """
    if total is None:
        total = signatures(df.select(F.lit(0).alias("__id"), text), "__id", text, n).agg(F.sum("n_shingles")).first()[0] or 0
    bits = max(1, int(np.ceil(np.log2(max(2, total / RANGE_GRAMS)))))
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), (1 << bits) // 4)
    piece = T._parse_datatype_string("bucket int, keys binary, sizes binary, grams binary, weights binary")
    whole = T._parse_datatype_string("class long, items binary")
    piece_arrow, whole_arrow = to_arrow_schema(piece), to_arrow_schema(whole)

    def emit(made):
        """What a task found, one row for each bucket of classes."""
        own, gram, weight = (np.concatenate(x) for x in zip(*made))
        made.clear()
        bucket = (own.view(np.uint64) % np.uint64(parts)).astype(np.int32)
        order = np.lexsort((own, bucket))
        own, gram, weight, bucket = own[order], gram[order], weight[order], bucket[order]
        del order
        start = np.flatnonzero(np.diff(bucket, prepend=-1))
        rows = []
        for a, e in zip(start, np.append(start[1:], len(own))):
            cut = np.flatnonzero(np.concatenate(([True], own[a:e][1:] != own[a:e][:-1])))
            size = np.diff(np.append(cut, e - a))
            rows.append((int(bucket[a]), own[a:e][cut].tobytes(), size.astype(np.uint32).tobytes(), gram[a:e].tobytes(), weight[a:e].tobytes()))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*rows), piece_arrow)], schema=piece_arrow)

    def run(batches):
        held, made, size = None, [], 0
        for batch in batches:
            for i in range(batch.num_rows):
                at, *row = (c[i].as_py() for c in batch.columns)
                if held is None or at != held.number:
                    if held is not None:
                        made.append(held.settle(True))
                    held = _Range(at, bits)
                made.append(held.add(*row))
                if held.size > held.limit:
                    made.append(held.settle(False))
                made = [x for x in made if x is not None and len(x[0])]
                size = sum(len(x[0]) for x in made)
                if size >= EMIT:
                    yield from emit(made)
        if held is not None:
            made.append(held.settle(True))
        made = [x for x in made if len(x[0])]
        if made:
            yield from emit(made)
        frames.release()

    def gather(batches):
        """Of each bucket's rows, one row for each class."""
        for _, rows in frames.runs_of(batches):
            keys, sizes, grams, weights = ([np.frombuffer(x, t) for x in col] for col, t in zip(zip(*rows), (np.int64, np.uint32, np.uint64, np.uint8)))
            own, gram, weight = np.concatenate([np.repeat(k, c) for k, c in zip(keys, sizes)]), np.concatenate(grams), np.concatenate(weights)
            rows.clear()
            order = np.argsort(own, kind="stable")
            own, gram, weight = own[order], gram[order], weight[order]
            cut = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
            end = np.append(cut[1:], len(own))
            for i in range(0, len(cut), 1024):
                a, e = cut[i : i + 1024], end[i : i + 1024]
                items = [gram[x:y].tobytes() + weight[x:y].tobytes() for x, y in zip(a, e)]
                yield pa.RecordBatch.from_arrays([pa.array(own[a]), pa.array(items, pa.binary())], schema=whole_arrow)
        frames.release()

    packed = _pack(df, text, n, bits).repartition(parts, "range").sortWithinPartitions("range", "kind")
    pieces = packed.mapInArrow(run, piece).repartition(parts, "bucket").sortWithinPartitions("bucket")
    return pieces.mapInArrow(gather, whole)


def _profiles(gathered: DataFrame, sizes: DataFrame) -> DataFrame:
    """Of each class that can have a link: its size, shared n-grams in the global order with their weights, prefix, and parity bitmap."""
    out = "n int, ordinary double, grams binary, weights binary, prefix array<long>, bitmap binary"

    def run(batch: pa.RecordBatch) -> dict:
        names = batch.schema.names
        made = {k: [] for k in ("n", "ordinary", "grams", "weights", "prefix", "bitmap")}
        for items, n in zip(batch.column(names.index("items")).to_pylist(), batch.column(names.index("n_shingles")).to_pylist()):
            gram, weight = np.frombuffer(items, np.uint64, len(items) // 9), np.frombuffer(items, np.uint8, offset=len(items) // 9 * 8)
            gram, at = np.unique(gram, return_index=True)
            weight = weight[at]
            order = np.lexsort((gram, weight))
            gram, weight = gram[order], weight[order]
            longest = n - -(-PERCENT * n // 100) + 1
            own = gram[: max(0, longest - (n - len(gram)))]
            made["n"].append(n)
            made["prefix"].append(own.view(np.int64))
            if not len(own):
                for k, x in (("ordinary", 0.0), ("grams", b""), ("weights", b""), ("bitmap", b"")):
                    made[k].append(x)
                continue
            bits = np.bincount((textkit.mix(gram) % np.uint64(64 * BITS)).astype(np.int64), minlength=64 * BITS) & 1
            made["ordinary"].append(float(np.log2(weight).sum()) / n)
            made["grams"].append(gram.tobytes())
            made["weights"].append(weight.tobytes())
            made["bitmap"].append(np.packbits(bits.astype(np.uint8)).tobytes())
        kinds = {"prefix": pa.list_(pa.int64()), "n": pa.int32(), "ordinary": pa.float64()}
        return {k: pa.array(v, kinds.get(k, pa.binary())) for k, v in made.items()}

    joined = gathered.join(sizes, "class").select("class", "items", "n_shingles")
    return frames.arrow_map(joined, run, ["class"], out).where(F.size("prefix") > 0)


def pivots(profiles: DataFrame, fragments: int = FRAGMENTS) -> list[tuple[int, int]]:
    """Places (weight, hash) at which the global order falls into ``fragments`` of about equal numbers of postings."""

    def count(batches):
        for batch in batches:
            n = np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint8), minlength=COMMON + 1)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(COMMON + 1), pa.int32()), pa.array(n, pa.int64())], names=["weight", "n"])

    held = profiles.select("weights").mapInArrow(count, "weight int, n long").groupBy("weight").agg(F.sum("n").alias("n")).collect()  # COMMON rows
    n = np.zeros(COMMON + 1)
    for r in held:
        n[r.weight] = r.n
    upto, out = np.cumsum(n), []
    for j in range(1, fragments):
        at = upto[-1] * j / fragments
        w = int(np.searchsorted(upto, at, side="right"))
        if w <= COMMON and n[w]:
            out.append((w, min((1 << 64) - 1, int((at - (upto[w] - n[w])) / n[w] * 2.0**64))))
    return out


def segments(profiles: DataFrame, cuts: list[tuple[int, int]]) -> DataFrame:
    """(class, n, f, g): each class's shared n-grams in fragment f of the order, as sorted 8-byte hashes; empty ones too."""
    schema = T._parse_datatype_string("class long, n int, f int, g binary")
    arrow = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            rows = []
            for key, n, grams, weights in zip(*(c.to_pylist() for c in batch.columns)):
                gram, weight = np.frombuffer(grams, np.uint64), np.frombuffer(weights, np.uint8)
                f = np.zeros(len(gram), np.int64)
                for w, h in cuts:
                    f += (weight > w) | (weight == w) & (gram >= np.uint64(h))
                rows += [(key, n, j, np.sort(gram[f == j]).tobytes()) for j in range(len(cuts) + 1)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*rows), arrow)], schema=arrow)

    return profiles.select("class", "n", "grams", "weights").mapInArrow(run, schema)


def overlaps(pairs: DataFrame, segs: DataFrame) -> DataFrame:
    """``pairs(x, y)`` with their sizes and ``overlap``: counted in each fragment of the order and summed per pair."""
    left = pairs.join(segs.select(F.col("class").alias("x"), F.col("n").alias("nx"), "f", F.col("g").alias("gx")), "x")
    both = left.join(segs.select(F.col("class").alias("y"), F.col("n").alias("ny"), "f", F.col("g").alias("gy")), ["y", "f"])

    def run(batch: pa.RecordBatch) -> dict:
        names = batch.schema.names
        gx, gy = (batch.column(names.index(c)).to_pylist() for c in ("gx", "gy"))
        return {"o": [len(np.intersect1d(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64), assume_unique=True)) for a, b in zip(gx, gy)]}

    part = frames.arrow_map(both, run, ["x", "y", "nx", "ny"], "o long")
    return part.groupBy("x", "y", "nx", "ny").agg(F.sum("o").alias("overlap"))


def _linked(pairs: DataFrame, segs: DataFrame) -> DataFrame:
    o = overlaps(pairs, segs)
    return o.where(100 * F.col("overlap") >= PERCENT * (F.col("nx") + F.col("ny") - F.col("overlap"))).select(F.col("x").alias("a"), F.col("y").alias("b"))


def _rest(posts: DataFrame) -> DataFrame:
    """Pairs of one prefix n-gram's classes in different components that sizes and bitmaps leave possible.

    ``posts``: (gram, class, n, comp, shared, bitmap) of n-grams with two components or
    more. A long list is cut into blocks, and each two blocks meet in a row. A
    component with a block's worth of a list or more has blocks of its own,
    which do not meet each other; the other components share blocks.
    """
    big, key = F.col("cnt") >= BLOCK, ["gram", "big", "team"]
    each = frames.with_totals(posts, ["gram", "comp"], "cnt", "class")
    each = each.withColumn("big", big).withColumn("team", F.when(big, F.col("comp")).otherwise(F.lit(0)))
    chunk = (
        frames.with_totals(each, key, "len", "class").groupBy(*key, F.pmod(F.xxhash64("class"), F.ceil(F.col("len") / BLOCK)).cast("int").alias("c"))
        .agg(F.collect_list(F.struct("class", "n", "comp", "shared", "bitmap")).alias("m"))
    )
    chunk = frames.written(chunk.select("gram", "big", "team", F.monotonically_increasing_id().alias("at"), "m"), "blocks")
    one, two = chunk.select("gram", "at", "big", "team"), chunk.select("gram", F.col("at").alias("at2"), F.col("big").alias("big2"), F.col("team").alias("team2"))
    met = one.join(two, "gram").where("at <= at2 and not (big and big2 and team = team2)").select("at", "at2")
    met = met.join(chunk.select("at", "m"), "at").join(chunk.select(F.col("at").alias("at2"), F.col("m").alias("m2")), "at2").select("m", "m2")
    schema = T._parse_datatype_string("x long, y long")
    arrow = to_arrow_schema(schema)

    def arrays(m):
        cols = [np.array([r[k] for r in m], np.int64) for k in ("class", "n", "comp", "shared")]
        return [*cols, np.frombuffer(b"".join(r["bitmap"] for r in m), np.uint64).reshape(len(m), BITS)]

    def run(batches):
        for batch in batches:
            xs, ys = [_z], [_z]
            for m, m2 in zip(batch.column(0), batch.column(1)):
                cls, n, comp, held, bits = arrays(m.as_py())
                cls2, n2, comp2, held2, bits2 = arrays(m2.as_py())
                for i in range(len(cls)):
                    differ = np.bitwise_count(bits2 ^ bits[i]).sum(1)
                    # Of the n-grams that other sets hold, x and y share at most (|x| + |y| - differing) / 2.
                    most = np.minimum(np.minimum(held[i], held2), (held[i] + held2 - differ) // 2)
                    ok = (comp[i] != comp2) & (100 * most >= PERCENT * (n[i] + n2 - most))
                    xs.append(np.minimum(cls[i], cls2[ok]))
                    ys.append(np.maximum(cls[i], cls2[ok]))
            pair = np.unique(np.stack([np.concatenate(xs), np.concatenate(ys)], 1), axis=0) if sum(map(len, xs)) else np.zeros((0, 2), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pair[:, 0]), pa.int64()), pa.array(np.ascontiguousarray(pair[:, 1]), pa.int64())], schema=arrow)

    _z = np.zeros(0, np.int64)
    return met.mapInArrow(run, schema).distinct()


def _partial(a: list[bytes], b: list[bytes], out: np.ndarray) -> None:
    """Adds to ``out`` how many n-grams of one fragment each set of ``a`` shares with each of ``b``."""
    ga, gb = np.frombuffer(b"".join(a), np.uint64), np.frombuffer(b"".join(b), np.uint64)
    common = np.intersect1d(np.unique(ga), np.unique(gb), assume_unique=True)
    if not len(common):
        return
    placed = []
    for rows, g in ((a, ga), (b, gb)):
        own = np.repeat(np.arange(len(rows)), [len(x) // 8 for x in rows])
        at = np.minimum(np.searchsorted(common, g), len(common) - 1)
        hit = common[at] == g
        placed.append((own[hit], at[hit]))
    for lo in range(0, len(common), 4096):
        m = []
        for (own, at), rows in zip(placed, (a, b)):
            x = np.zeros((len(rows), min(4096, len(common) - lo)), np.float32)
            use = (at >= lo) & (at < lo + 4096)
            x[own[use], at[use] - lo] = 1
            m.append(x)
        out += m[0] @ m[1].T


def count_links(members: DataFrame, segs: DataFrame) -> DataFrame:
    """(class, n_linked): to how many rows of other classes each class of ``members(class, component, copies)`` links.

    Links stay inside components. A component's classes are dealt into cells by
    the logarithm of their size, base 1.25, so that linked ones are in the same
    or neighbouring cells, and cells into blocks. Of two blocks, each fragment
    gives a matrix of partial overlaps; a task adds the matrices of a pair of
    blocks, which reach it one after the other, and holds one such sum.
    """
    sized = segs.where("f = 0").select("class", F.floor(F.log(1.25, "n") + 1e-9).cast("int").alias("cell"))
    placed = members.join(sized, "class")
    cells = placed.groupBy("component", "cell").agg(F.ceil(F.count("*") / WITHIN).cast("int").alias("k"))
    dealt = placed.join(cells, ["component", "cell"]).withColumn("c", F.pmod(F.xxhash64("class"), F.col("k")).cast("int"))
    item = F.struct("class", "n", "copies", "g")
    blocks = frames.written(dealt.join(segs, "class").groupBy("component", "cell", "c", "f").agg(F.sort_array(F.collect_list(item)).alias("m")), "blocks")
    one = cells.withColumn("c", F.explode(F.sequence(F.lit(0), F.col("k") - 1))).select("component", "cell", "c", F.explode(F.array("cell", F.col("cell") + 1)).alias("cell2"))
    two = cells.withColumn("c2", F.explode(F.sequence(F.lit(0), F.col("k") - 1))).select("component", F.col("cell").alias("cell2"), "c2")
    pairs = one.join(two, ["component", "cell2"]).where("cell < cell2 or c <= c2")
    met = pairs.join(blocks, ["component", "cell", "c"])
    met = met.join(blocks.select("component", F.col("cell").alias("cell2"), F.col("c").alias("c2"), "f", F.col("m").alias("m2")), ["component", "cell2", "c2", "f"])
    key = F.concat_ws(":", "component", "cell", "c", "cell2", "c2")
    parts = int(segs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = met.select(key.alias("at"), "f", "m", "m2").repartition(parts, "at").sortWithinPartitions("at", "f")
    schema = T._parse_datatype_string("class long, n_linked long")
    arrow = to_arrow_schema(schema)

    def column(m, name):
        return np.array([x[name] for x in m], np.int64)

    def finish(m, m2, o, same):
        n, n2 = column(m, "n"), column(m2, "n")
        ok = 100 * o >= PERCENT * (n[:, None] + n2[None, :] - o)
        if same:
            np.fill_diagonal(ok, False)
        ids, count = column(m, "class"), ok @ column(m2, "copies")
        if not same:
            ids, count = np.append(ids, column(m2, "class")), np.append(count, ok.T @ column(m, "copies"))
        return pa.RecordBatch.from_arrays([pa.array(ids[count > 0]), pa.array(count[count > 0], pa.int64())], schema=arrow)

    def run(batches):
        at, held = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                key, _, m, m2 = (c[i].as_py() for c in batch.columns)
                if key != at:
                    if held:
                        yield finish(*held)
                    at = key
                    held = m, m2, np.zeros((len(m), len(m2)), np.float32), key.split(":")[1:3] == key.split(":")[3:]
                _partial([x["g"] for x in m], [x["g"] for x in m2], held[2])
        if held:
            yield finish(*held)
        frames.release()

    return met.mapInArrow(run, schema).groupBy("class").agg(F.sum("n_linked").alias("n_linked"))


def links(df: DataFrame, text: str = "text", n: int = N, sig: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(links, components, segments): links (a, b) between classes, whose components are those of all links, (class, component) of linked classes, and the classes' segments."""
    if sig is None:
        sig = frames.written(signatures(df.select(F.lit(0).alias("__id"), text), "__id", text, n), "signatures")
    total = sig.agg(F.sum("n_shingles")).first()[0] or 0
    sizes = sig.where("class is not null").groupBy("class").agg(F.min("n_shingles").alias("n_shingles"))
    profiles = frames.written(_profiles(shared_grams(df, text, n, total), sizes), "profiles")
    segs = frames.written(segments(profiles, pivots(profiles)), "segments")
    posts = profiles.select(F.explode("prefix").alias("gram"), "class", "n", "ordinary")
    # Two parts of every list of two or more: its most ordinary class and each other class.
    heads = posts.groupBy("gram").agg(F.max(F.struct("ordinary", (-F.col("class")).alias("minus"), "n")).alias("h"), F.count("*").alias("len")).where("len > 1").select("gram", (-F.col("h.minus")).alias("head"), F.col("h.n").alias("nh"))
    small, large = F.least("n", "nh"), F.greatest("n", "nh")
    met = posts.select("gram", "class", "n").join(heads, "gram").where((F.col("class") != F.col("head")) & (100 * small >= PERCENT * large))
    pairs = met.select(F.least("class", "head").alias("x"), F.greatest("class", "head").alias("y")).distinct()
    first = frames.written(_linked(pairs, segs), "links")
    comps = frames.components(first)
    placed = posts.join(comps, posts["class"] == comps["id"], "left").select("gram", "class", "n", F.coalesce("component", "class").alias("comp"))
    placed = frames.written(placed, "posts")
    open_lists = placed.groupBy("gram").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("gram")
    unsettled = placed.join(open_lists, "gram", "left_semi").join(profiles.select("class", F.floor(F.length("grams") / 8).alias("shared"), "bitmap"), "class")
    second = frames.written(_linked(_rest(unsettled), segs), "links")
    every = first.union(second)
    return every, frames.written(frames.components(every), "components"), segs


def membership(df: DataFrame, id_col: str = "doc_id", text: str = "text", n: int = N, sig: DataFrame | None = None) -> DataFrame:
    """(id, n_shingles, class, component_id, n_links) of each row of ``df``.

    component_id is the smallest id that the row reaches by links, n_links the
    number of other rows that it is linked with. Texts that are null or have no
    words have an empty set and are linked with nothing, not even each other.
    Repeated rows, and repeated ids, are rows of their own: equal texts are
    linked. An id that is null counts after all others. An empty table gives an
    empty result. ``sig``, if given, is the written result of ``signatures``.
    """
    sig = frames.written(signatures(df, id_col, text, n), "signatures") if sig is None else sig
    _, comps, segs = links(df, text, n, sig)
    by_class = sig.where("class is not null").groupBy("class").agg(F.min(id_col).alias("least"), F.count("*").alias("copies"))
    linked = count_links(by_class.join(comps, by_class["class"] == comps["id"]).select("class", "component", "copies"), segs)
    placed = by_class.join(comps, by_class["class"] == comps["id"], "left").select("class", "least", "copies", F.coalesce("component", "class").alias("comp"))
    least = placed.groupBy("comp").agg(F.min("least").alias("component_id"))
    named = placed.join(least, "comp").join(linked, "class", "left")
    named = named.select(F.col("class").alias("__class"), "component_id", (F.coalesce("n_linked", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = sig.join(named, sig["class"] == named["__class"], "left")
    return out.select(id_col, "n_shingles", "class", F.coalesce("component_id", id_col).alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def winners(sig: DataFrame, comps: DataFrame, id_col: str) -> DataFrame:
    """(id, class) of the row that stays of each component: the one with the smallest id, then the smallest class; a null id is the last."""
    by_class = sig.where("class is not null").groupBy("class").agg(F.min(id_col).alias("least"))
    placed = by_class.join(comps, by_class["class"] == comps["id"], "left").select("class", "least", F.coalesce("component", "class").alias("comp"))
    first = placed.groupBy("comp").agg(F.min(F.struct(F.col("least").isNull().alias("none"), "least", "class")).alias("w"))
    return first.select(F.col("w.least").alias(id_col), F.col("w.class").alias("class"))
