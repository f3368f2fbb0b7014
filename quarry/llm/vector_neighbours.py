"""Near-duplicate embeddings by NN-descent.

Equal vectors are one class. Random sign codes give first neighbour lists;
then lists are refined by neighbours-of-neighbours joins: every class is sent,
with its vector, to the classes on whose list it stands and to those on its
own, and all that meet there are compared. Pairs at the threshold leave the
join as links. Where lists are saturated (every entry at the threshold), they
are enlarged to the whole component that the links reach, block by block.
Every label is audited: classes are drawn until enough of them have a true
link, and the share of links found is taken for each of these and averaged, so
a large group weighs no more than its queries. Further rounds follow for labels
where it is too low. Small labels, those where links are too rare for an audit
and those that the rounds leave too low are compared exactly, in blocks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from . import frames

THRESHOLD = 0.93
#: Neighbours on a list; classes compared in one block; sign codes of a round; descents of a round; rounds at most.
NEIGHBOURS, BLOCK, TREES, DESCENTS, ROUNDS = 6, 256, 3, 2, 4
#: Classes with a true link that an audit needs of each label, and the mean recall of theirs below which another round follows.
AUDIT_LINKED, AUDIT_RECALL = 64, 0.98
#: Classes of a label that are compared exactly at once; the share of a label's classes that an audit asks at most; queries broadcast at once.
SMALL, AUDIT_SHARE, AUDIT_BATCH = 2 * BLOCK, 1 / 8, 4096
#: How many times as long as at first a saturated list grows.
ENLARGED = 4
_SPREAD = 1 << 40


def _schema(ddl: str):
    s = T._parse_datatype_string(ddl)
    return s, to_arrow_schema(s)


def unit_vectors(df: DataFrame, id_col: str, vector: str, label: str) -> DataFrame:
    """(id, label, unit) with the vector scaled to length 1 as bytes of doubles; null where it can link with nothing."""

    def run(batch: pa.RecordBatch) -> dict:
        out = []
        for x in batch.column(batch.schema.get_field_index(vector)):
            v = None if not x.is_valid or x.values.null_count else x.values.to_numpy(zero_copy_only=False).astype(np.float64)
            big = np.abs(v).max(initial=0.0) if v is not None else 0.0
            if not 0 < big < np.inf:
                out.append(None)
            else:
                v = v / big
                out.append((v / np.sqrt(v @ v)).tobytes())
        return {"__unit": pa.array(out, pa.binary())}

    cols = df.select(F.col(id_col).alias("__id"), F.col(label).alias("__label"), F.col(vector).alias(vector))
    made = frames.arrow_map(cols, run, ["__id", "__label"], "__unit binary")
    return made.select(F.col("__id").alias("id"), F.col("__label").alias("label"), F.when(F.col("__label").isNotNull(), F.col("__unit")).alias("unit"))


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _stars(linked: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of a symmetric truth matrix, an edge from each member of a component to the component's first."""
    n = len(ids)
    part = np.arange(n)
    while True:
        new = np.minimum(part, np.where(linked, part[None, :], n).min(1, initial=n))
        new = new[new]
        if (new == part).all():
            break
        part = new
    far = part != np.arange(n)
    return ids[far], ids[part[far]]


_LISTS = "id long, nbrs array<long>, sims array<float>"


def _compare(df: DataFrame, k: int, threshold: float) -> DataFrame:
    """Of rows ``members array<struct<id, unit>>``: each member's ``k`` nearest in its row, and links as lists with no sims."""
    schema, arrow = _schema(_LISTS)

    def run(batches):
        for batch in batches:
            rows: list = []
            for m in batch.column(0).to_pylist():
                ids, where = np.unique(np.array([x["id"] for x in m], np.int64), return_index=True)
                if len(ids) < 2:
                    continue
                v = _matrix([m[i]["unit"] for i in where]).astype(np.float32)
                s = v @ v.T
                np.fill_diagonal(s, -2)
                a, b = _stars(s >= threshold - 1e-4, ids)
                rows += [(int(x), [int(y)], None) for x, y in zip(a, b)]
                kk = min(k, len(ids) - 1)
                near = np.argpartition(-s, kk - 1, axis=1)[:, :kk]
                sim = np.take_along_axis(s, near, 1)
                rows += [(i, n, x) for i, n, x in zip(ids.tolist(), ids[near].tolist(), sim.tolist())]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*rows), arrow)], schema=arrow)

    return df.select("members").mapInArrow(run, schema)


def _merge(lists: DataFrame, k: int, threshold: float) -> DataFrame:
    """One list of the nearest per id: ``k``, or twice those at the threshold if these fill it, ENLARGED * ``k`` at most; the components' blocks compare what a longer list would hold. Equal similarities go by the smaller id."""
    each = lists.where("sims is not null").select("id", F.explode(F.arrays_zip("sims", "nbrs")).alias("z")).groupBy("id", F.col("z.nbrs").alias("n")).agg(F.max("z.sims").alias("s"))
    near = each.groupBy("id").agg(F.sort_array(F.collect_list(F.struct((-F.col("s")).alias("d"), "n"))).alias("t"))
    full = 2 * F.size(F.filter("t", lambda x: x["d"] <= -threshold))
    top = near.select("id", F.slice("t", F.lit(1), F.greatest(F.lit(k), F.least(full, F.lit(ENLARGED * k)))).alias("t"))
    return top.select("id", F.col("t.n").alias("nbrs"), F.transform("t.d", lambda x: -x).alias("sims"))


def _first_lists(classes: DataFrame, per_label: dict, seed: int, dims: int, k: int, threshold: float) -> DataFrame:
    """Lists from sign codes: in each label, code bits enough for about half a block a code; larger codes are dealt into blocks."""
    rng = np.random.default_rng(seed)
    planes = rng.standard_normal((TREES, 24, dims)).astype(np.float32)
    bits = {label: int(min(24, max(0, np.ceil(np.log2(max(1, 2 * n / BLOCK)))))) for label, n in per_label.items()}
    shared = classes.sparkSession.sparkContext.broadcast((planes, bits))  # labels seen, and planes of a fixed number

    def run(batch: pa.RecordBatch) -> dict:
        planes, bits = shared.value
        v = _matrix(batch.column(batch.schema.get_field_index("unit")).to_pylist()).astype(np.float32)
        labels = batch.column(batch.schema.get_field_index("label")).to_pylist()
        mask = np.array([(1 << bits[x]) - 1 for x in labels], np.int64)
        codes = np.stack([((v @ p.T > 0) @ (1 << np.arange(24, dtype=np.int64))) & mask for p in planes], 1)
        return {"codes": pa.array(codes.tolist(), pa.list_(pa.int64()))}

    coded = frames.arrow_map(classes, run, ["id", "label", "unit"], "codes array<long>").select("id", "label", "unit", F.posexplode("codes").alias("tree", "code"))
    key = ["label", "tree", "code"]
    salted = frames.with_totals(coded, key, "cnt", "id").withColumn("salt", F.pmod(F.xxhash64("id", F.lit(seed)), F.ceil(F.col("cnt") / BLOCK)))
    blocks = salted.groupBy(*key, "salt").agg(F.collect_list(F.struct("id", "unit")).alias("members"))
    return _compare(blocks, k, threshold)


def _descend(lists: DataFrame, classes: DataFrame, k: int, threshold: float) -> DataFrame:
    """One neighbours-of-neighbours join: what stands on a list, or has the list's owner on its own, meets there."""
    edges = lists.select("id", F.explode("nbrs").alias("n"))
    meet = edges.select(F.col("id").alias("at"), F.col("n").alias("id")).union(edges.select(F.col("n").alias("at"), "id")).union(lists.select(F.col("id").alias("at"), "id")).distinct()
    meet = frames.with_totals(meet, ["at"], "cnt", "id").withColumn("salt", F.pmod(F.xxhash64("id"), F.ceil(F.col("cnt") / BLOCK)))
    with_vectors = meet.join(classes.select("id", "unit"), "id")
    return _compare(with_vectors.groupBy("at", "salt").agg(F.collect_list(F.struct("id", "unit")).alias("members")), k, threshold)


def _within(members: DataFrame, threshold: float) -> DataFrame:
    """All links inside components, in double precision: (id, n, other), each row a count of linked vectors and one class to join."""
    schema, arrow = _schema("id long, n long, other long")
    counts = members.groupBy("component").agg(F.count("*").alias("cnt"))
    dealt = members.join(counts, "component").withColumn("k", F.ceil(F.col("cnt") / BLOCK).cast("int")).withColumn("c", F.pmod(F.xxhash64("id"), F.col("k")).cast("int"))
    blocks = dealt.groupBy("component", "k", "c").agg(F.collect_list(F.struct("id", "copies", "unit")).alias("m"))
    # Blocks stand in the join by number; the vectors follow each block of a pair.
    pairs = blocks.withColumn("d", F.explode(F.sequence(F.col("c"), F.col("k") - 1))).select("component", "c", "d", "m")
    met = pairs.join(blocks.select("component", F.col("c").alias("d"), F.col("m").alias("m2")), ["component", "d"]).select("c", "d", "m", "m2")

    def run(batches):
        for batch in batches:
            for c, d, m, m2 in zip(*(x.to_pylist() for x in batch.columns)):
                a, b = (np.array([x["id"] for x in y], np.int64) for y in (m, m2))
                ca, cb = (np.array([x["copies"] for x in y], np.int64) for y in (m, m2))
                s = _matrix([x["unit"] for x in m]) @ _matrix([x["unit"] for x in m2]).T >= threshold
                if c == d:
                    np.fill_diagonal(s, False)
                    ids, n, ok = a, s @ cb, s
                else:
                    ids, n = np.concatenate([a, b]), np.concatenate([s @ cb, s.T @ ca])
                    ok = np.block([[np.zeros((len(a), len(a)), bool), s], [s.T, np.zeros((len(b), len(b)), bool)]])
                x, y = _stars(ok, ids)
                other = dict(zip(x.tolist(), y.tolist()))
                keep = n > 0
                ids, n = ids[keep], n[keep]
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(n), pa.array([other.get(i, i) for i in ids.tolist()], pa.int64())], schema=arrow)

    return met.mapInArrow(run, schema)


def _drawn(classes: DataFrame, ranges: dict, ids: set | None = None) -> list:
    """Classes whose id hash lies in their label's range, with their components; with ``ids``, of these only."""
    names = classes.schema.names

    def run(batches):
        for batch in batches:
            col = [batch.column(names.index(n)).to_pylist() for n in ("label", "draw", "id")]
            keep = [x in ranges and ranges[x][0] <= d < ranges[x][1] and (ids is None or i in ids) for x, d, i in zip(*col)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return classes.mapInArrow(run, classes.schema).collect()


def _asked(classes: DataFrame, queries: list, threshold: float) -> dict:
    """Of each query with a true link: its label, its links, and those of them in its own component."""
    by_label: dict = {}
    for r in queries:
        by_label.setdefault(r.label, []).append((r.id, -2 if r.component is None else r.component, bool(r.component is None), r.unit))
    packed = {x: (np.array([q[0] for q in y]), np.array([q[1] for q in y]), np.array([q[2] for q in y]), b"".join(q[3] for q in y)) for x, y in by_label.items()}
    shared = classes.sparkSession.sparkContext.broadcast(packed)
    names = classes.schema.names
    schema, arrow = _schema("id long, truth long, found long")

    def run(batches):
        held = {}
        for batch in batches:
            col = {n: batch.column(names.index(n)) for n in ("label", "id", "component", "unit")}
            labels = np.array(col["label"].to_pylist(), object)
            for x in set(labels.tolist()) & shared.value.keys():
                ids, comps, alone, q = shared.value[x]
                at = np.flatnonzero(labels == x)
                part = {n: col[n].take(pa.array(at)) for n in ("id", "component", "unit")}
                s = _matrix(part["unit"].to_pylist()) @ np.frombuffer(q, np.float64).reshape(len(ids), -1).T >= threshold
                s &= part["id"].to_numpy()[:, None] != ids[None, :]
                none = part["component"].is_null().to_numpy(zero_copy_only=False)
                same = (part["component"].fill_null(0).to_numpy()[:, None] == comps[None, :]) & ~none[:, None] & ~alone[None, :]
                n = np.stack([s.sum(0), (s & same).sum(0)])
                held[x] = held[x] + n if x in held else n
        for x, n in held.items():
            keep = n[0] > 0
            yield pa.RecordBatch.from_arrays([pa.array(shared.value[x][0][keep], pa.int64()), pa.array(n[0][keep], pa.int64()), pa.array(n[1][keep], pa.int64())], schema=arrow)

    sums = classes.mapInArrow(run, schema).groupBy("id").agg(F.sum("truth").alias("truth"), F.sum("found").alias("found")).collect()
    shared.destroy()
    label = {r.id: r.label for r in queries}
    return {r.id: (label[r.id], r.truth, r.found) for r in sums}


def audit(classes: DataFrame, linked: DataFrame, threshold: float, per_label: dict, known: dict) -> dict:
    """By label, the mean over classes with a true link of the share of their exact links that join one of ``linked``'s components.

    Classes are drawn by their ids' hashes, more and more of them until
    AUDIT_LINKED of a label have a link; None for labels where AUDIT_SHARE of
    all classes do not suffice. ``known`` keeps the linked classes of each
    label, which later audits ask again.
    """
    placed = classes.join(linked.select("id", "component"), "id", "left").withColumn("draw", F.pmod(F.xxhash64("id"), F.lit(_SPREAD)))
    recall: dict = {}
    done: dict = {x: [] for x in per_label}
    again = {x for x in per_label if x in known}
    old = sorted((i, x) for x in again for i in known[x])
    for at in range(0, len(old), AUDIT_BATCH):
        part = old[at : at + AUDIT_BATCH]
        for x, truth, found in _asked(placed, _drawn(placed, {x: (0, _SPREAD) for _, x in part}, {i for i, _ in part}), threshold).values():
            done[x].append(found / truth)
    waiting = {x: (0.0, min(AUDIT_SHARE, AUDIT_LINKED / n)) for x, n in per_label.items() if x not in again}
    while waiting:
        ranges, size = {}, 0.0
        for x, (lo, hi) in waiting.items():
            hi = min(hi, lo + AUDIT_BATCH / per_label[x])
            if ranges and size + (hi - lo) * per_label[x] > AUDIT_BATCH:
                break
            ranges[x] = (int(lo * _SPREAD), int(hi * _SPREAD))
            size += (hi - lo) * per_label[x]
            waiting[x] = (lo, hi)
        for i, (x, truth, found) in _asked(placed, _drawn(placed, ranges), threshold).items():
            done[x].append(found / truth)
            known.setdefault(x, []).append(i)
        for x in ranges:
            hi = waiting[x][1]
            if len(done[x]) >= AUDIT_LINKED:
                del waiting[x]
            elif hi >= AUDIT_SHARE:
                del waiting[x]
                recall[x] = None
            else:
                waiting[x] = (hi, min(AUDIT_SHARE, 3 * hi))
    return {x: recall[x] if x in recall else float(np.mean(done[x])) for x in per_label}


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = THRESHOLD, k: int = NEIGHBOURS) -> DataFrame:
    """(id, n_links, component_id, kept) of each row.

    Vectors link where labels are equal and not null and the cosine is at
    least ``threshold``. Null, zero or non-finite vectors, and those with a null
    component, link with nothing. Vectors of different lengths never link.
    Equal vectors of one label link with each other; a repeated id is a row
    of its own and links as another vector does. n_links counts linked rows.
    """
    spark = df.sparkSession
    sized = unit_vectors(df, id_col, vector, label)
    rows = frames.written(sized, "vectors")
    whole = rows.where("unit is not null")
    classes = frames.written(
        whole.groupBy("label", "unit").agg(F.min("id").alias("least"), F.count("*").alias("copies"))
        .select(F.xxhash64("label", "unit").alias("id"), F.struct(F.col("label").cast("string").alias("l"), F.length("unit").alias("n")).cast("string").alias("label"), "unit", "least", "copies"), "classes")
    counted = classes.groupBy("label", F.length("unit").alias("size")).agg(F.count("*").alias("n")).collect()
    # Labels still searched by descents, and those to be compared exactly.
    searched = {r.label: r["n"] for r in counted if r["n"] > SMALL}
    size_of = {r.label: r["size"] for r in counted}
    exactly = {r.label for r in counted if 1 < r["n"] <= SMALL}
    edges, known = spark.createDataFrame([], "a long, b long"), {}
    comps = edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
    for seed in range(ROUNDS):
        if not searched:
            break
        for size in sorted({size_of[x] for x in searched}):
            own = classes.where((F.length("unit") == size) & F.col("label").isin(list(searched)))
            lists = frames.written(_first_lists(own, searched, seed, size // 8, k, threshold), "lists")
            found = [lists]
            merged = frames.written(_merge(lists, k, threshold), "merged")
            for _ in range(DESCENTS):
                lists = frames.written(_descend(merged, own, k, threshold), "lists")
                found.append(lists)
                merged = frames.written(_merge(merged.union(lists), k, threshold), "merged")
            for lists in found:
                edges = edges.union(lists.where("sims is null").select(F.col("id").alias("a"), F.col("nbrs")[0].alias("b")))
        comps = frames.components(edges)
        recall = audit(classes.where(F.col("label").isin(list(searched))), comps, threshold, searched, known)
        exactly |= {x for x, r in recall.items() if r is None}
        searched = {x: n for x, n in searched.items() if recall[x] is not None and recall[x] < AUDIT_RECALL}
    exactly |= set(searched)
    whole_label = F.col("label").isin(sorted(exactly))
    members = comps.join(classes.where(~whole_label), "id").select("component", "id", "copies", "unit")
    members = members.union(classes.where(whole_label).select(F.xxhash64("label"), "id", "copies", "unit"))
    exact = frames.written(_within(members, threshold), "links")
    final = frames.components(exact.where("id <> other").select(F.col("id").alias("a"), F.col("other").alias("b")))
    counts = exact.groupBy("id").agg(F.sum("n").alias("n"))
    named = classes.join(final, "id", "left").join(counts, "id", "left").select("id", "label", "unit", "least", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "id").alias("component"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    by_class = named.join(least, "component").select(F.col("id").alias("__class"), "n_links", "component_id")
    keyed = rows.withColumn("__class", F.when(F.col("unit").isNotNull(), F.xxhash64("label", "unit")))
    out = keyed.join(by_class, "__class", "left").select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))
