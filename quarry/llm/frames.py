"""Shared plumbing of the operators: Arrow maps, written tables, connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


#: Bytes of an Arrow batch on its way to or from a Python worker.
BATCH_BYTES = 8 << 20


def work_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares for intermediate tables.

    It is the session's ``spark.checkpoint.dir``. Where that is unset, a
    temporary folder is made and set if the session runs in one process; on a
    cluster, whose machines would not see such a folder, this raises.
    """
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the whole cluster shares")
        base = "file://" + tempfile.mkdtemp(prefix="quarry-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(base)
    return base.rstrip("/")


def bound_batches(spark: SparkSession) -> None:
    """Holds the session's Arrow batches to BATCH_BYTES, so that a batch of long texts or packed rows stays small."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name).rstrip("b") != str(BATCH_BYTES):
        spark.conf.set(name, str(BATCH_BYTES))


def release() -> None:
    """Gives memory that a worker has freed back to the system; idle workers would keep it."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{work_dir(spark)}/quarry-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table written to the shared folder; cuts its lineage and survives lost executors."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def arrow_map(df: DataFrame, fn: Callable[[pa.RecordBatch], dict], keep: list[str], out: str | T.StructType) -> DataFrame:
    """Columns ``keep`` of each row beside the columns ``out`` that ``fn`` makes of each batch.

    ``fn`` returns, by column of ``out``, one value a row. ``out`` must not
    name a column of ``keep``.
    """
    made = T._parse_datatype_string(out) if isinstance(out, str) else out
    clash = set(keep) & set(made.names)
    if clash:
        raise ValueError(f"columns {sorted(clash)} are both kept and made")
    schema = T.StructType([df.schema[c] for c in keep] + list(made.fields))
    arrow = to_arrow_schema(schema)
    bound_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            got = fn(batch)
            arrays = []
            for f in arrow:
                a = batch.column(batch.schema.get_field_index(f.name)) if f.name in keep else got[f.name]
                a = a if isinstance(a, (pa.Array, pa.ChunkedArray)) else pa.array(a, f.type)
                arrays.append(a if a.type == f.type else a.cast(f.type))
            yield pa.RecordBatch.from_arrays(arrays, schema=arrow)
        release()

    return df.mapInArrow(run, schema)


def hash_part(value: F.Column, n: int) -> F.Column:
    return F.pmod(F.xxhash64(value), F.lit(n)).cast("int")


#: Into how many parts the edges of one node are dealt.
_SALTS = 64


def _to_least(e: DataFrame) -> DataFrame:
    """(a, b, m) of edges (a, b): m is the least of a and a's neighbours. A node's edges are joined in _SALTS parts."""
    dealt = e.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(_SALTS)).cast("int"))
    part = dealt.groupBy("a", "salt").agg(F.min("b").alias("m"))
    least = part.groupBy("a").agg(F.min("m").alias("m"), F.collect_list("salt").alias("salts"))
    least = least.select("a", F.least("a", "m").alias("m"), F.explode("salts").alias("salt"))
    return dealt.join(least, ["a", "salt"]).select("a", "b", "m")


def with_totals(df: DataFrame, keys: list[str], total: str, by: str) -> DataFrame:
    """``df`` with the number of rows of each key; a key's rows are dealt by ``by`` and joined in _SALTS parts."""
    dealt = df.withColumn("__salt", F.pmod(F.xxhash64(by), F.lit(_SALTS)).cast("int"))
    part = dealt.groupBy(*keys, "__salt").agg(F.count("*").alias("__c"))
    whole = part.groupBy(*keys).agg(F.sum("__c").alias(total), F.collect_list("__salt").alias("__salts"))
    return dealt.join(whole.select(*keys, total, F.explode("__salts").alias("__salt")), [*keys, "__salt"]).drop("__salt")


def components(edges: DataFrame) -> DataFrame:
    """Connected components of undirected ``edges(a, b)`` as (id, component), component the smallest id.

    Alternates the large-star and small-star steps, each a min per node and
    one equi-join, until the edges no longer change, however many rounds that
    takes; every round is checkpointed to the shared folder. Ids that occur in
    no edge are absent. Self edges and repeated edges are allowed; rows with a
    null are left out. Without edges the result is empty.
    """
    spark = edges.sparkSession
    work_dir(spark)

    def state(e: DataFrame) -> tuple:
        r = e.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 40)))).first()
        return tuple(r)

    e = edges.where("a is not null and b is not null").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct().checkpoint()
    nodes = e.select(F.col("a").alias("id")).union(e.select("b"))
    e, before = e.where("a > b"), None
    while True:
        now = state(e)
        if now == before or now[0] == 0:
            break
        before = now
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _to_least(both).where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        star = F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))
        e = _to_least(large).select(F.explode(star).alias("x")).select("x.*").where("a > b").distinct().checkpoint()
    label = e.select(F.col("a").alias("id"), F.col("b").alias("m")).groupBy("id").agg(F.min("m").alias("m"))
    return nodes.distinct().join(label, "id", "left").select("id", F.coalesce("m", "id").alias("component"))


def save_array(uri: str, array) -> None:
    """Writes a numpy array to the shared folder, whole or not at all; a task that runs again writes the same."""
    import io
    import os

    import numpy as np
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri)
    if isinstance(system, fs.LocalFileSystem):
        os.makedirs(os.path.dirname(path), exist_ok=True)
    own = f"{path}.{uuid.uuid4().hex}"
    held = io.BytesIO()
    np.save(held, array)
    with system.open_output_stream(own) as f:
        f.write(held.getbuffer())
    system.move(own, path)


def remove(uri: str) -> None:
    """Deletes a folder of the shared folder, if it is there."""
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri)
    if system.get_file_info(path).type != fs.FileType.NotFound:
        system.delete_dir(path)


def load_array(uri: str):
    """An array of the shared folder: mapped into memory where the folder is mounted, else read."""
    import io

    import numpy as np
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri)
    if isinstance(system, fs.LocalFileSystem):
        return np.load(path, mmap_mode="r")
    with system.open_input_stream(path) as f:
        return np.load(io.BytesIO(f.read()))


def runs_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple]]]:
    """Rows of Arrow batches that are sorted by their first column, by its value: one value's rows in memory at a time."""
    at, held = None, []
    for batch in batches:
        for i in range(batch.num_rows):
            row = [c[i].as_py() for c in batch.columns]
            if row[0] != at and held:
                yield at, held
                held = []
            at = row[0]
            held.append(tuple(row[1:]))
    if held:
        yield at, held
