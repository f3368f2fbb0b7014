"""Shared folders, line scans and resumable loads."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder under ``spark.checkpoint.dir``; a temporary one only where that is unset and the session is one process."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the whole cluster shares")
        base = "file://" + tempfile.mkdtemp(prefix="quarry-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def file_names(spark: SparkSession, folder: str, pattern: str = "*.jsonl*") -> list[str]:
    """Files of a folder that match, by name: a listing, no file is read."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{pattern}")
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    return sorted(str(f.getPath()) for f in found or [])


def scan_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(value): the lines of text files, plain, gzip or xz by their extension; an xz file, which cannot be split, is one task that streams it."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    plain, packed = [p for p in paths if not p.endswith(".xz")], [p for p in paths if p.endswith(".xz")]
    made = [spark.read.text(plain)] if plain else []
    if packed:

        def run(batches):
            import io
            import lzma

            for batch in batches:
                for data in batch.column(0):
                    held = []
                    with lzma.open(io.BytesIO(data.as_py()), "rt", encoding="utf-8") as lines:
                        for line in lines:
                            held.append(line.rstrip("\r\n"))
                            if len(held) == 10_000:
                                yield pa.RecordBatch.from_arrays([pa.array(held, pa.string())], names=["value"])
                                held = []
                    if held:
                        yield pa.RecordBatch.from_arrays([pa.array(held, pa.string())], names=["value"])

        made.append(spark.read.format("binaryFile").load(packed).select("content").mapInArrow(run, "value string"))
    if not made:
        return spark.createDataFrame([], "value string")
    return made[0] if len(made) == 1 else made[0].union(made[1])


def scan_json(spark: SparkSession, paths: str | list[str], schema: str) -> DataFrame:
    """Records of JSON lines by ``schema``; blank lines are skipped, a line that is no JSON gives nulls."""
    lines = scan_lines(spark, paths).where(F.trim("value") != "")
    return lines.select(F.from_json("value", schema).alias("r")).select("r.*")


def load_files(spark: SparkSession, folder: str, target: str, log: str, read: Callable[[str], DataFrame], key: list[str], pattern: str = "*.jsonl*") -> list[tuple[str, int]]:
    """Appends each file of ``folder`` that ``log`` lacks to ``target``, in order of names; (file, new rows) of those loaded now.

    Rows whose key is in ``target`` already are left out, and of a file's rows
    with one key the least stays. So a load that broke off between a file's
    rows and its entry in the log is run again without adding any.
    """
    had = spark.read.parquet(log).select("file").collect() if file_names(spark, log, "part-*") else []
    done, made = {r.file for r in had}, []
    for name in file_names(spark, folder, pattern):
        if name in done:
            continue
        rows = read(name)
        rest = [c for c in rows.columns if c not in key]
        rows = rows.groupBy(*key).agg(F.min(F.struct(*rest)).alias("__r")).select(*key, "__r.*") if rest else rows.distinct()
        if file_names(spark, target, "part-*"):
            rows = rows.join(spark.read.parquet(target).select(*key), key, "left_anti")
        rows = rows.checkpoint() if spark.sparkContext.getCheckpointDir() else rows
        n = rows.count()
        rows.write.mode("append").parquet(target)
        spark.createDataFrame([(name, n)], "file string, n long").coalesce(1).write.mode("append").parquet(log)
        made.append((name, n))
    return made
