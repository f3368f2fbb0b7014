"""Streams that read files once each (checkpointed), for logs and incremental loads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.files import file_names, shared_folder


def windows(events: DataFrame, every: str = "1 hour", late: str | None = None) -> DataFrame:
    """Counts and sums by window and type, of a stream or a table.

    With ``late`` a stream forgets windows so much older than its newest row,
    and rows that come later still are dropped: what a stream that never ends
    needs. Without it every row counts, in whatever order files come.
    """
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    timed = timed.withWatermark("ts", late) if events.isStreaming and late else timed
    return timed.groupBy(F.window("ts", every).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def run_once(stream: DataFrame, key: list[str], folder: str | None = None) -> DataFrame:
    """All that the stream has now, each micro-batch written under its own number, so a batch that runs again replaces itself."""
    spark = stream.sparkSession
    folder = folder or shared_folder(spark, "stream")
    out = f"{folder}/out"

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("__batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/n={number}")

    q = stream.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(write).start()
    q.awaitTermination()
    if not file_names(spark, out, "n=*"):
        return spark.createDataFrame([], stream.schema)
    made = spark.read.parquet(f"{out}/n=*")
    last = made.groupBy(*key).agg(F.max_by(F.struct(*[c for c in made.columns if c not in (*key, "__batch")]), "__batch").alias("r"))
    return last.select(*key, "r.*")
