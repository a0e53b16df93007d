"""The same operators over arriving files and events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stream_table(spark: SparkSession, path: str, schema: str | object, files_per_trigger: int = 16) -> DataFrame:
    """Parquet files as they are dropped into a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def apply_per_batch(stream: DataFrame, operator: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str, mode: str = "append"):
    """Runs an operator of this package on each micro-batch and appends its rows; a repeated batch overwrites its own folder.
    In update mode a batch holds the aggregates that have changed."""

    def write(batch: DataFrame, number: int) -> None:
        operator(batch).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, ts: str = "ts", kind: str = "event_type", width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events by type and time window; works on streams, where state older than the watermark is dropped, and on tables."""
    timed = events.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    counts = timed.groupBy(F.window("_ts", width).alias("w"), kind).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return counts.select(F.col("w.start").alias("start"), kind, "n", "total")
