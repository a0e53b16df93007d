"""Positions of rows in a total order, without one task that sees them all."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillbom.session import shared_folder


def with_position(rows: DataFrame, order: list, name: str) -> DataFrame:
    """rows with their 0-based position in that order; ties fall in any order.

    Rows are dealt by ranges of the order and numbered inside each; a range starts after the counts
    of those before it, which are one number for each partition.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shared_folder(rows.sparkSession)
    dealt = rows.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()).checkpoint()  # ranges are sampled: both uses need the same
    inside = dealt.withColumn("_row", F.row_number().over(Window.partitionBy("_part").orderBy(*order)))
    counts = dealt.groupBy("_part").count().withColumn("_before", F.sum("count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)))
    starts = counts.select("_part", F.coalesce("_before", F.lit(0)).alias("_before"))
    return inside.join(F.broadcast(starts), "_part").withColumn(name, F.col("_before") + F.col("_row") - 1).drop("_part", "_row", "_before")
