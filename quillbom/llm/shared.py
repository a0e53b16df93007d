"""What several operators share: the folder for checkpoints, and connected components."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; one of our own only where it is unset."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", context.master):  # a folder of this machine is none that executors share
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and the executors share")
        found = tempfile.mkdtemp(prefix="quillbom-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(found)
    return found


#: Rows that go to Python at a time, at most. Texts are long: Spark's usual 10,000 of them make batches
#: of many megabytes, which the executor and the worker hold more than once.
BATCH_ROWS = 1000


def small_batches(df: DataFrame) -> DataFrame:
    """df, in a session that sends at most BATCH_ROWS rows to Python at a time; a smaller setting stays.

    The setting is one of the session, so it holds for the caller's later work in it too.
    """
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name)) <= BATCH_ROWS:
        conf.set(name, str(BATCH_ROWS))
    return df


def slices(batches: Iterator[pd.DataFrame], rows: int = 256) -> Iterator[pd.DataFrame]:
    """The batches in slices of so many rows, for work whose memory grows with the rows at hand."""
    for batch in batches:
        for at in range(0, len(batch), rows):
            yield batch.iloc[at:at + rows]


#: A key of more than so large a part of all rows is hot; there are at most as many hot keys as this says.
HOT_KEYS = 1000


def join_hot(left: DataFrame, right: DataFrame, on: str, total: int) -> DataFrame:
    """left joined with right, which has one row for each key, and in the column rows how many left has of it.

    Hot keys are fewer than HOT_KEYS, so their rows of right are broadcast and those of left stay
    where they are; only the others are shuffled. total is the number of left's rows.
    """
    is_hot = F.col("rows") * HOT_KEYS > F.lit(total)
    right = right.withColumn("hot_key", is_hot)
    others = [c for c in right.columns if c not in (on, "rows", "hot_key")]
    tried = left.join(F.broadcast(right.where("hot_key").drop("rows")), on, "left")
    rest = tried.where("hot_key is null").select(*left.columns).join(right.where("not hot_key").drop("rows", "hot_key"), on)
    return tried.where("hot_key").select(*left.columns, *others).unionByName(rest.select(*left.columns, *others))


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b): root is the smallest node of its component.

    Alternating large-star and small-star rounds; each round is two aggregations to one row per node
    and two joins against them, so a node of very many links is never gathered in one place. Rounds
    are cut by checkpoints in the shared folder, and their number is logarithmic in practice.
    """
    checkpoint_dir(edges.sparkSession)
    stars = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct().checkpoint()
    before, total = None, stars.count()
    while True:
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.when(F.col("v") > F.col("u"), 1)).alias("rows")).select("u", F.least("u", "m").alias("m"), "rows")
        large = join_hot(both.where("v > u"), least, "u", total).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        stars = small.select("e.*").where("u <> v").distinct().checkpoint()
        now = stars.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before, total = now, now[0]
    return stars.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(stars.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
