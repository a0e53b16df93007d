"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each source gets a target of words: its weight's share of the mix, but at most so many times its own
words; what is over goes to the other sources by weight. A source first takes all its documents as
often as its target holds them wholly (complete epochs). The fraction that is left is a weighted
sample without replacement: each document draws an exponential key of a rate that is its quality
weight, documents are sorted by key within the source, sizes are summed along that order, and the
documents whose sums fit the budget are taken; the one at its end gives its first words only, so
that the mix holds the target to the word.

Order and sums are had from range partitions: a source of any share of the rows lies in many of
them, and only one sum a partition and source is gathered. Targets come from rounds of sums over
the table of sources, one row to the driver each.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillbom.functions.positions import with_position
from quillbom.llm.quality import words_of
from quillbom.llm.shared import checkpoint_dir

#: What sources weigh, repeating, in the order of their names.
WEIGHTS = (3.0, 1.0, 2.0)
#: Words of the mix, as a share of all words.
SHARE = 1.5
#: A source, and so a document, is taken at most so often.
MOST = 2
SEED = 2024
RESULTS = ("size", "source_size", "target", "taken")


def quality_weight(words: Column) -> Column:
    """Root of the share of different words, between 0 and 1: texts that repeat themselves are drawn later; 1 without words."""
    return F.when(F.size(words) > 0, F.sqrt(F.size(F.array_distinct(words)) / F.size(words))).otherwise(F.lit(1.0))


def draw(key: Column, weight: Column, seed: int) -> Column:
    """Exponential key of rate weight, the same in each run: the uniform number is a hash of seed and key."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    uniform = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    return -F.log(uniform) / weight


def targets(sources: DataFrame, share: float = SHARE, most: float = MOST) -> DataFrame:
    """sources (size, weight) with target: shares by weight, at most `most` times the size, the excess reshared.

    Each round finds the sources that the present level puts over their bound; they get the bound,
    and the level of the others rises, until none is above.
    """
    whole = sources.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("size"), F.coalesce(F.sum("weight"), F.lit(0.0)).alias("weight")).first()
    goal, full, bound = share * whole["size"], None, F.col("size") * float(most)
    left, by = goal, whole["weight"]
    while True:
        share_of = F.col("weight") * left / by if by > 0 else F.lit(0.0)
        over = sources.where(bound < share_of).agg(F.count("*").alias("n"), F.sum("size").alias("size"), F.sum("weight").alias("weight")).first()
        if over["n"] == (full or 0):
            return sources.withColumn("target", F.when(bound < share_of, bound).otherwise(share_of))
        full = over["n"]
        left, by = goal - float(most) * over["size"], whole["weight"] - over["weight"]


def mix(
    docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: int = MOST,
    seed: int = SEED, quality: Column | None = None, keep: Sequence[str] | None = None,
) -> DataFrame:
    """docs (or its columns `keep`) with size, source_size, target and taken, the words that the mix takes of a document, repeats counted.

    quality: a positive number for each row, else quality_weight() of the text. Null and empty texts
    have size 0 and give nothing; null sources are one source, the last; null keys draw like others;
    repeated rows are taken each for itself, and which of two equal rows is at the end of a budget
    makes no difference; of rows that share a key but not the text, the shorter comes first. Extra
    columns stay, but one with the name of a result is replaced by it. An empty table gives none.
    """
    spark = docs.sparkSession
    checkpoint_dir(spark)
    lower = [c.lower() for c in docs.columns]
    place = lambda name: f"c{lower.index(name.lower())}"
    keep = list(docs.columns if keep is None else keep)
    names = [place(c) for c in keep if c.lower() not in RESULTS]
    rows = docs.select("*", quality.alias("_given")) if quality is not None else docs.select("*", F.lit(None).alias("_given"))
    rows = rows.toDF(*[f"c{i}" for i in range(len(lower))], "given").withColumn("words", words_of(F.col(place(text))))
    weight = F.coalesce(F.col("given").cast("double"), quality_weight(F.col("words")))
    rows = rows.select(
        *names, F.col(place(source)).isNull().alias("nowhere"), F.coalesce(F.col(place(source)).cast("string"), F.lit("")).alias("of"), F.size("words").cast("long").alias("size"),
        draw(F.col(place(key)), weight, seed).alias("drawn"), F.col(place(key)).alias("by"),
    ).checkpoint()
    per_source = with_position(rows.groupBy("nowhere", "of").agg(F.sum("size").alias("size")), [F.col("nowhere"), F.col("of")], "place").checkpoint()
    each = F.get(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights)).cast("int"))
    plans = targets(per_source.select("nowhere", "of", "size", each.alias("weight")), share, most)
    plans = plans.select("nowhere", "of", F.col("size").alias("source_size"), "target", F.when(F.col("size") > 0, F.floor(F.col("target") / F.col("size"))).otherwise(F.lit(0)).alias("epochs"))
    plans = plans.withColumn("budget", F.greatest(F.floor("target") - F.col("epochs") * F.col("source_size"), F.lit(0)))

    order = [F.col(c) for c in ("nowhere", "of", "drawn", "size", "by")]
    dealt = rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).withColumn("part", F.spark_partition_id()).checkpoint()  # ranges are sampled: both uses need the same
    inside = Window.partitionBy("part", "nowhere", "of").orderBy("drawn", "size", "by").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = dealt.groupBy("part", "nowhere", "of").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("nowhere", "of").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.join(plans, ["nowhere", "of"]).withColumn("ahead", F.coalesce(F.sum("words").over(before), F.lit(0))).drop("words")
    rank = dealt.withColumn("ahead_here", F.sum("size").over(inside) - F.col("size")).join(starts, ["part", "nowhere", "of"])
    last = F.greatest(F.lit(0), F.least(F.col("size"), F.col("budget") - F.col("ahead") - F.col("ahead_here")))
    out = [F.col(place(c)).alias(c) for c in keep if c.lower() not in RESULTS]
    return rank.select(*out, "size", "source_size", "target", (F.col("epochs") * F.col("size") + last).cast("long").alias("taken"))


def copies(mixed: DataFrame, text: str = "text") -> DataFrame:
    """The mix itself: a row for each time a document is taken, with epoch (from 0); in the last one the text may be cut to its first words.

    mixed: what mix() returns, with its texts. Documents of which nothing is taken give no row.
    """
    times = F.ceil(F.col("taken") / F.col("size")).cast("int")
    rows = mixed.where("taken > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), times - 1)))
    left = (F.col("taken") - F.col("epoch") * F.col("size")).cast("int")
    head = F.regexp_extract(text, r"^[\x20\x09-\x0D]*[^\x20\x09-\x0D]+", 0)
    cut = F.array_join(F.slice(words_of(F.col(text)), F.lit(1), left), " ")
    return rows.withColumn(text, F.when(left >= F.col("size"), F.col(text)).when(left == 1, F.ltrim(head)).otherwise(cut))
