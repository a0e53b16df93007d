"""Quality rules by the log-likelihood ratio of hashed n-grams, in DataFrame operations only.

Words and word pairs fall into a fixed number of buckets. One pass counts the buckets of the whole
corpus, and beside them those of the trusted target documents; the smoothed multinomials give each
bucket a log-likelihood ratio. A document's score is the mean ratio of its n-grams, and documents
under the threshold are rejected. Base rules come first.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillbom.functions.positions import with_position
from quillbom.session import shared_folder

#: Buckets of the multinomials: their counts and ratios are all that reaches the driver.
BUCKETS = 8192
#: Added to each count.
SMOOTHING = 1.0
#: Quantile of the trusted rows' scores from which the threshold is set; rows under MIN_WORDS don't count.
TRUSTED_LOSS = 0.001
#: How far under that quantile a score must be to be rejected.
MARGIN = 0.02
MIN_WORDS = 50
#: Trusted ids go to the documents as bits, 64 ids a row, up to so many rows: 67 million documents whose ids lie close together.
MOST_BIT_ROWS = 1 << 20
MAX_REPEAT_PERCENT = 50
SPACES = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def words_of(text: Column) -> Column:
    """Words, between spaces and the characters U+0009 to U+000D; null texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def window_hash(*words: Column) -> Column:
    return F.xxhash64(*words)


def base_features(docs: DataFrame, text: str) -> DataFrame:
    """docs with words (an array) and FEATURES; docs must have no columns of these names, nor low_bits, met and starts.

    n_repeat_words counts words in 3-word windows found twice or more, the first included. Each
    window's hash and start are packed in one number, so that one sort of plain numbers brings equal
    windows together: the low bits hold the start, as many as the text's length needs. Windows that
    meet are compared word by word; should different ones have met, the text's windows are sorted by
    their words instead. So the count is exact.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    words, low, met, starts = "words", "low_bits", "met", "starts"
    docs = docs.withColumn(words, words_of(F.col(text)))
    w = lambda i: F.get(F.col(words), i)
    n = F.size(words)
    docs = docs.withColumn(low, F.ceil(F.log2(n + F.lit(1))).cast("int"))
    packed = F.sort_array(
        F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.call_function("shiftleft", window_hash(w(i), w(i + 1), w(i + 2)), F.col(low)).bitwiseOR(i.cast("long")))
    )
    same = lambda a, b: F.call_function("shiftrightunsigned", a, F.col(low)) == F.call_function("shiftrightunsigned", b, F.col(low))
    start = lambda x: x.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), F.col(low)) - 1).cast("int")
    docs = docs.withColumn(met, F.when(n >= 4, packed))
    docs = docs.withColumn(met, F.filter(met, lambda x, i: same(x, F.get(met, i - 1)) | same(x, F.get(met, i + 1))))
    differ = lambda a, b: (w(a) != w(b)) | (w(a + 1) != w(b + 1)) | (w(a + 2) != w(b + 2))
    chance = F.filter(met, lambda x, i: same(x, F.get(met, i + 1)) & differ(start(x), start(F.get(met, i + 1))))
    spelt = F.sort_array(F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.struct(F.concat_ws(" ", w(i), w(i + 1), w(i + 2)).alias("w"), i.alias("i"))))
    twice = lambda rows: F.filter(rows, lambda x, i: F.coalesce((x["w"] == F.get(rows, i - 1)["w"]) | (x["w"] == F.get(rows, i + 1)["w"]), F.lit(False)))
    by_words = F.aggregate(F.array(spelt), F.array().cast("array<int>"), lambda _, rows: F.transform(twice(rows), lambda x: x["i"]))
    docs = docs.withColumn(starts, F.sort_array(F.when(F.size(chance) > 0, by_words).otherwise(F.transform(met, start))))
    covered = F.aggregate(
        F.zip_with(starts, F.slice(starts, 2, F.greatest(F.size(starts), F.lit(1))), lambda a, b: F.least(F.coalesce(b - a, F.lit(3)), F.lit(3))),
        F.lit(0).cast("long"),
        lambda acc, x: acc + x,
    )
    lines = F.filter(F.split(t, "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0)
    found = {
        "n_words": F.size(words).cast("long"),
        "word_chars": F.length(F.translate(t, SPACES, "")).cast("long"),
        "n_symbols": (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        "n_repeat_words": F.coalesce(covered, F.lit(0)).cast("long"),
    }
    return docs.withColumns(found).drop(low, met, starts)


def grams(words: Column) -> Column:
    """Buckets of the words and of the pairs of neighbours."""
    bucket = lambda *x: F.pmod(F.xxhash64(*x), F.lit(BUCKETS)).cast("int")
    single = F.transform(words, lambda w: bucket(w))
    pairs = F.transform(words, lambda w, i: F.when(i > 0, bucket(F.get(words, i - 1), w)))
    return F.concat(single, F.filter(pairs, lambda b: b.isNotNull()))


def trusted_ids(labels: DataFrame, key: str) -> DataFrame:
    """The target: all ids labelled of good quality and not toxic."""
    good = labels.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("trusted_id")).agg(F.min("quality").alias("q"), F.max("toxic").alias("t"))
    good = good.where((F.col("q") == 1) & (F.coalesce("t", F.lit(0)) == 0))
    return good.select("trusted_id")


def with_trust(docs: DataFrame, trusted: DataFrame, key: str, text: str) -> DataFrame:
    """(text, good): each text of docs and whether its key is among trusted_id; neither changes the number of rows.

    Whole numbers that lie close together are broadcast as bits, so that no text is shuffled; where they are too many for
    that, or far apart, or no whole numbers, keys and texts are, once and before they are split to words.
    """
    rows = docs.select(key, text)
    if {dict(rows.dtypes)[key], dict(trusted.dtypes)["trusted_id"]} <= {"tinyint", "smallint", "int", "bigint"}:
        shared_folder(docs.sparkSession)
        place = lambda c: F.shiftright(F.col(c).cast("long"), 6)
        bit = lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), F.col(c).bitwiseAND(63).cast("int"))
        bits = trusted.groupBy(place("trusted_id").alias("place")).agg(F.bit_or(bit("trusted_id")).alias("bits")).checkpoint()
        if bits.count() <= MOST_BIT_ROWS:
            good = F.coalesce(F.col("bits").bitwiseAND(bit(key)) != 0, F.lit(False))
            return rows.join(F.broadcast(bits), place(key) == F.col("place"), "left").select(text, good.alias("good"))
    return rows.join(trusted, F.col(key) == F.col("trusted_id"), "left").select(text, F.col("trusted_id").isNotNull().alias("good"))


def quantile(values: DataFrame, share: float) -> float | None:
    """The exact quantile of a column of numbers, between its two nearest rows in proportion; None without any. Rows are placed by ranges, two come back."""
    (name,) = values.columns
    shared_folder(values.sparkSession)
    values = values.checkpoint().where(F.col(name).isNotNull())  # counted, sampled and dealt; the filter must not move into what makes them
    place = share * (values.count() - 1)
    if place < 0:
        return None
    below, above = math.floor(place), math.ceil(place)
    near = {r["place"]: r[name] for r in with_position(values, [name], "place").where(F.col("place").isin(below, above)).collect()}
    return near[below] if near[below] == near[above] else (above - place) * near[below] + (place - below) * near[above]


def score_column(ratios: list[float]) -> Column:
    """Mean ratio of a row's grams; rows without any score 0."""
    table = F.split(F.lit(",".join(f"{r:.9f}" for r in ratios)), ",").cast("array<double>")
    total = F.aggregate("grams", F.lit(0.0), lambda acc, b: acc + F.get(table, b))
    return F.when(F.size("grams") > 0, total / F.size("grams")).otherwise(F.lit(0.0))


def fit(docs: DataFrame, labels: DataFrame, key: str, text: str) -> tuple[list[float], float]:
    """(ratio of each bucket, threshold). Counts cover every document; only BUCKETS rows come back."""
    marked = with_trust(docs, trusted_ids(labels, key), key, text)
    # explode_outer: for a plain explode, Spark adds a filter that would split the text anew for each word
    counts = (
        marked.select(words_of(F.col(text)).alias("words"), F.col("good").cast("long").alias("good"))
        .select(F.explode_outer(grams(F.col("words"))).alias("bucket"), "good")
        .where(F.col("bucket").isNotNull())
        .groupBy("bucket")
        .agg(F.count("*").alias("n"), F.sum("good").alias("g"))
        .collect()
    )
    raw, good = [SMOOTHING] * BUCKETS, [SMOOTHING] * BUCKETS
    for r in counts:
        raw[r["bucket"]] += r["n"]
        good[r["bucket"]] += r["g"]
    all_raw, all_good = math.log(sum(raw)), math.log(sum(good))
    ratios = [math.log(g) - all_good - math.log(r) + all_raw for g, r in zip(good, raw, strict=True)]
    scored = marked.where("good").select(words_of(F.col(text)).alias("words"))
    scored = scored.select(F.size("words").alias("n"), grams(F.col("words")).alias("grams"))
    low = quantile(scored.select(F.when(F.col("n") >= MIN_WORDS, score_column(ratios)).alias("s")), TRUSTED_LOSS)
    return ratios, (low - MARGIN if low is not None else float("-inf"))


def _judged(docs: DataFrame, labels: DataFrame, key: str, text: str) -> DataFrame:
    """The columns of docs as c0, c1 and so on, which clash with no name of ours, and what is found."""
    lower = [c.lower() for c in docs.columns]
    docs = docs.toDF(*[f"c{i}" for i in range(len(lower))])
    key_of_labels, key, text = key, f"c{lower.index(key.lower())}", f"c{lower.index(text.lower())}"
    ratios, least = fit(docs, labels.select(F.col(key_of_labels).alias(key), "quality", "toxic"), key, text)
    full = base_features(docs, text)
    full = full.withColumn("grams", grams(F.col("words"))).withColumn("score", score_column(ratios)).drop("grams", "words")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return full.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("score") >= F.lit(least)))


def judge(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with FEATURES, score, base_failed and kept.

    Every row gets a verdict: null and empty texts have no words and fail the base rules; rows with
    a null key are judged like others but never trusted; repeated rows get the same verdict; a very
    long text is judged as a whole, within its row; an empty table gives no rows. Extra columns of
    docs stay, but one that has the name of a result is replaced by it. Without trusted rows the
    method rejects nothing.

    The results pass through a generator: a filter right on them would be pushed down to the scan,
    where the words would be split anew for each of their uses.
    """
    full = _judged(docs, labels, key, text)
    found = [*FEATURES, "score", "base_failed", "kept"]
    stay = [F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns) if c.lower() not in found or c.lower() in (key.lower(), text.lower())]
    return full.select(*stay, F.inline_outer(F.array(F.struct(*found))))


def accepted(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that judge() keeps, with the columns of docs as they are, whatever their names; nothing else is computed."""
    judged = _judged(docs, labels, key, text).withColumn("kept", F.explode_outer(F.array("kept"))).where("kept")
    return judged.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])
