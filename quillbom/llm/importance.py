"""Importance resampling towards a target by hashed n-grams, with segment deduplication.

Line feeds cut texts into lines, and no word crosses one. Features of each distinct line are counted
once and multiplied by its occurrences; n-grams that cross lines are counted beside that, from the
words around each line feed. The counts of corpus and target give each bucket a gain, the log of
the ratio of smoothed frequencies; a document's weight is the sum of its features' gains, for which
lines met before in a task are looked up. Gumbel noise, a hash of seed and key, turns the top of
the scores into a draw without replacement in proportion to the exponential weights.

Equal lines are added up in each task before they are shuffled. What reaches the driver is one
count a bucket; the gains that go to the tasks are as many.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillbom.functions.positions import with_position
from quillbom.llm.shared import checkpoint_dir, small_batches

BUCKETS = 10_000
#: Features are all runs of 1 to so many words.
WIDTH = 1
#: Documents of fewer words are not drawn.
LEAST_WORDS = 20
PERCENT = 10
SEED = 2024
#: Lines and words that a task remembers.
MEMORY = 1 << 17
#: Bytes of lines that a task remembers, at most.
LINE_BYTES = 1 << 24

#: Bytes of words, A to Z in lower case; all others become spaces. Bytes over 0x7F belong to letters of more bytes.
_clean = bytes(ord(chr(b).lower()) if b > 0x7F or chr(b).isalnum() else 0x20 for b in range(0x80)) + bytes(range(0x80, 0x100))


def words(text: bytes) -> list[bytes]:
    return text.translate(_clean).split()


def line_grams(ws: list[bytes], width: int) -> list[bytes]:
    """All runs of 1 to width words of one line."""
    out = list(ws)
    for n in range(2, width + 1):
        out += [b" ".join(ws[i:i + n]) for i in range(len(ws) - n + 1)]
    return out


def crossing_grams(lines: list[list[bytes]], width: int) -> Iterator[bytes]:
    """Runs of at most width words that begin in one line and end in a later one."""
    tail: list[bytes] = []
    for ws in lines:
        for end in range(1, min(len(ws), width - 1) + 1):
            for back in range(1, min(len(tail), width - end) + 1):
                yield b" ".join(tail[len(tail) - back:] + ws[:end])
        tail = (tail + ws)[-(width - 1):] if width > 1 else []


def _buckets(counts: Counter, buckets: int, into: np.ndarray) -> None:
    for gram, n in counts.items():
        into[zlib.crc32(gram) % buckets] += n


def bucket_counts(texts: DataFrame, text: str, width: int = WIDTH, buckets: int = BUCKETS) -> np.ndarray:
    """Occurrences of the features of all texts in each bucket."""

    def said(total: np.ndarray) -> pa.RecordBatch:
        at = np.flatnonzero(total)
        return pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    def of_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            counts: Counter = Counter()
            once: list[bytes] = []
            for line, n in zip(batch["line"].to_pylist(), batch["n"].to_pylist(), strict=True):
                if n == 1 and width == 1:
                    once.append(line)
                    continue
                for gram in line_grams(words(line), width):
                    counts[gram] += n
            counts.update(words(b"\n".join(once)))
            _buckets(counts, buckets, total)
        yield said(total)

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            counts: Counter = Counter()
            for t in batch["text"].to_pylist():
                counts.update(crossing_grams([words(x) for x in t.split(b"\n")], width))
            _buckets(counts, buckets, total)
        yield said(total)

    texts = small_batches(texts.where(F.col(text).isNotNull()))
    # explode_outer: for a plain explode, Spark adds a filter that would split the text once more
    lines = texts.select(F.explode_outer(F.split(text, "\n")).alias("line")).groupBy("line").agg(F.count("*").alias("n"))
    found = lines.select(F.col("line").cast("binary").alias("line"), "n").mapInArrow(of_lines, "bucket long, n long")
    if width > 1:
        found = found.unionByName(texts.select(F.col(text).cast("binary").alias("text")).mapInArrow(across, "bucket long, n long"))
    out = np.zeros(buckets, np.int64)
    for r in found.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def bucket_gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the natural log of the ratio of each bucket's smoothed frequencies, rounded down."""
    whole_corpus, whole_target = float(corpus.sum() + len(corpus)), float(target.sum() + len(target))
    gain = lambda s, t: math.floor(1000 * math.log((t + 1.0) * whole_corpus / ((s + 1.0) * whole_target)))
    return np.array([gain(float(s), float(t)) for s, t in zip(corpus, target, strict=True)], np.int64)


def weigh(docs: DataFrame, gains: np.ndarray, width: int = WIDTH) -> DataFrame:
    """docs (key, text) as (key, n_words, n_features, weight)."""
    buckets = len(gains)

    class Gains(dict):
        def __missing__(self, gram: bytes) -> int:
            if len(self) >= MEMORY:
                self.clear()
            found = self[gram] = int(gains[zlib.crc32(gram) % buckets])
            return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain, seen, held = Gains(), {}, 0
        for batch in batches:
            out: list[list[int]] = [[], [], []]
            for t in batch["text"].to_pylist():
                n_words = n = weight = 0
                lines = (t or b"").split(b"\n")
                for line in lines:
                    known = seen.get(line)
                    if known is None:
                        ws = words(line)
                        grams = line_grams(ws, width)
                        known = (len(ws), len(grams), sum(map(gain.__getitem__, grams)))
                        if held + len(line) > LINE_BYTES or len(seen) >= MEMORY:
                            seen.clear()
                            held = 0
                        seen[line] = known
                        held += len(line)
                    n_words, n, weight = n_words + known[0], n + known[1], weight + known[2]
                if width > 1:
                    for gram in crossing_grams([words(x) for x in lines], width):
                        n, weight = n + 1, weight + gain[gram]
                for column, x in zip(out, (n_words, n, weight), strict=True):
                    column.append(x)
            yield pa.RecordBatch.from_arrays([batch["key"], *[pa.array(c, pa.int64()) for c in out]], ["key", "n_words", "n_features", "weight"])

    kind = docs.schema["key"].dataType.simpleString()
    return small_batches(docs).select("key", F.col("text").cast("binary").alias("text")).mapInArrow(run, f"key {kind}, n_words long, n_features long, weight long")


def noise(key: Column, seed: int) -> Column:
    """Thousandths of Gumbel noise, rounded down: the same for a key in each run."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    uniform = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    return F.floor(-1000 * F.log(-F.log(uniform))).cast("long")


def resample(
    docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_text: str = "text", width: int = WIDTH, buckets: int = BUCKETS, percent: int = PERCENT,
    least_words: int = LEAST_WORDS, seed: int = SEED,
) -> DataFrame:
    """(key, n_features, weight, score, rank) of every row of docs; rank is null for those not drawn.

    Null and empty texts have no features, weight 0 and a score that is noise alone, and count as
    documents of no words; null keys hash like empty ones and come last among ties; repeated rows
    are drawn each for itself; a very long text is read as a whole; without target texts all
    targets' counts are 0; an empty table gives no rows. Other columns are not read.
    """
    checkpoint_dir(docs.sparkSession)
    docs, target = docs.select(F.col(key).alias("key"), F.col(text).alias("text")), target.select(F.col(target_text).alias("text"))
    gains = bucket_gains(bucket_counts(docs, "text", width, buckets), bucket_counts(target, "text", width, buckets))
    judged = weigh(docs, gains, width).withColumns({"score": F.col("weight") + noise(F.col("key"), seed), "open": F.col("n_words") >= least_words}).checkpoint()
    wanted = percent * judged.where("open").count() // 100
    ranked = with_position(judged, [F.col("open").desc(), F.col("score").desc(), F.col("key").asc_nulls_last()], "place")
    rank = F.when(F.col("place") < wanted, F.col("place") + 1).cast("long")
    return ranked.select(F.col("key").alias(key), "n_features", "weight", "score", rank.alias("rank"))
