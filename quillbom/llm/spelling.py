"""Spelling variants: words that differ by one inserted, deleted or replaced letter, grouped by frequency.

The near words of a word are found on a bit-sliced position index: for each place and letter a bit
set over the vocabulary tells which words have that letter there. A recurrence over the letters of
a query keeps, for all words of the vocabulary at once, the set without an error so far and the sets
with one error, one for each shift of the positions behind it (replaced: none, inserted: one to the
right, deleted: one to the left).

The vocabulary is cut into groups that near words must share, so that no index holds all of it: two
near words of at least m letters, the longer of at most m + 1, share their first or their last m // 2
letters. Each word is in four groups, as the shorter and as the longer of a pair, by its beginning
and by its end, and a pair that shares both is counted by its beginning only. Groups of more than
BLOCK words are cut into blocks of the index and blocks of queries, each of which meets each; a
query gives one row a block, never its pairs.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillbom.llm.shared import checkpoint_dir, small_batches

#: Words have at least so many letters and occurrences.
LETTERS = 6
OCCURRENCES = 5
#: A word's near word is its form if it is at least so many times as frequent.
RATIO = 5
#: Words of a group that an index holds, and queries that meet it in one task, at most.
BLOCK = 16_384
#: Different words that a task counts before it passes them on.
COUNTED = 1 << 18
#: Runs whose hash this divides lose a letter: a planted slip of the pen.
SLIPS = 199

_lower = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def runs(text: str, least: int) -> Counter:
    """Maximal runs of letters (A-Z, a-z, U+00C0 to U+00FF) of at least so many, A-Z in lower case, in Latin-1."""
    return Counter(re.findall(rb"[a-z\xC0-\xFF]{%d,}" % least, text.encode("latin-1", "replace").translate(_lower)))


def slip(run: bytes, key: bytes, every: int) -> bytes:
    """The run, or the run without one letter where the hash says so. Both are Latin-1; the hash is that of UTF-8."""
    said = run if run.isascii() else run.decode("latin-1").encode()
    h = zlib.crc32(said, zlib.crc32(key + b":"))
    if h % every:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1:]


def vocabulary(docs: DataFrame, key: str = "doc_id", text: str = "text", letters: int = LETTERS, occurrences: int = OCCURRENCES, slips: int | None = None) -> DataFrame:
    """(word, n): words of all texts with their occurrences. Null and empty texts have none; a null key counts as an empty one."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()

        def said() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in found], pa.string()), pa.array(list(found.values()), pa.int64())], ["word", "n"])
            found.clear()
            return out

        for batch in batches:
            for of, t in zip(batch["key"].to_pylist(), batch["text"].to_pylist(), strict=True):
                here = runs(t, letters)
                if slips:
                    of = (of or "").encode()
                    for run in list(here):
                        if (cut := slip(run, of, slips)) is not run:
                            n = here.pop(run)
                            if len(cut) >= letters:
                                found[cut] += n
                found.update(here)
                if len(found) >= COUNTED:
                    yield said()
        yield said()

    texts = small_batches(docs.where(F.col(text).isNotNull())).select(F.col(key).cast("string").alias("key"), F.col(text).alias("text"))
    return texts.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= occurrences)


class Index:
    """Bit sets over words: bit i stands for words[i]."""

    def __init__(self, words: list[str]):
        at: dict[tuple[int, str], bytearray] = {}
        lengths: dict[int, bytearray] = {}
        size = (len(words) + 7) // 8
        for i, w in enumerate(words):
            byte, bit = i >> 3, 1 << (i & 7)
            for place in enumerate(w):
                if place not in at:
                    at[place] = bytearray(size)
                at[place][byte] |= bit
            lengths.setdefault(len(w), bytearray(size))[byte] |= bit
        self.all = (1 << len(words)) - 1
        self.at: dict[int, dict[str, int]] = defaultdict(dict)
        for (p, letter), bits in at.items():
            self.at[p][letter] = int.from_bytes(bits, "little")
        self.of_length = {n: int.from_bytes(bits, "little") for n, bits in lengths.items()}

    def near(self, word: str, shared: int) -> tuple[int, int]:
        """(words at one error, words that begin like the first `shared` letters), as bit sets.

        exact: no error so far. replaced, longer, shorter: one error so far, after which the words'
        letters stand as in the query, one place to the right, or one to the left.
        """
        exact, replaced, longer, shorter, alike = self.all, 0, 0, 0, self.all
        here, none = self.at[0], {}
        before = none
        for i, letter in enumerate(word):
            after = self.at[i + 1] if i + 1 in self.at else none
            same = here.get(letter, 0)
            longer = (longer | exact) & after.get(letter, 0)
            shorter = shorter & before.get(letter, 0) | exact
            replaced = replaced & same | exact
            exact &= same
            if i + 1 == shared:
                alike = exact
            before, here = here, after
        n, lengths = len(word), self.of_length
        found = replaced & ~exact & lengths.get(n, 0) | (longer | exact) & lengths.get(n + 1, 0) | shorter & lengths.get(n - 1, 0)
        return found, alike


def group_rows(side: str, shorter: int, words: list[tuple], roles: list[int]) -> Iterator[tuple[str, int, str, int]]:
    """(word, near words, the most frequent of these, its n) of the queries of one group that have any.

    words: (word, n), the most frequent first and ties by letters, so the lowest bit is the best one.
    roles: 1 for the index, 2 for a query, 3 for both.
    """
    indexed = [w for w, role in zip(words, roles, strict=True) if role & 1]
    index = Index([w for w, _ in indexed])
    short, long = index.of_length.get(shorter, 0), index.of_length.get(shorter + 1, 0)
    for (word, _), role in zip(words, roles, strict=True):
        if role & 2:
            found, alike = index.near(word, shorter // 2)
            found &= short | long if len(word) == shorter else short  # two of the longer ones are a pair of another group
            if side == "e":
                found &= ~alike
            if found:
                best = indexed[(found & -found).bit_length() - 1]
                yield word, found.bit_count(), *best


def near_words(vocabulary: DataFrame, letters: int = LETTERS, block: int = BLOCK) -> DataFrame:
    """(word, n_near, best, best_n) of the words that have near words: their number and the most frequent, ties to the first in code-point order."""
    size = F.length("word")
    of = lambda m, least: F.when(m >= least, F.array(
        F.struct(F.concat(F.lit("b"), F.lpad(m.cast("string"), 9, "0"), F.left("word", F.floor(m / 2).cast("int"))).alias("group"), m.cast("int").alias("shorter")),
        F.struct(F.concat(F.lit("e"), F.lpad(m.cast("string"), 9, "0"), F.right("word", F.floor(m / 2).cast("int"))).alias("group"), m.cast("int").alias("shorter")),
    )).otherwise(F.array())
    grouped = vocabulary.select("word", "n", F.explode(F.concat(of(size, 0), of(size - 1, letters))).alias("g")).select("word", "n", "g.*")
    counts = grouped.groupBy("group").agg(F.count("*").alias("rows")).where("rows > 1")
    blocks = F.ceil(F.col("rows") / block).cast("int")
    own = F.pmod(F.xxhash64("word"), blocks.cast("long")).cast("int")
    every = F.sequence(F.lit(0), blocks - 1)
    dealt = F.when(blocks <= 1, F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(3).alias("role")))).otherwise(
        F.concat(
            F.transform(every, lambda j: F.struct(own.alias("i"), j.alias("j"), F.when(own == j, 3).otherwise(1).alias("role"))),
            F.filter(F.transform(every, lambda i: F.struct(i.alias("i"), own.alias("j"), F.lit(2).alias("role"))), lambda x: x["i"] != own),
        )
    )
    rows = grouped.join(counts, "group").select("group", "shorter", "word", "n", F.explode(dealt).alias("d")).select("group", "shorter", "d.*", "word", "n")
    order = ["group", "i", "j", F.col("n").desc(), "word"]
    rows = rows.repartition(int(vocabulary.sparkSession.conf.get("spark.sql.shuffle.partitions")), "group", "i", "j").sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, words, roles, out = None, [], [], []

        def said() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [[], [], [], []]
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.string(), pa.int64()), strict=True)], ["word", "n_near", "best", "best_n"])

        for batch in batches:
            for group, shorter, i, j, role, word, n in zip(*(batch[c].to_pylist() for c in ("group", "shorter", "i", "j", "role", "word", "n")), strict=True):
                if (group, i, j) != now:
                    if len(words) > 1:
                        out += group_rows(now[0][0], at, words, roles)
                        if len(out) >= 10_000:
                            yield said()
                    now, at, words, roles = (group, i, j), shorter, [], []
                words.append((word, n))
                roles.append(role)
        if len(words) > 1:
            out += group_rows(now[0][0], at, words, roles)
        yield said()

    found = rows.mapInArrow(run, "word string, n_near long, best string, best_n long")
    best = F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("word")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", F.col("b.word").alias("best"), (-F.col("b.less")).alias("best_n"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for every word that has a form: the last of the forms that follow each other.

    Each round doubles the steps that a pointer spans; frequencies grow by the ratio with each step,
    so a few rounds are enough for any vocabulary.
    """
    checkpoint_dir(forms.sparkSession)
    steps = forms.select("word", F.col("form").alias("root")).checkpoint()
    while True:
        ahead = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        joined = steps.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")).checkpoint()
        steps = joined.select("word", "root")
        if not joined.where("moved").limit(1).count():
            return steps


def variants(
    docs: DataFrame, key: str = "doc_id", text: str = "text", letters: int = LETTERS, occurrences: int = OCCURRENCES, ratio: int = RATIO, slips: int | None = None, block: int = BLOCK,
) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of the vocabulary.

    Null and empty texts have no words; null keys matter to slips only; repeated rows count each;
    very long texts and words are read as a whole; an empty table gives no rows; other columns are
    not read.
    """
    checkpoint_dir(docs.sparkSession)
    words = vocabulary(docs, key, text, letters, occurrences, slips).checkpoint()
    found = words.join(near_words(words, letters, block), "word", "left")
    has = F.col("best_n") >= ratio * F.col("n")
    formed = found.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(has, F.col("best")).alias("form"), F.when(has, F.col("best_n")).alias("form_n")).checkpoint()
    last = roots(formed.where("form is not null"))
    return formed.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
