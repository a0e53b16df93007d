"""Scoring of texts by a hashed maximum-entropy language model with a class-factored softmax.

A word's probability is that of its class, times that of its place in the class. The most frequent
words are classes of their own; the others share a class with those of the same last two letters. In
a class, its most frequent words have a place each, and the rest share one, in which they follow
their discounted training counts; unseen words take the share that words seen once have.

Both softmaxes see hashed features of the words before: the class softmax the last word (n-gram), the
one before it with the last skipped (skip), and both (n-gram); the softmax of places the class with
the last word. Frequent words have rows of their own, others one for their last three letters.

1. Words are counted over all training texts, summed in each task before they are shuffled.
2. Training. One pass over the texts counts what goes with each feature, and how often each context
   (the rows of the two words before) occurs. The gradient at weights of zero follows from the first
   counts alone and gives the first step. Each further round computes what the model expects in every
   context, in parallel, times its count, and updates all weights once: this is the gradient over all
   training tokens, at the cost of the distinct contexts, whose number has a bound. What places
   expect follows from how often classes follow words, which the first counts hold. Tasks' sums are
   cut into blocks and added in two levels, so that no group grows faster than their number's root.
3. Texts are scored in batches. The counts of the most frequent words, a fixed number, are at hand
   in each task; the other words of each text meet their counts in a join, so nothing that grows
   with the corpus is broadcast.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillbom.llm.shared import checkpoint_dir, small_batches

#: Classes: words of their own (the end of a text among them), and spellings with one for the rest.
SINGLE = 16
SPELLINGS = 48
#: Places in a class; the last is that of all words without one.
PLACES = 64
#: Rows of the word features, those that single words own among them, of the pair feature, and of the places' feature.
WORD_ROWS = 4096
OWN_ROWS = 2048
PAIR_ROWS = 8192
PLACE_ROWS = 4096
#: Words whose counts every task holds.
HELD_WORDS = 1 << 17
#: Distinct words a task counts before it passes them on.
COUNTED_WORDS = 1 << 19
#: Rounds after the first step, step of the first and of the further ones, of pairs and of places, and prior counts, those of pairs apart.
ROUNDS = 4
FIRST_STEP = 0.4
STEP = 0.4
PAIR_STEP = 0.4
PLACE_STEP = 0.5
PRIOR, PAIR_PRIOR = 1.0, 30.0
#: Blocks that a task's sums and contexts are cut into; contexts at a time for scores and for sums; tokens whose contexts a task holds one by one.
SUM_BLOCKS = 16
CONTEXT_BLOCKS = 64
TOKENS = 1 << 13
WIDE = 1 << 16
WAITING = 1 << 22
#: Tasks of a round, each of which passes on sums as large as the model: contexts are bounded in number, so these are enough.
ROUND_TASKS = 8
#: Taken from each count inside the last place.
DISCOUNT = 0.5
NEVER = -1e4
END = "\n"  # no word holds white space


def tokens(text: str | None) -> list[str]:
    """Words between ASCII white space, A-Z in lower case, and one end."""
    words = b" ".join(text.encode().lower().split()).decode() if text else ""  # bytes: ASCII only
    return [*words.split(" "), END] if words else [END]


def in_training(key: Column) -> Column:
    """Rows that the model learns from; null keys count as the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 5 != 1


def count_words(texts: DataFrame) -> DataFrame:
    """(word, n) over all rows' texts t."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: Counter = Counter()
        for rows in batches:
            for t in rows["t"]:
                counts.update(tokens(t))
                if len(counts) > COUNTED_WORDS:
                    yield pd.DataFrame({"word": list(counts), "n": list(counts.values())})
                    counts.clear()
        if counts:
            yield pd.DataFrame({"word": list(counts), "n": list(counts.values())})

    return texts.mapInPandas(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass(frozen=True)
class Vocabulary:
    """Class, place and feature row of each word."""

    singles: list[str]
    spellings: list[str]
    places: dict[str, int]
    rows: dict[str, int]

    def __post_init__(self):
        object.__setattr__(self, "single", {w: i for i, w in enumerate(self.singles)})
        object.__setattr__(self, "spelling", {s: len(self.singles) + i for i, s in enumerate(self.spellings)})

    @property
    def classes(self) -> int:
        return len(self.singles) + len(self.spellings) + 1

    def coder(self) -> Callable[[str], int]:
        """class + place * 2**8 + row * 2**16 of a word."""
        single, spelling, places, rows = self.single, self.spelling, self.places, self.rows
        rest, last, by_tail = self.classes - 1, PLACES - 1, {}

        def code(word: str) -> int:
            row = rows.get(word)
            if row is None:
                tail = word[-3:]
                row = by_tail.get(tail)
                if row is None:
                    row = OWN_ROWS + zlib.crc32(tail.encode()) % (WORD_ROWS - OWN_ROWS - 1)
                    if len(by_tail) < HELD_WORDS:
                        by_tail[tail] = row
            elif word in single:
                return single[word] + (row << 16)
            return spelling.get(word[-2:], rest) + (places.get(word, last) << 8) + (row << 16)

        return code

    def class_column(self, word: Column) -> Column:
        """The class as a Spark expression."""
        known = lambda table: F.create_map(*[F.lit(x) for kv in table.items() for x in kv]) if table else F.create_map().cast("map<string,int>")
        return F.coalesce(F.element_at(known(self.single), word), F.element_at(known(self.spelling), F.right(word, F.lit(2))), F.lit(self.classes - 1))


START = WORD_ROWS - 1


def choose_vocabulary(counts: DataFrame) -> tuple[Vocabulary, dict[str, int]]:
    """The vocabulary, and the counts of all words that have a place, a class or a row of their own."""
    frequent = counts.orderBy(F.desc("n"), "word").limit(OWN_ROWS).collect()
    known = {r["word"]: r["n"] for r in frequent}
    singles = [w for w in known if w != END][: SINGLE - 1] + [END]
    rest = counts.where(~F.col("word").isin(singles))
    # words of one letter are left to the class for the rest: a class of their own would keep a share for unseen words that can't be
    spellings = rest.where(F.length("word") > 1).groupBy(F.right("word", F.lit(2)).alias("s")).agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "s").limit(SPELLINGS - 1).collect()
    vocabulary = Vocabulary(singles, [r["s"] for r in spellings], {}, {w: i for i, w in enumerate(known)})
    ranked = rest.withColumn("class", vocabulary.class_column(F.col("word"))).withColumn("place", F.row_number().over(Window.partitionBy("class").orderBy(F.desc("n"), "word")))
    for r in ranked.where(F.col("place") <= PLACES - 1).collect():  # in this form only the first of each task are shuffled
        vocabulary.places[r["word"]] = r["place"] - 1
        known[r["word"]] = r["n"]
    return vocabulary, known


def most_frequent(counts: DataFrame) -> DataFrame:
    """At most HELD_WORDS words, those over a least count; only a histogram of counts is gathered to find it."""
    step = F.floor(F.log2("n") * 16)
    room, least = HELD_WORDS, None
    for r in sorted(counts.groupBy(step.alias("step")).count().collect(), reverse=True):
        if r["count"] > room:
            break
        room, least = room - r["count"], r["step"]
    return counts.where(step >= F.lit(least) if least is not None else F.lit(False))


class Shares:
    """In each class's last place: the log10 shares of known words, by count, and of an unseen word."""

    def __init__(self, size: np.ndarray, words: np.ndarray, once: np.ndarray):
        unseen = np.where(size > 0, (once + 0.5) / (size + 1), 1.0)
        self.unseen = np.log10(unseen)
        self.scale = np.where(size > 0, np.log10(np.where(unseen < 1, 1 - unseen, 1)) - np.log10(np.where(size > 0, size - DISCOUNT * words, 1)), 0.0)


def pair_rows(last: np.ndarray, before: np.ndarray) -> np.ndarray:
    return ((last * WORD_ROWS + before).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).astype(np.int64) % PAIR_ROWS


def place_rows(cls: np.ndarray, last: np.ndarray) -> np.ndarray:
    return ((cls * WORD_ROWS + last).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(40)).astype(np.int64) % PLACE_ROWS


@dataclass
class Contexts:
    """Tokens and the rows of the two words before."""

    cls: np.ndarray
    place: np.ndarray
    last: np.ndarray
    before: np.ndarray

    @staticmethod
    def of(texts: list[np.ndarray]) -> Contexts:
        """From the codes of the words of each text."""
        codes = np.concatenate(texts) if texts else np.zeros(0, np.int64)
        rows = codes >> 16
        last, before = np.full(len(rows), START), np.full(len(rows), START)
        starts = np.cumsum([0, *map(len, texts)])[:-1]
        last[1:], before[2:] = rows[:-1], rows[:-2]
        last[starts] = before[starts] = START
        second = starts[np.array([len(t) > 1 for t in texts], bool)] + 1 if texts else starts
        before[second] = START
        return Contexts(codes & 255, codes >> 8 & 255, last, before)

    @property
    def keys(self) -> np.ndarray:
        return self.last * WORD_ROWS + self.before


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the sums of their counts."""
    keys, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[starts], np.add.reduceat(counts, starts) if len(keys) else counts


class ContextCounts:
    """How often each context occurs; those of some tokens are kept one by one before they are counted."""

    def __init__(self):
        self.counted = (np.zeros(0, np.int32), np.zeros(0, np.int64))
        self.waiting: list[np.ndarray] = []

    def add(self, keys: np.ndarray) -> None:
        self.waiting.append(keys.astype(np.int32))
        if sum(map(len, self.waiting)) > WAITING:
            self.count()

    def count(self) -> None:
        if self.waiting:
            self.counted = merged([self.counted, np.unique(np.concatenate(self.waiting), return_counts=True)])
            self.waiting = []

    def blocks(self) -> Iterator[tuple[int, bytes]]:
        """Keys and counts by a hash of the key."""
        self.count()
        keys, counts = self.counted
        of = keys.astype(np.uint32) * np.uint32(2654435761) >> np.uint32(20) & np.uint32(CONTEXT_BLOCKS - 1)
        for block in range(CONTEXT_BLOCKS):
            yield block, packed(keys[of == block], counts[of == block])


def packed(keys: np.ndarray, counts: np.ndarray) -> bytes:
    return keys.astype(np.int32).tobytes() + counts.astype(np.int64).tobytes()


def unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(data) // 12
    return np.frombuffer(data, np.int32, n), np.frombuffer(data, np.int64, n, 4 * n)


_buffers: list[np.ndarray] = []


class Model:
    """Weights by feature row and class (or place), and what the words' counts alone say."""

    def __init__(self, singles: int, class_counts: np.ndarray, place_counts: np.ndarray):
        """place_counts: per class and place; -1 for places that no word has."""
        self.singles, self.classes = singles, len(class_counts)
        self.bias = np.log((class_counts + PRIOR) / (class_counts + PRIOR).sum()).astype(np.float32)
        smoothed = np.where(place_counts >= 0, place_counts + PRIOR, 0.0)
        with np.errstate(divide="ignore", invalid="ignore"):
            self.places = np.where(smoothed > 0, np.log(smoothed / smoothed.sum(axis=1, keepdims=True)), NEVER).astype(np.float32)
        self.tables = [np.zeros(shape[::-1], np.float32) for shape in self.shapes()]

    def shapes(self) -> list[tuple[int, int]]:
        """Of the sums: classes or places, feature rows."""
        return [(self.classes, WORD_ROWS), (self.classes, WORD_ROWS), (self.classes, PAIR_ROWS), (PLACES, PLACE_ROWS)]

    @staticmethod
    def _scores(tables: list[np.ndarray], rows: list[np.ndarray]) -> np.ndarray:
        """The sum of each token's rows, in a buffer that holds until the next call. Rows are taken into buffers
        that are kept, which is much faster than indexing or new arrays."""
        shape = (len(rows[0]), tables[0].shape[1])
        while len(_buffers) < 2 or _buffers[0].size < shape[0] * shape[1]:
            _buffers[:] = [np.empty(max(TOKENS * 256, shape[0] * shape[1]), np.float32) for _ in range(2)]
        out, more = (b[: shape[0] * shape[1]].reshape(shape) for b in _buffers)
        np.take(tables[0], rows[0], axis=0, out=out, mode="clip")
        for table, row in zip(tables[1:], rows[1:], strict=True):
            np.take(table, row, axis=0, out=more, mode="clip")
            out += more
        return out

    def class_scores(self, last: np.ndarray, before: np.ndarray) -> np.ndarray:
        """Unnormalised, by context and class."""
        out = self._scores(self.tables[:3], [last, before, pair_rows(last, before)])
        out += self.bias
        return out

    def place_scores(self, cls: np.ndarray, row: np.ndarray) -> np.ndarray:
        return self._scores([self.places, self.tables[3]], [cls, row])

    def _class_totals(self, keys: np.ndarray) -> np.ndarray:
        """Per context the log of the sum over classes. Contexts repeat, so what is found is kept, for the task's later batches too."""
        if not hasattr(self, "known_totals"):
            self.known_totals = np.full(WORD_ROWS * WORD_ROWS, np.nan, np.float32)
        distinct, inverse = np.unique(keys, return_inverse=True)
        new = distinct[np.isnan(self.known_totals[distinct])]
        for at in range(0, len(new), TOKENS):
            part = new[at:at + TOKENS]
            self.known_totals[part] = np.log(_total(self.class_scores(part // WORD_ROWS, part % WORD_ROWS)))
        return self.known_totals[distinct][inverse].astype(np.float64)

    def _place_totals(self, cls: np.ndarray, row: np.ndarray) -> np.ndarray:
        """The same over places; there are few pairs of class and row, so all are computed at once."""
        if not hasattr(self, "place_totals"):
            classes, rows = np.divmod(np.arange(self.classes * PLACE_ROWS), PLACE_ROWS)
            self.place_totals = np.concatenate([np.log(_total(self.place_scores(classes[at:at + TOKENS], rows[at:at + TOKENS]))) for at in range(0, len(classes), TOKENS)])
        return self.place_totals[cls * PLACE_ROWS + row]

    def log_shares(self, c: Contexts) -> np.ndarray:
        """Per token the natural log of its class's share times its place's."""
        own = self.bias[c.cls].astype(np.float64)
        for table, row in zip(self.tables[:3], (c.last, c.before, pair_rows(c.last, c.before)), strict=True):
            own += table[row, c.cls]
        out = own - self._class_totals(c.keys)
        of = np.flatnonzero(c.cls >= self.singles)
        cls, place = c.cls[of], c.place[of]
        row = place_rows(cls, c.last[of])
        out[of] += self.places[cls, place].astype(np.float64) + self.tables[3][row, place] - self._place_totals(cls, row)
        return out

    def seen(self, sums: list[np.ndarray], c: Contexts) -> None:
        """Adds what goes with each feature row."""
        for table, row in zip(sums, (c.last, c.before, pair_rows(c.last, c.before))):
            table += np.bincount(c.cls * table.shape[1] + row, minlength=table.size).reshape(table.shape)
        of = np.flatnonzero(c.cls >= self.singles)
        sums[3] += np.bincount(c.place[of] * PLACE_ROWS + place_rows(c.cls[of], c.last[of]), minlength=sums[3].size).reshape(sums[3].shape)

    def expected(self, sums: list[np.ndarray], keys: np.ndarray, counts: np.ndarray) -> None:
        """Adds what the model expects with each feature row of the class softmax, in contexts that occur so often."""
        for at in range(0, len(keys), WIDE):
            last, before = np.divmod(keys[at:at + WIDE].astype(np.int64), WORD_ROWS)
            shares = np.empty((self.classes, len(last)), np.float32)
            for lo in range(0, len(last), TOKENS):
                shares[:, lo:lo + TOKENS] = _shares(self.class_scores(last[lo:lo + TOKENS], before[lo:lo + TOKENS])).T
            shares *= counts[at:at + WIDE].astype(np.float32)
            add_rows(sums[:3], (last, before, pair_rows(last, before)), shares)

    def expected_places(self, seen: list[np.ndarray]) -> np.ndarray:
        """The same for places: the classes that follow a word, and how often, are in the sums of what was seen."""
        out = np.zeros((PLACES, PLACE_ROWS))
        cls, last = np.nonzero(seen[0][self.singles:])
        cls += self.singles
        keys, counts = merged([(cls * PLACE_ROWS + place_rows(cls, last), seen[0][cls, last])])
        for at in range(0, len(keys), TOKENS):
            classes, rows = np.divmod(keys[at:at + TOKENS], PLACE_ROWS)
            shares = _shares(self.place_scores(classes, rows))
            shares *= counts[at:at + TOKENS, None].astype(np.float32)
            add_rows([out], (rows,), np.ascontiguousarray(shares.T))
        return out

    def first_step(self, seen: list[np.ndarray]) -> None:
        """With weights of zero the model expects the classes' own shares in every row."""
        share = np.exp(self.bias.astype(np.float64))[:, None]
        for table, counts, prior in zip(self.tables[:3], seen, (PRIOR, PRIOR, PAIR_PRIOR)):
            table += (FIRST_STEP * np.log((counts + prior * share) / (counts.sum(axis=0) * share + prior * share))).T.astype(np.float32)

    def step(self, seen: list[np.ndarray], told: list[np.ndarray]) -> None:
        """The gradient of each weight, scaled by its counts; the prior counts hold back rows that are seldom seen."""
        for table, s, t, size, prior in zip(self.tables, seen, told, (STEP, STEP, PAIR_STEP, PLACE_STEP), (PRIOR, PRIOR, PAIR_PRIOR, PRIOR), strict=True):
            table += (size * (s - t) / (0.5 * (s + t) + prior)).T.astype(np.float32)


def _total(scores: np.ndarray) -> np.ndarray:
    return np.einsum("ij->i", np.exp(scores, out=scores)).astype(np.float64)


def _shares(scores: np.ndarray) -> np.ndarray:
    np.exp(scores, out=scores)
    scores *= (1 / np.einsum("ij->i", scores))[:, None]
    return scores


def add_rows(sums: list[np.ndarray], rows: tuple, shares: np.ndarray) -> None:
    """Adds shares, by class and token, to the feature rows of the tokens; sums are by class and row."""
    for k, own in enumerate(shares):
        for table, row in zip(sums, rows):
            table[k] += np.bincount(row, own, table.shape[1])


class _Codes(dict):
    """Codes of words, or places of held ones and -1 less the code of others; kept up to a number of them."""

    def __init__(self, vocabulary: Vocabulary, held: list[str] | None = None):
        super().__init__((w, i) for i, w in enumerate(held or []))
        self.code, self.holds, self.room = vocabulary.coder(), held is not None, 2 * HELD_WORDS

    def __missing__(self, word: str) -> int:
        found = -1 - self.code(word) if self.holds else self.code(word)
        if self.room:
            self.room -= 1
            self[word] = found
        return found


_PARTS = "kind int, block int, data binary"
_SUMS, _CONTEXTS = 0, 1


def _sum_rows(sums: list[np.ndarray]) -> tuple[list[int], list[bytes]]:
    """The sums in blocks."""
    flat = np.concatenate([s.reshape(-1) for s in sums]).astype(np.float32)
    cuts = np.linspace(0, len(flat), SUM_BLOCKS + 1).astype(int)
    return list(range(SUM_BLOCKS)), [flat[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:])]


def _added(parts: DataFrame) -> DataFrame:
    """The blocks of all tasks, added in two levels, first those of a root of the number of tasks each; in one where there are few."""
    tasks = parts.rdd.getNumPartitions()
    salts = math.isqrt(tasks)

    def add(kind: type) -> Callable:
        def run(rows: pd.DataFrame) -> pd.DataFrame:
            if rows["kind"].iloc[0] == _CONTEXTS:
                data = packed(*merged([unpacked(d) for d in rows["data"]]))
            else:
                total = np.zeros(len(rows["data"].iloc[0]) // np.dtype(kind).itemsize)
                for d in rows["data"]:
                    total += np.frombuffer(d, kind)
                data = total.tobytes()
            return pd.DataFrame({"kind": rows["kind"].iloc[:1], "block": rows["block"].iloc[:1], "data": [data]})

        return run

    if tasks <= 2 * ROUND_TASKS:
        return parts.groupBy("kind", "block").applyInPandas(add(np.float32), _PARTS)
    salted = parts.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
    return salted.groupBy("kind", "block", "salt").applyInPandas(add(np.float32), _PARTS).groupBy("kind", "block").applyInPandas(add(np.float64), _PARTS)


def _unfolded(rows: list, shapes: list[tuple[int, int]]) -> list[np.ndarray]:
    sizes = [math.prod(shape) for shape in shapes]
    flat = np.concatenate([np.frombuffer(r["data"]) for r in sorted(rows, key=lambda r: r["block"])]) if rows else np.zeros(sum(sizes))
    ends = np.cumsum(sizes)
    return [flat[e - n:e].reshape(shape) for e, n, shape in zip(ends, sizes, shapes, strict=True)]


def gathered(texts: DataFrame, vocabulary: Vocabulary, model: Model) -> tuple[list[np.ndarray], DataFrame]:
    """What goes with each feature row in all texts, and (data): their contexts in blocks, with their numbers."""
    sent = texts.sparkSession.sparkContext.broadcast((vocabulary, model))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vocabulary, model = sent.value
        codes, sums, contexts, any_rows = _Codes(vocabulary), [np.zeros(shape) for shape in model.shapes()], ContextCounts(), False
        for rows in batches:
            words = [tokens(t) for t in rows["t"]]
            c = Contexts.of([np.fromiter(map(codes.__getitem__, w), np.int64, len(w)) for w in words])
            model.seen(sums, c)
            contexts.add(c.keys)
            any_rows |= len(rows) > 0
        if any_rows:
            blocks, data = _sum_rows(sums)
            yield pd.DataFrame({"kind": _SUMS, "block": blocks, "data": data})
            blocks, data = zip(*contexts.blocks(), strict=True)
            yield pd.DataFrame({"kind": _CONTEXTS, "block": blocks, "data": data})

    rows = _added(texts.mapInPandas(run, _PARTS)).repartition(CONTEXT_BLOCKS, "block").checkpoint()
    seen = _unfolded(rows.where(F.col("kind") == _SUMS).collect(), model.shapes())
    return seen, rows.where(F.col("kind") == _CONTEXTS).select("data")


def expected(contexts: DataFrame, model: Model, seen: list[np.ndarray]) -> list[np.ndarray]:
    """What the model expects with each feature row in all contexts."""
    sent = contexts.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, sums = sent.value, None
        for rows in batches:
            for data in rows["data"]:
                sums = sums or [np.zeros(shape) for shape in model.shapes()[:3]]
                model.expected(sums, *unpacked(data))
        if sums:
            blocks, data = _sum_rows(sums)
            yield pd.DataFrame({"kind": _SUMS, "block": blocks, "data": data})

    told = _unfolded(_added(contexts.coalesce(ROUND_TASKS).mapInPandas(run, _PARTS)).collect(), model.shapes()[:3])
    sent.unpersist()
    return [*told, model.expected_places(seen)]


def train(texts: DataFrame, vocabulary: Vocabulary, model: Model, rounds: int = ROUNDS) -> None:
    seen, contexts = gathered(texts, vocabulary, model)
    model.first_step(seen)
    for _ in range(rounds):
        model.step(seen, expected(contexts, model, seen))


@dataclass
class Scorer:
    """All that a task needs, but for the counts of words that are not held."""

    vocabulary: Vocabulary
    model: Model
    shares: Shares
    held: str  # one string: words as Python objects take ten times the room
    counts: np.ndarray
    everything: int
    under: float


def fit(training: DataFrame, rounds: int = ROUNDS) -> tuple[Scorer, DataFrame]:
    """The model of all texts t, and the counts of all words."""
    counts = count_words(training).checkpoint()
    vocabulary, known = choose_vocabulary(counts)
    by_class = counts.groupBy(vocabulary.class_column(F.col("word")).alias("class")).agg(F.sum("n").alias("size"), F.count("*").alias("words"), F.count(F.when(F.col("n") == 1, 1)).alias("once"))
    size, words, once = np.zeros((3, vocabulary.classes))
    for r in by_class.collect():
        size[r["class"]], words[r["class"]], once[r["class"]] = r["size"], r["words"], r["once"]
    everything, distinct = int(size.sum()), int(words.sum())
    class_counts, n = size.copy(), len(vocabulary.singles)
    place_counts = np.full((vocabulary.classes, PLACES), -1.0)
    code = vocabulary.coder()
    for w, place in vocabulary.places.items():
        c = code(w) & 255
        place_counts[c, place] = known[w]
        size[c] -= known[w]
        words[c] -= 1
        once[c] -= known[w] == 1
    size[:n] = words[:n] = once[:n] = 0
    place_counts[:, PLACES - 1] = size
    model = Model(n, class_counts, place_counts)
    train(training, vocabulary, model, rounds)
    held = most_frequent(counts).toPandas()
    present = set(held["word"])
    more = [w for w in known if w not in present]
    joined = " ".join([*held["word"], *more])
    numbers = np.concatenate([held["n"].to_numpy(np.int64), np.array([known[w] for w in more], np.int64)])
    return Scorer(vocabulary, model, Shares(size, words, once), joined, numbers, everything, math.log10(everything + 0.5 * (distinct + 1))), counts


def score(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, held_out, n_tokens, n_known, train_tokens, base_score and score (log10).

    base_score is the smoothed unigram score. Null and empty texts hold the end only; repeated rows
    are scored each, and counted each if they are in training. All rows with a null key train. A very
    long text is scored in blocks; an empty table gives no rows. Other columns of docs, of any name,
    are not read.
    """
    spark = docs.sparkSession
    checkpoint_dir(spark)
    training = small_batches(docs).where(in_training(F.col(key))).select(F.col(text).alias("t"))
    scorer, counts = fit(training)
    vocabulary, shares, under = scorer.vocabulary, scorer.shares, scorer.under
    sent = spark.sparkContext.broadcast(scorer)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        s = sent.value
        held = s.held.split(" ") if len(s.counts) else []
        places = _Codes(s.vocabulary, held)
        n = s.counts.astype(np.float64)
        code_of = np.array(list(map(s.vocabulary.coder(), held)), np.int64)
        base = np.log10(n + 0.5) - s.under
        shared = (code_of & 255 >= s.model.singles) & (code_of >> 8 & 255 == PLACES - 1)
        inside = np.where(shared, np.log10(np.maximum(n - DISCOUNT, 1e-300)) + s.shares.scale[code_of & 255], 0.0)
        for batch in batches:
            rows = batch.reset_index(drop=True)
            texts = [tokens(t) for t in rows["t"]]
            where = [np.fromiter(map(places.__getitem__, words), np.int64, len(words)) for words in texts]
            coded = [np.where(at < 0, -1 - at, code_of[np.maximum(at, 0)]) if len(held) else -1 - at for at in where]
            rare = [Counter(words[i] for i in np.flatnonzero(at < 0)) for words, at in zip(texts, where, strict=True)]
            logs = s.model.log_shares(Contexts.of(coded)) / math.log(10)
            sizes = np.array([max(1, len(r)) for r in rare])
            first = np.cumsum(sizes) - sizes  # a text's own figures stand in the first of its rows
            figures = {c: np.zeros(sizes.sum(), t) for c, t in (("n_tokens", np.int64), ("n_known", np.int64), ("base", np.float64), ("own", np.float64))}
            offsets = np.cumsum([0, *map(len, where)])[:-1]
            at = np.concatenate(where) if where else np.zeros(0, np.int64)
            known = at >= 0
            own = np.where(known, at, 0)
            for c, values in (("n_tokens", np.ones(len(at), np.int64)), ("n_known", known.astype(np.int64)), ("base", np.where(known, base[own], 0.0) if len(held) else np.zeros(len(at))), ("own", logs + np.where(known, inside[own], 0.0) if len(held) else logs)):
                figures[c][first] = np.add.reduceat(values, offsets) if len(offsets) else values
            words, times = [], []
            for r, number in zip(rare, rows["rid"], strict=True):
                words.extend(r or (f"{END}{number % 1024}",))
                times.extend(r.values() if r else (0,))
            of = np.repeat(np.arange(len(rows)), sizes)
            yield pd.DataFrame({"rid": rows["rid"].to_numpy()[of], "k": rows["k"].iloc[of].reset_index(drop=True), "word": words, "times": times} | figures)

    kind = docs.schema[key].dataType.simpleString()
    numbered = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(key).alias("k"), F.col(text).alias("t"))
    parts = numbered.mapInPandas(run, f"rid long, k {kind}, word string, times long, n_tokens long, n_known long, base double, own double")
    joined = parts.join(counts, "word", "left")
    of_class = lambda values: F.element_at(F.array(*[F.lit(float(v)) for v in values]), vocabulary.class_column(F.col("word")) + 1)
    known = F.col("n").isNotNull()
    inside = F.when(known, F.log10(F.col("n") - DISCOUNT) + of_class(shares.scale)).otherwise(of_class(shares.unseen))
    times = F.col("times")
    summed = joined.groupBy("rid").agg(
        F.max("k").alias(key),
        F.sum("n_tokens").alias("n_tokens"),
        F.sum(F.col("n_known") + F.when(known, times).otherwise(0)).alias("n_known"),
        F.sum(F.col("base") + F.when(times > 0, times * (F.log10(F.coalesce("n", F.lit(0)) + 0.5) - under)).otherwise(0.0)).alias("base_score"),
        F.sum(F.col("own") + F.when(times > 0, times * inside).otherwise(0.0)).alias("score"),
    )
    return summed.select(key, (~in_training(F.col(key))).alias("held_out"), "n_tokens", "n_known", F.lit(scorer.everything).cast("long").alias("train_tokens"), "base_score", "score")
