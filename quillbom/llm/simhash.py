"""Near-duplicate groups by SimHash and meet-in-the-middle ball hashing.

Two fingerprints at most r bits apart have a common neighbour at most r/2 bits from each. So every
distinct fingerprint emits all its variants within half the radius; fingerprints that share a
variant are linked, and after deduplication a variant has at most as many of them as variants
itself, however large a group of copies is. All links of a variant lie within the radius of each
other, hence a star of links carries the same components as all pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations, pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillbom.llm import overlap
from quillbom.llm.shared import checkpoint_dir, connected_components, join_hot, slices, small_batches

#: Shingle hashes that are counted at a time.
BLOCK = 1 << 17
#: Bits and number of the short fingerprints of near_copies(), least hashes a text, and words of the long fingerprint.
BITS, TABLES, MINIMA, LONG_WORDS = 16, 4, 3, 4
#: Texts of a block whose fingerprints are held against those of another in one task, on average.
BLOCK_TEXTS = 1 << 14
#: Shingles of a block of texts that is compared in one task, on average.
BLOCK_SHINGLES = 1 << 18


def _majority(hashes: list[np.ndarray]) -> np.ndarray:
    """Bits set in over half the hashes of each text, as unsigned 64-bit fingerprints."""
    sizes = np.array([len(h) for h in hashes], np.int64)
    counts = np.zeros((len(hashes), 64), np.int64)
    for i, h in enumerate(hashes):
        for at in range(0, len(h), BLOCK):
            counts[i] += np.unpackbits(h[at:at + BLOCK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * counts > sizes[:, None]).astype(np.uint8)
    return np.packbits(bits, axis=1, bitorder="little").reshape(-1).view("<u8")


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """XXH64 (seed 42) of the shingles of a text; one for all words where there are fewer than width."""
    words = text.encode().lower().split() if text else []  # bytes: A-Z, and ASCII white space only
    if not words:
        return np.zeros(0, np.uint64)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    if len(words) < width:
        return np.array([digest(join(words), 42)], np.uint64)
    return np.array([digest(join(s), 42) for s in zip(*(words[k:] for k in range(width)))], np.uint64)


def fingerprints(docs: DataFrame, width: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fp): the 64-bit fingerprint of each row as a signed long; texts without words have 0."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in slices(batches):
            prints = _majority([shingle_hashes(t, width) for t in rows["t"]]) if len(rows) else np.zeros(0, np.uint64)
            yield rows[["k"]].assign(fp=prints.astype(np.uint64).view(np.int64))

    kind = docs.schema[key].dataType.simpleString()
    found = small_batches(docs).select(F.col(key).alias("k"), F.col(text).alias("t")).mapInPandas(run, f"k {kind}, fp long")
    return found.withColumnRenamed("k", key)


def ball(half: int) -> list[int]:
    """Masks that flip up to half of 64 bits, as signed numbers."""
    masks = [sum(1 << b for b in bits) for n in range(half + 1) for bits in combinations(range(64), n)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def spread(rows: DataFrame, column: str) -> DataFrame:
    """rows dealt to as many tasks as shuffles have, before they multiply: rows this small would be coalesced to few
    tasks, and a repartitioning by the column itself would be left out where rows are dealt by it already."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64(F.lit("spread"), F.col(column)))


def links(prints: DataFrame, radius: int = 2) -> DataFrame:
    """Star links (a, b) between distinct fingerprints fp, with the components of all pairs within an even radius."""
    if radius % 2:
        raise ValueError("the radius must be even")
    variants = spread(prints, "fp").select("fp", F.explode(F.array(*[F.lit(m) for m in ball(radius // 2)])).alias("flip"))
    met = variants.groupBy(F.col("fp").bitwiseXOR(F.col("flip")).alias("variant")).agg(F.collect_list("fp").alias("met"))
    met = met.where(F.size("met") > 1).select(F.array_min("met").alias("a"), F.explode("met").alias("b"))
    return met.where("a <> b").distinct()


def near_duplicate_groups(docs: DataFrame, width: int = 3, radius: int = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fingerprint, component_id) per row: the smallest key reachable over links, itself included.

    Null and empty texts share fingerprint 0. Rows with a null key belong to the group of their
    text, whose id is the smallest known key (null if there is none). Repeated rows stay repeated; a
    very long text is hashed in blocks; an empty table gives no rows. Other columns of docs, of any
    name, are not read.
    """
    checkpoint_dir(docs.sparkSession)
    marked = fingerprints(docs.select(F.col(key).alias("k"), F.col(text).alias("t")), width, "k", "t").checkpoint()
    prints = marked.groupBy("fp").agg(F.min("k").alias("least"), F.count("*").alias("rows")).checkpoint()
    roots = connected_components(links(prints, radius))
    grouped = prints.join(roots, prints["fp"] == roots["node"])
    smallest = grouped.groupBy("root").agg(F.min("least").alias("component"))
    of_print = grouped.select("fp", "root").join(smallest, "root").select("fp", "component")
    named = prints.join(of_print, "fp", "left").select("fp", "rows", F.coalesce("component", "least").alias("component_id"))
    found = join_hot(marked, named, "fp", marked.count())
    return found.select(F.col("k").alias(key), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# Near copies by similarity. At a Jaccard similarity of 0.8 one bit in seven differs, too many for
# one ball of 64 bits. So there are TABLES fingerprints of BITS bits, which meet at 2 differing bits or
# fewer in one of them. Bits so few would bring all documents of a large corpus together, so only texts that
# share one of MINIMA least shingle hashes, a family, are held against each other (the chance of one is the
# similarity itself), and chance meetings don't grow with the corpus. Texts that meet are held against all bits,
# then against the shingles themselves.
# All this goes on inside tasks, to which families are dealt whole, or large ones in blocks: neither pairs of texts nor
# variants of fingerprints are rows. First the texts are found that are close to any other; only these have their
# shingles made. Then each block is compared in itself and with the family's first text, which joins a large
# group of copies at once. Only families of several blocks that are not one group after that have their blocks
# compared with each other, again only those texts that are close to one of another group. A block gives one
# link for each group that it joins to another.
# Some pairs don't meet this way, so the rest is found exactly: only texts that share shingles enough with texts of other
# groups (overlap.py) can be linked to one, and these are held against each other by shingles alone, again in blocks.


def meeting_chance(similarity: float) -> float:
    """The chance that a pair of texts of that similarity meets by fingerprints; those that don't are found by their shingles."""
    differ = math.acos(2 * similarity / (1 + similarity)) / math.pi
    ball = sum(math.comb(BITS, n) * differ**n * (1 - differ) ** (BITS - n) for n in range(3))
    return (1 - (1 - similarity) ** MINIMA) * (1 - (1 - ball) ** TABLES)


def _long_fingerprints(hashes: list[np.ndarray], words: int) -> np.ndarray:
    """words independent 64-bit fingerprints of each text."""
    out = []
    for n in range(words):
        seed = np.uint64((0x9E3779B97F4A7C15 * (2 * n + 1)) % (1 << 64))
        mixed = [(x := h * seed) ^ (x >> np.uint64(32)) for h in hashes]
        mixed = [(x := h * np.uint64(0xD6E8FEB86659FD93)) ^ (x >> np.uint64(29)) for h in mixed]
        out.append(_majority(mixed))
    return np.stack(out, axis=1)


def _minima(hashes: np.ndarray) -> list[int]:
    """The least of a text's shingle hashes, in MINIMA orders of chance; 0 for a text without shingles."""
    out = []
    for n in range(MINIMA):
        x = hashes * np.uint64((0xBF58476D1CE4E5B9 * (2 * n + 3)) % (1 << 64))
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
        out.append(int((x ^ (x >> np.uint64(29))).min()) if len(x) else 0)
    return out


def _met(longs: np.ndarray, i: int, j: np.ndarray, far: int) -> np.ndarray:
    """Those of the texts j that meet the text i in a table and differ from it in at most far bits."""
    differ = longs[j] ^ longs[i]
    near = np.flatnonzero(np.bitwise_count(differ).sum(axis=1, dtype=np.int64) <= far)
    short = differ[near, :1] >> (BITS * np.arange(TABLES, dtype=np.uint64)) & np.uint64((1 << BITS) - 1)
    return j[near[np.bitwise_count(short).min(axis=1, initial=BITS) <= 2]]


def _near(roots: np.ndarray, parts: np.ndarray, longs: np.ndarray, far: int) -> np.ndarray:
    """Which texts meet one of another group and are close to it: of the two parts one of the other part, of one part any."""
    found = np.zeros(len(roots), bool)
    low, high = parts.min(), parts.max()
    others = np.flatnonzero(parts == high)
    for i in np.flatnonzero(parts == low):
        j = others if low < high else others[i + 1:]
        j = j[~found[j]] if found[i] else j  # a text that is found only has to find others
        j = _met(longs, i, j[roots[j] != roots[i]], far)
        if len(j):
            found[i] = found[j] = True
    return found


def _joined(roots: np.ndarray, parts: np.ndarray, longs: np.ndarray | None, flat: np.ndarray, ends: np.ndarray, similarity: float, far: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) between the roots of texts, one for each group that joins another: those of pairs of the two parts (of one, where there
    is one) that meet in a table, differ in at most far bits and have sets (flat, from ends[n] to ends[n + 1]) of that similarity; all pairs meet
    where there are no fingerprints."""
    names, label = np.unique(roots, return_inverse=True)
    group = label.copy()
    sizes, of = np.diff(ends), np.repeat(np.arange(len(roots)), np.diff(ends))
    _, shingle, times = np.unique(flat, return_inverse=True, return_counts=True)
    place = np.cumsum(times > 1) - 1  # a shingle of one text alone is in no other's
    of, shingle = of[times[shingle] > 1], place[shingle[times[shingle] > 1]]
    bits = np.zeros((len(roots), int((times > 1).sum()) // 64 + 1), np.uint64)
    np.bitwise_or.at(bits, (of, shingle >> 6), np.uint64(1) << (shingle & 63).astype(np.uint64))
    low, high = parts.min(), parts.max()
    others = np.flatnonzero(parts == high)
    for i in np.flatnonzero(parts == low):
        j = others[group[others] != group[i]] if low < high else np.arange(i + 1, len(roots))[group[i + 1:] != group[i]]
        if longs is None:
            j = j[np.minimum(sizes[i], sizes[j]) >= similarity * np.maximum(sizes[i], sizes[j])]
        else:
            j = _met(longs, i, j, far)
        met = np.bitwise_count(bits[i] & bits[j]).sum(axis=1, dtype=np.int64)
        j = j[met >= similarity * (sizes[i] + sizes[j] - met)]
        if len(j):
            group[np.isin(group, group[j])] = group[i]
    end = np.zeros(len(names), np.int64)
    end[label] = group
    moved = end != np.arange(len(names))
    return names[moved], names[end[moved]]


def _keyed(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The rows of each key in turn; they come sorted by it."""
    held, last = [], None
    for batch in batches:
        columns = np.stack([batch[k].to_numpy(zero_copy_only=False) for k in keys])
        starts = np.flatnonzero(np.concatenate(([True], (columns[:, 1:] != columns[:, :-1]).any(axis=0)))[:batch.num_rows])
        for begin, end in pairwise([*starts.tolist(), batch.num_rows]):
            key = columns[:, begin].tolist()
            if held and key != last:
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
            held.append(batch.slice(begin, end - begin))
            last = key
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _matrix(block: pa.Table, words: int) -> np.ndarray:
    """The long fingerprints of the rows."""
    return block["long"].chunk(0).flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(-1, words)


def _gathered(found: Iterator[list[np.ndarray]], names: list[str]) -> Iterator[pa.RecordBatch]:
    """The rows of many small results together, as columns of long numbers."""
    held, rows = [], 0
    for columns in found:
        held.append(columns)
        rows += len(columns[0])
        if rows >= BLOCK_TEXTS:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in zip(*held, strict=True)], names)
            held, rows = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in zip(*held, strict=True)], names)


def near_copies(docs: DataFrame, width: int = 5, similarity: float = 0.8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, digest, root, root_digest) of each distinct text: its smallest key, its MD5, and both of the first of its group.

    Groups are the connected components of pairs whose shingle sets have at least that Jaccard
    similarity. Every pair that is linked has been verified. Most pairs are found by fingerprints, with
    meeting_chance() of their similarity, the others by the shingles that they share; none is left out. Null keys count as the largest number, null texts as empty; texts
    that share a key are as different as others. A very long text is hashed as a whole; an empty
    table gives no rows. Other columns of docs, of any name, are not read.
    """
    checkpoint_dir(docs.sparkSession)
    ready = small_batches(docs).select(F.coalesce(F.col(key).cast("long"), F.lit((1 << 63) - 1)).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    words = LONG_WORDS
    differ = math.acos(2 * similarity / (1 + similarity)) / math.pi
    far = math.ceil(64 * words * min(0.5, differ + 4 * math.sqrt(differ * (1 - differ) / (64 * words))))
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in slices(batches):
            sets = [np.unique(shingle_hashes(t, width)) for t in rows["t"]]  # sets, as the similarity is one of sets
            long = _long_fingerprints(sets, words)
            least = [np.array(_minima(h), np.uint64).view(np.int64) for h in sets]
            yield pd.DataFrame({"key": rows["key"], "digest": rows["digest"], "size": [len(h) for h in sets], "long": list(long.view(np.int64)), "least": least, "head": [overlap.head(h, similarity) for h in sets]})

    marked = ready.withColumn("digest", F.md5("t")).mapInPandas(run, "key long, digest string, size long, long array<long>, least array<long>, head binary")
    found = F.max_by(F.struct("size", "long", "least", "head"), "digest").alias("x")
    texts = marked.groupBy("digest").agg(F.min("key").alias("key"), found).select("digest", "key", "x.*")
    texts = texts.withColumn("node", F.monotonically_increasing_id()).checkpoint()  # fixed by the checkpoint
    # a minimum that no other text has brings nobody together, and most are such
    own = texts.select("node", "size", "long", F.posexplode("least").alias("n", "m"))
    shared = own.groupBy("n", "m").agg(F.count("*").alias("texts")).where("texts > 1")
    placed = own.join(shared, ["n", "m"]).checkpoint()
    key_columns = ["n", "m", "one", "two"]

    def blocks(rows: DataFrame, columns: list[str]) -> DataFrame:
        """The key columns and these, sorted by the keys; the rows of each key are in one task."""
        return rows.select(*key_columns, *columns).repartition(tasks, *key_columns).sortWithinPartitions(*key_columns)

    def paired(rows: DataFrame) -> DataFrame:
        """Rows of one of parts blocks, in each pair (one, two) of blocks that theirs is in; one block alone is a pair with itself."""
        rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        return rows.withColumns({"one": F.least("part", "other"), "two": F.greatest("part", "other")})

    def near(block: pa.Table) -> list[np.ndarray]:
        """The texts that are close to one of another group, of two blocks or of one."""
        nodes, roots, parts = (block[c].to_numpy() for c in ("node", "root", "part"))
        return [nodes[_near(roots, parts, _matrix(block, words), far)]]

    def close(rows: DataFrame) -> DataFrame:
        """The texts that are close to one of another root, of these rows of families."""
        parts = F.ceil(F.col("texts") / BLOCK_TEXTS).cast("int")
        dealt = paired(rows.withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("node"), parts.cast("long")).cast("int")))
        return blocks(dealt, ["part", "node", "root", "long"]).mapInArrow(lambda batches: _gathered(map(near, _keyed(batches, key_columns)), ["node"]), "node long").distinct()

    few = close(placed.withColumn("root", F.col("node"))).checkpoint()
    in_heads, in_all = (lambda n: overlap.common_in_heads(n, similarity)), (lambda n: overlap.least(n, similarity))
    heads = texts.select("node", F.col("node").alias("root"), "size", F.col("head").alias("tokens"))
    able = overlap.meeting(heads, in_heads, alone=True).select("node").checkpoint()

    def shingles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in slices(batches):
            yield pd.DataFrame({"node": rows["node"], "set": [np.unique(shingle_hashes(t, width)).view(np.int64) for t in rows["t"]]})

    chosen = ready.withColumn("digest", F.md5("t")).join(few.unionByName(able).distinct().join(texts, "node").select("node", "key", "digest"), ["key", "digest"]).dropDuplicates(["key", "digest"])
    sets = chosen.select("node", "t").mapInPandas(shingles, "node long, set array<long>").checkpoint()

    def joined(block: pa.Table, by_all: bool = False) -> list[np.ndarray]:
        """The links of two blocks, or of one; by shingles alone where all pairs of different groups are held against each other."""
        roots, parts, lists = block["root"].to_numpy(), block["part"].to_numpy(), block["set"].chunk(0)
        flat, ends = lists.flatten().to_numpy(zero_copy_only=False), np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))))
        return list(_joined(roots, parts, None if by_all else _matrix(block, words), flat, ends, similarity, far))

    def links_of(rows: DataFrame, by_all: bool = False) -> DataFrame:
        """Links (a, b) between roots, by the shingles of the blocks' texts."""
        columns = ["part", "node", "root", "set"] if by_all else ["part", "node", "root", "long", "set"]
        return blocks(rows.join(sets, "node"), columns).mapInArrow(lambda batches: _gathered((joined(b, by_all) for b in _keyed(batches, key_columns)), ["a", "b"]), "a long, b long")

    members = placed.join(few, "node")
    families = members.groupBy("n", "m").agg(F.min("node").alias("first"), F.count("*").alias("members"), F.ceil(F.sum(F.col("size") + 1) / BLOCK_SHINGLES).cast("int").alias("parts"))
    dealt = members.join(families.where("members > 1"), ["n", "m"]).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts").cast("long")).cast("int")).checkpoint()
    # each block with the family's first text, as one part
    alone = dealt.withColumn("one", F.explode(F.when(F.col("node") == F.col("first"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array("part"))))
    roots = connected_components(links_of(alone.withColumns({"two": F.col("one"), "part": F.col("one"), "root": F.col("node")})))
    if not dealt.where("parts > 1").isEmpty():
        grouped = dealt.where("parts > 1").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        mixed = grouped.groupBy("n", "m").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("n", "m")
        mixed = grouped.join(mixed, ["n", "m"]).checkpoint()
        rest = paired(mixed.join(close(mixed), "node")).where("one < two")
        roots = connected_components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(links_of(rest)))
    # the rest: texts that have shingles enough in common with those of other groups, in heads first, as these are short
    rooted = heads.drop("root").join(able, "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")).checkpoint()
    mixed = rooted.drop("tokens").join(overlap.meeting(rooted, in_heads).select("node"), "node").join(sets.withColumnRenamed("set", "tokens"), "node").checkpoint()
    met = overlap.meeting(mixed, in_all).select("node", F.explode("tokens").alias("token")).checkpoint()
    if not met.isEmpty():
        first = met.groupBy("token").agg(F.min("node").alias("first"))
        together = connected_components(met.join(first, "token").select(F.col("node").alias("a"), F.col("first").alias("b"))).withColumnRenamed("root", "m")
        together = mixed.drop("tokens").join(together, "node").checkpoint()
        families = together.groupBy("m").agg(F.ceil(F.sum(F.col("size") + 1) / BLOCK_SHINGLES).cast("int").alias("parts"))
        rest = together.withColumn("n", F.lit(0)).join(families, "m").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts").cast("long")).cast("int"))
        roots = connected_components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(links_of(paired(rest), by_all=True)))
    grouped = texts.select("key", "digest", "node").join(roots, "node", "left").select("key", "digest", F.coalesce("root", "node").alias("group"))
    first = grouped.groupBy("group").agg(F.min(F.struct("key", "digest")).alias("first"))
    return grouped.join(first, "group").select("key", "digest", F.col("first.key").alias("root"), F.col("first.digest").alias("root_digest"))


def keep_one_of_each(docs: DataFrame, width: int = 5, similarity: float = 0.8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents without near copies: of each group the row of the smallest key stays, once.

    Null keys come last in a group; null and empty texts are one text, of which one row stays; of
    rows that repeat a key and a text one stays, with the other columns of any of them. Columns may
    have any names. An empty table stays empty.
    """
    names = docs.columns
    docs = docs.toDF(*[f"c{i}" for i in range(len(names))])  # so that no name clashes with one of ours
    key, text = f"c{names.index(key)}", f"c{names.index(text)}"
    groups = near_copies(docs, width, similarity, key, text)
    stay = groups.where((F.col("key") == F.col("root")) & (F.col("digest") == F.col("root_digest"))).select("key", "digest")
    marked = docs.withColumns({"key": F.coalesce(F.col(key).cast("long"), F.lit((1 << 63) - 1)), "digest": F.md5(F.coalesce(F.col(text), F.lit("")))})
    kept = marked.join(stay, ["key", "digest"], "left_semi").dropDuplicates(["key", "digest"])
    return kept.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)])
