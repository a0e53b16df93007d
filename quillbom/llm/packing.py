"""Tokenising and packing documents into sequences of a fixed length.

Documents are tokenised where they are read; only the lengths of their pieces move. The pieces are
dealt by hash to buckets of a bounded number of pieces, so that buckets, not their size, grow with
the input. In each bucket a bounded-space online best fit places them: a fixed number of bins is
open, a bit field keyed by free space tells the best of them in one step, and when one bin too many
would be open, the fullest closes first.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillbom.llm.shared import small_batches

#: Pre-tokens whose ids a worker keeps.
CACHE_WORDS = 3 << 19
#: Rows whose texts a task holds at a time, beside the batch they came in.
SLICE_ROWS = 256
#: Pieces in a bucket, on average.
BUCKET_PIECES = 1 << 14
#: Bins open at a time in a bucket.
OPEN_BINS = 4096


#: Characters for which the standard library's classes part letters, numbers and spaces as the tokenizer's pattern does.
_latin = re.compile("[\x00-\x1b\x20-\x84\x86-\xb1\xb4-\xb8\xba\xbb\xbf-\u024f\u2010-\u2027]*").fullmatch
_latin_split = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+").findall


class WordTokenizer:
    """Byte-level BPE by pre-token: each distinct one is encoded by the library and kept as bytes.

    Byte-level BPE merges inside pre-tokens only, so the ids of a text are those of its pre-tokens.
    As in the library, strings of added tokens (such as the end of a text) are found first, are one
    id each, and part the text around them.
    """

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        import public_tokenizers

        self.cache_words = cache_words

        self.tokenizer = Tokenizer.from_file(path)
        added = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        if any(t.lstrip or t.rstrip or t.single_word for t in self.tokenizer.get_added_tokens_decoder().values()):
            raise ValueError("added tokens that take the space around them are not supported")
        self.added = {content: np.array([i], "<u4").tobytes() for content, i in added.items()}
        self.at_added = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")").split if added else lambda text: [text]
        self.split_any = regex.compile(public_tokenizers.PATTERN).findall
        self.plain = regex.compile(r" \p{L}+").fullmatch
        vocabulary = self.tokenizer.get_vocab()
        self.opens = np.zeros(max(vocabulary.values()) + 1, bool)  # ids whose text begins with a space
        self.opens[[i for token, i in vocabulary.items() if token.startswith("\u0120")]] = True
        self.cache: dict[str, bytes] = {}

    def split(self, text: str) -> list[str]:
        """Pre-tokens; texts of Latin letters alone take the faster of two equal patterns."""
        return _latin_split(text) if _latin(text) else self.split_any(text)

    def encode_words(self, words: list[str]) -> dict[str, bytes]:
        """Ids of distinct pre-tokens. Those of a space and letters are encoded as one text, as they part again at the spaces."""
        plain = [w for w in words if self.plain(w)]
        known = {}
        if plain:
            ids = np.array(self.tokenizer.encode("".join(plain), add_special_tokens=False).ids, "<u4")
            cuts, data = np.flatnonzero(self.opens[ids]), ids.tobytes()
            ends = np.append(cuts[1:], len(ids))
            known = {w: data[4 * a:4 * b] for w, a, b in zip(plain, cuts.tolist(), ends.tolist(), strict=True)}
        rest = [w for w in words if w not in known]
        for w, e in zip(rest, self.tokenizer.encode_batch(rest, add_special_tokens=False), strict=True):
            known[w] = np.array(e.ids, "<u4").tobytes()
        return known

    def ids(self, text: str | None) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit numbers; null texts have none."""
        if not text:
            return b""
        if any(content in text for content in self.added):
            return b"".join(self.added[part] if n % 2 else self.between(part) for n, part in enumerate(self.at_added(text)))
        return self.between(text)

    def between(self, text: str) -> bytes:
        """The ids of a text without added tokens."""
        words = self.split(text)
        parts = list(map(self.cache.get, words))
        if None in parts:
            holes = [i for i, p in enumerate(parts) if p is None]
            known = self.encode_words(list({words[i] for i in holes}))
            for i in holes:
                parts[i] = known[words[i]]
            if len(self.cache) + len(known) <= self.cache_words:
                self.cache |= known
        return b"".join(parts)


_tokenizers: dict[str, WordTokenizer] = {}


def tokenizer(path: str, cache_words: int = CACHE_WORDS) -> WordTokenizer:
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path, cache_words)
    return _tokenizers[path]


def piece_bounds(length: int, capacity: int) -> Iterator[tuple[int, int]]:
    """(start, length) of the pieces of a document; only the first may be shorter than the capacity."""
    first = length % capacity or capacity
    yield 0, min(first, length)
    for start in range(first, length, capacity):
        yield start, capacity


def cut_pieces(docs: DataFrame, path: str, capacity: int, end_id: int, key: str, text: str, cache_words: int = CACHE_WORDS) -> DataFrame:
    """One row per piece: key, doc_hash, deal, piece, start, length and the CRC-32 of its ids.

    deal tells repeated rows apart, so that they don't all go to one bucket; it is the same when a
    lost task reads its rows again, as from files or a checkpoint.
    """

    kind = docs.schema[key].dataType.simpleString()
    names = ["k", "doc_hash", "deal", "piece", "start", "length", "ids_crc32"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, end = tokenizer(path, cache_words), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):  # texts become Python objects a slice at a time
                part = batch.slice(at, SLICE_ROWS)
                out: list[list] = [[] for _ in names]
                for k, h, d, t in zip(*(part.column(c).to_pylist() for c in ("k", "doc_hash", "deal", "t")), strict=True):
                    data = words.ids(t) + end
                    for piece, (start, length) in enumerate(piece_bounds(len(data) // 4, capacity)):
                        for column, value in zip(out, (k, h, d, piece, start, length, zlib.crc32(data[4 * start:4 * (start + length)])), strict=True):
                            column.append(value)
                types = [part.schema.field("k").type, pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, types, strict=True)], names=names)

    digest = F.xxhash64(F.col(key), F.col(text))
    return small_batches(docs).select(F.col(key).alias("k"), digest.alias("doc_hash"), F.xxhash64(digest, F.monotonically_increasing_id()).alias("deal"), F.col(text).alias("t")).mapInArrow(
        run, f"k {kind}, doc_hash long, deal long, piece int, start long, length long, ids_crc32 long"
    )


def best_fit(lengths: Iterable[int], capacity: int, open_bins: int = OPEN_BINS) -> tuple[list[int], list[int]]:
    """(bin, offset) of each length, in the order given, by bounded-space online best fit."""
    open_by_free: dict[int, list[tuple[int, int]]] = defaultdict(list)
    field, count, made = 0, 0, 0  # bit f of the field: a bin with f free places is open
    bins, offsets = [], []
    for length in lengths:
        fitting = field >> length << length
        if fitting:
            free = (fitting & -fitting).bit_length() - 1
            number, used = open_by_free[free].pop()
            if not open_by_free[free]:
                field ^= 1 << free
            count -= 1
        else:
            number, used, free = made, 0, capacity
            made += 1
        bins.append(number)
        offsets.append(used)
        left = free - length
        if left:
            if count == open_bins:  # the fullest closes
                least = (field & -field).bit_length() - 1
                open_by_free[least].pop()
                if not open_by_free[least]:
                    field ^= 1 << least
                count -= 1
            open_by_free[left].append((number, used + length))
            field |= 1 << left
            count += 1
    return bins, offsets


def pack(pieces: DataFrame, total: int, capacity: int, bucket_pieces: int = BUCKET_PIECES, open_bins: int = OPEN_BINS) -> DataFrame:
    """Adds sequence_id and offset to rows with doc_hash, deal, piece and length; total is their number.

    Longer pieces come first in a bucket, as best fit wastes least on them; ties go by hash and
    piece, so that the result does not depend on how rows arrive.
    """
    buckets = max(1, -(-total // bucket_pieces))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_hash", "piece", "start"], ascending=[False, True, True, True], kind="stable", ignore_index=True)
        bins, offsets = best_fit(rows["length"].tolist(), capacity, open_bins)
        return rows.assign(sequence_id=np.array(bins, np.int64) * buckets + int(rows["bucket"].iloc[0]), offset=np.array(offsets, np.int64)).drop(columns="bucket")

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema.fields)
    dealt = pieces.withColumn("bucket", F.pmod(F.xxhash64("deal", "piece"), F.lit(buckets)))
    return dealt.groupBy("bucket").applyInPandas(run, f"{fields}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str, capacity: int = 1024, end_id: int = 2, key: str = "doc_id", text: str = "text", cache_words: int = CACHE_WORDS) -> DataFrame:
    """Packs all documents; null texts count as empty, so each row has at least its end token.

    Per piece: key, piece, start, length, ids_crc32, sequence_id, offset; other columns of docs, of
    any name, are not read. Repeated rows are packed each time they occur, a very long text is cut
    into as many pieces as it needs, an empty table gives no rows. The number of buckets comes from an estimate of the pieces, a token for
    each three bytes; results do not depend on how good it is. cache_words trades memory of the
    workers for time.
    """
    estimate = docs.select(F.sum(F.ceil((F.coalesce(F.octet_length(text), F.lit(0)) / 3 + 1) / capacity)).alias("n")).first()["n"] or 0
    pieces = cut_pieces(docs, path, capacity, end_id, key, text, cache_words)
    return pack(pieces, int(estimate), capacity).drop("doc_hash", "deal").withColumnRenamed("k", key)
