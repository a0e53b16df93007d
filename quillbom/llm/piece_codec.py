"""Encoding and decoding with a merge-type sentencepiece vocabulary.

A text is normalised (spaces become the marker U+2581, one marker is put in front) and cut into
units at places where no piece can span: before a marker that follows another character, and
around a line feed when no piece holds one. Each unit is encoded by backtracking:

* an Aho-Corasick automaton over the pieces lists, for each position, the pieces that start there;
* the longest is tried first, and accepted if it is compatible with the token before it, that is,
  if merging the two tokens' characters anew gives back just these two tokens;
* when no piece fits, the last token is given up, its position is marked in a bit field of
  positions from which no encoding goes on, and the next shorter piece is tried.

A sequence whose neighbours are all compatible is the merge procedure's own result, so the outcome
is exactly the library's. Runs of markers are the one place where merge priorities tie; they are
merged directly. Characters outside the vocabulary become byte pieces.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterable, Iterator

import ahocorasick
import pandas as pd
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillbom.llm.shared import small_batches

MARK = "▁"
#: Units whose encodings a worker keeps; further units are encoded each time they occur.
CACHE_UNITS = 1 << 20


class PieceCodec:
    """Encoder and decoder over the pieces of one vocabulary file."""

    def __init__(self, model_file: str, cache_units: int = CACHE_UNITS):
        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        if sp.normalize("ﬁ  a") != f"{MARK}ﬁ{MARK}{MARK}a":
            raise ValueError("only vocabularies that keep the text and add one leading space are supported")
        self.piece_of: dict[str, int] = {}
        self.score: dict[str, float] = {}
        self.byte_id: dict[int, int] = {}
        self.byte_of: dict[int, int] = {}
        self.text_of: dict[int, str] = {}
        self.unknown = sp.unk_id()
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
                self.byte_of[i] = int(piece[3:5], 16)
            elif sp.is_unknown(i):
                self.text_of[i] = " ⁇ "
            elif sp.is_control(i):
                self.text_of[i] = ""
            elif not sp.is_unused(i):
                self.piece_of[piece] = i
                self.score[piece] = sp.get_score(i)
                self.text_of[i] = piece.replace(MARK, " ")
        if any(MARK in p.lstrip(MARK) or p.startswith(MARK * 2) and p.strip(MARK) for p in self.piece_of):
            raise ValueError("pieces with a marker inside are not supported")
        self.lines_apart = not any("\n" in p for p in self.piece_of)
        self.unit = re.compile(f"{MARK}+[^{MARK}\n]*|[^{MARK}\n]+|\n" if self.lines_apart else f"{MARK}+[^{MARK}]*|[^{MARK}]+")
        self.alphabet = {c for p in self.piece_of for c in p}
        self.automaton = ahocorasick.Automaton()
        for piece, i in self.piece_of.items():
            if self.merge(piece) == [piece]:  # others never come out of the merge procedure
                self.automaton.add_word(piece, (len(piece), i, piece))
        self.automaton.make_automaton()
        self.fits: dict[tuple[str, str], bool] = {}
        self.cache_units = cache_units
        self.cache: dict[str, str] = _Units(self)
        self.ascii_of = {str(i): t for i, t in self.text_of.items()} | {str(i): chr(b) for i, b in self.byte_of.items() if b < 128}
        del self.ascii_of[str(self.unknown)]

    def merge(self, text: str) -> list[str]:
        """The merge procedure itself: the best-scored neighbouring pair first, the leftmost on a tie."""
        part = list(text)
        before, after = list(range(-1, len(part) - 1)), list(range(1, len(part) + 1))
        queue: list[tuple[float, int, str]] = []

        def offer(i: int) -> None:
            if i >= 0 and (j := after[i]) < len(part) and (both := part[i] + part[j]) in self.score:
                heapq.heappush(queue, (-self.score[both], i, both))

        for i in range(len(part)):
            offer(i)
        while queue:
            _, i, both = heapq.heappop(queue)
            if not part[i] or (j := after[i]) >= len(part) or part[i] + part[j] != both:
                continue
            part[i], part[j] = both, ""
            after[i] = after[j]
            if after[j] < len(part):
                before[after[j]] = i
            offer(before[i])
            offer(i)
        return [p for p in part if p]

    def compatible(self, left: str, right: str) -> bool:
        key = (left, right)
        if (known := self.fits.get(key)) is None:
            if len(self.fits) > self.cache_units:
                self.fits.clear()
            known = self.fits[key] = self.merge(left + right) == [left, right]
        return known

    def backtrack(self, text: str) -> list[tuple[int, str]]:
        """Tokens of a text whose characters are all in the alphabet."""
        n = len(text)
        starts: list[list] = [[] for _ in range(n)]
        for end, found in self.automaton.iter(text):
            starts[end - found[0] + 1].append(found)
        for found in starts:
            found.sort(reverse=True)
        failed = 0  # bit p: nothing goes on from position p
        tokens: list[tuple[int, str]] = []
        tried: list[int] = []
        at, option = 0, 0
        while at < n:
            choices = starts[at]
            while option < len(choices):
                size, i, piece = choices[option]
                if not failed >> (at + size) & 1 and (not tokens or self.compatible(tokens[-1][1], piece)):
                    break
                option += 1
            else:
                failed |= 1 << at
                _, piece = tokens.pop()
                at -= len(piece)
                option = tried.pop() + 1
                continue
            tokens.append((i, piece))
            tried.append(option)
            at += size
            option = 0
        return tokens

    def encode_unit(self, unit: str) -> list[int]:
        run = len(unit) - len(unit.lstrip(MARK))
        rest = unit[max(run - 1, 0):]
        ids: list[int] = []
        tokens: list[tuple[int | str, str]] = []
        known = ""
        for c in rest:
            if c in self.alphabet:
                known += c
            else:
                tokens += self.backtrack(known) if known else []
                tokens.append((c, c))
                known = ""
        tokens += self.backtrack(known) if known else []
        if run > 1:
            spare = run - 1
            if tokens[0][1] == MARK:
                tokens, spare = tokens[1:], run
            ids += [self.piece_of[p] for p in self.merge(MARK * spare)]
        for i, c in tokens:
            if isinstance(i, int):
                ids.append(i)
            else:
                ids += [self.byte_id[b] for b in c.encode()] if self.byte_id else [self.unknown]
        return ids

    def units(self, text: str | None) -> list[str]:
        return self.unit.findall(MARK + text.replace(" ", MARK)) if text else []

    def encode(self, text: str | None) -> list[int]:
        """All ids of a text; null and empty texts have none."""
        return [int(i) for unit in self.units(text) for i in self.cache[unit].split(",")]

    def joined(self, text: str | None) -> str:
        """The ids in decimal, joined by commas."""
        return ",".join(map(self.cache.__getitem__, self.units(text)))

    def decode(self, ids: Iterable[int | str]) -> str:
        """The text of ids; the leading space that encoding adds is dropped."""
        ids = list(map(str, ids))
        try:
            text = "".join(map(self.ascii_of.__getitem__, ids))
        except KeyError:
            out, run = [], bytearray()
            for i in map(int, ids):
                if i in self.byte_of:
                    run.append(self.byte_of[i])
                    continue
                if run:
                    out.append(_from_bytes(run))
                    run = bytearray()
                out.append(self.text_of[i])
            text = "".join(out) + _from_bytes(run)
        first = int(ids[0]) if ids else self.unknown
        return text[1:] if first not in self.byte_of and self.text_of[first].startswith(" ") and first != self.unknown else text


def _from_bytes(run: bytearray) -> str:
    """Bytes as text; each byte outside a valid sequence is one replacement character."""
    out, at = [], 0
    while at < len(run):
        try:
            out.append(run[at:].decode())
            break
        except UnicodeDecodeError as e:
            out.append(run[at:at + e.start].decode() + "�")
            at += e.start + 1
    return "".join(out)


class _Units(dict):
    def __init__(self, codec: PieceCodec):
        self.codec = codec

    def __missing__(self, unit: str) -> str:
        found = ",".join(map(str, self.codec.encode_unit(unit)))
        if len(self) < self.codec.cache_units and len(unit) < 64:
            self[unit] = found
        return found


_codecs: dict[str, PieceCodec] = {}


def codec(model_file: str) -> PieceCodec:
    """One codec per worker and vocabulary."""
    if model_file not in _codecs:
        _codecs[model_file] = PieceCodec(model_file)
    return _codecs[model_file]


def encode_texts(docs: DataFrame, model_file: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Adds the array of ids of each text. Null and empty texts give an empty array; a column of that name is replaced."""

    @F.pandas_udf("array<int>")
    def run(texts: pd.Series) -> pd.Series:
        c = codec(model_file)
        return pd.Series([c.encode(t) for t in texts])

    return docs.withColumn(ids, run(F.col(text)))


def decode_ids(docs: DataFrame, model_file: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Adds the text of each array of ids. Null arrays give the empty text."""

    @F.pandas_udf("string")
    def run(arrays: pd.Series) -> pd.Series:
        c = codec(model_file)
        return pd.Series([c.decode([] if a is None else list(a)) for a in arrays])

    return docs.withColumn(text, run(F.col(ids)))


def round_trip_digests(docs: DataFrame, model_file: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: the key, the number of ids, and SHA-256 of the ids and of the decoded text.

    The ids themselves never leave the worker, so nothing is shuffled. Repeated rows give repeated
    results, a null key stays null, null texts count as empty, an empty table gives no rows; other
    columns, of any name, are not read. A very long text is encoded as a whole; within it a unit without
    spaces takes memory in proportion (a list for each character while it is encoded, and a bit field of
    its length).
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = codec(model_file)
        for rows in batches:
            out = []
            for t in rows["t"]:
                joined = c.joined(t)
                ids = joined.split(",") if joined else []
                out.append((len(ids), hashlib.sha256(joined.encode()).hexdigest(), hashlib.sha256(c.decode(ids).encode()).hexdigest()))
            yield pd.concat([rows[["k"]], pd.DataFrame(out, columns=["n_tokens", "ids_sha256", "decoded_sha256"], index=rows.index)], axis=1)

    kind = docs.schema[key].dataType.simpleString()
    return (
        small_batches(docs).select(F.col(key).alias("k"), F.col(text).alias("t"))
        .mapInPandas(run, f"k {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
        .withColumnRenamed("k", key)
    )
