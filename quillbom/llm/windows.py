"""Exact search for windows of L units that occur more than once, over all documents.

Units are bytes or words. The documents are dealt once, by hash, to chunks of bounded size; after
that only asks and answers move between chunks and parts, and each round reads the chunks anew from
that one shuffle:

1. Anchors. Of the k-unit grams in each window the one of least hash is an anchor (winnowing), so
   equal windows have equal anchors in equal places. Chunks ask which anchors others have.
2. Contexts. Of anchors met elsewhere, each chunk sends the text around them once: all windows that
   hold the anchor. Parts compare these texts and answer which windows of each are to go.

Hashes only bring texts together; whether they are equal is decided on their bytes. A chunk sends
each distinct hash or context once, so a passage in a third of all documents weighs as many rows as
there are chunks, of which there are at most MAX_CHUNKS. An anchor of very many contexts, a common
phrase, is split: its windows are dealt one by one, by their own hash, so that only equal ones meet.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of text in a chunk, on average, while there are at most MAX_CHUNKS of them; then chunks grow.
CHUNK_BYTES = 2 << 20
MAX_CHUNKS = 1 << 22
#: Bytes of all texts from which chunks and parts grow with their root, so that the asks between them, a row
#: for each chunk and part, grow with the texts and not with their square; and how many times they grow at most.
ROOT_BYTES = 1 << 33
MOST_GROWTH = 16
#: Bytes of text that are hashed at a time.
BLOCK_BYTES = 1 << 20
#: Bytes of all texts for each part that compares contexts.
PART_BYTES = 4 << 20
#: Contexts of an anchor, summed over chunks, beyond which its windows are dealt one by one.
HOT_CONTEXTS = 1 << 14

_BASE = 0x5851F42D4C957F2D
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: list[np.ndarray] = []


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(32))


class RangeHash:
    """Hashes of any ranges of a sequence, by prefix sums of a polynomial modulo 2**64."""

    def __init__(self, units: np.ndarray):
        n = len(units)
        if not _powers or len(_powers[0]) < n + 1:
            size = max(n + 1, BLOCK_BYTES + 1)
            factors = [np.full(size, b, np.uint64) for b in (_BASE, _INVERSE)]
            for f in factors:
                f[0] = 1
            _powers[:] = [np.cumprod(f, dtype=np.uint64) for f in factors]
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(units * _powers[0][:n], out=self.sums[1:])

    def __call__(self, start: np.ndarray | slice, end: np.ndarray | slice) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * _powers[1][: len(self.sums)][start]


def _slide(values: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """pick over each run of width values."""
    span = 1
    while span * 2 <= width:
        values = pick(values[:-span], values[span:])
        span *= 2
    return pick(values[: len(values) - (width - span)], values[width - span:]) if width > span else values


def words_of_bytes(buffer: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words between ASCII white space."""
    inside = ~((buffer == 32) | ((buffer >= 9) & (buffer <= 13)))
    edge = np.diff(np.concatenate([[0], inside.view(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


@dataclass(frozen=True)
class Spec:
    """What to look for: window and anchor widths, the units, and whether only earlier keys count."""

    window: int
    anchor: int
    words: bool
    earlier: bool

    @property
    def reach(self) -> int:
        return self.window - self.anchor

    def texts(self, column: pa.ChunkedArray) -> list[bytes]:
        """Texts as bytes; for words, with one space between them and none around."""
        texts = column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()
        return [b" ".join(t.split()) if t else b"" for t in texts] if self.words else [t or b"" for t in texts]

    def anchors(self, texts: list[bytes]) -> dict[str, np.ndarray]:
        """All anchors of the texts: hash, hash of the context, row, pos, left and right (in units of
        the row), and the bytes of the row that the context spans, from and to."""
        found: list[dict] = []
        at = 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size + len(texts[end]) < BLOCK_BYTES):
                size += len(texts[end]) + 1
                end += 1
            found.append(self._block(texts[at:end], at))
            at = end
        names = ("hash", "context", "row", "pos", "left", "right", "from", "to")
        return {n: np.concatenate([f[n] for f in found] or [np.zeros(0, np.int64)]) for n in names}

    def _block(self, texts: list[bytes], first: int) -> dict[str, np.ndarray]:
        sizes = np.array([len(t) for t in texts], np.int64)
        if self.words:
            begins = np.concatenate([[0], np.cumsum(sizes + 1)])
            buffer = np.frombuffer(b"\n".join(texts), np.uint8)
            starts, ends = words_of_bytes(buffer)
            units = _mix(RangeHash(_BYTE[buffer])(starts, ends) + (ends - starts).astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9))
            offsets = np.searchsorted(starts, begins).astype(np.int64)
        else:
            offsets = np.concatenate([[0], np.cumsum(sizes)])
            units = _BYTE[np.frombuffer(b"".join(texts), np.uint8)]
        n, k, size = len(units), self.anchor, self.window
        if n < size:
            return {"hash": np.zeros(0, np.uint64), "context": np.zeros(0, np.uint64)} | {c: np.zeros(0, np.int64) for c in ("row", "pos", "left", "right", "from", "to")}
        hashed = RangeHash(units)
        grams = _mix(hashed(slice(0, n - k + 1), slice(k, n + 1))) | np.uint64(1)
        width = size - k + 1
        least = _slide(grams, width, np.minimum).copy()
        last = np.repeat(offsets[1:], np.diff(offsets))
        least[np.arange(len(least)) + size > last[: len(least)]] = 0  # windows over a text's end
        around = np.zeros(len(grams) + width - 1, np.uint64)
        around[width - 1: width - 1 + len(least)] = least
        pos = np.flatnonzero(_slide(around, width, np.maximum) == grams)
        row = np.searchsorted(offsets, pos, side="right") - 1
        left = np.minimum(self.reach, pos - offsets[row])
        right = np.minimum(size, offsets[row + 1] - pos)
        context = _mix(hashed(pos - left, pos + right) + (left * 1024 + right).astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9))
        spans = (starts[pos - left] - begins[row], ends[pos + right - 1] - begins[row]) if self.words else (pos - left - offsets[row], pos + right - offsets[row])
        return {"hash": grams[pos], "context": context, "row": row + first, "pos": pos - offsets[row], "left": left, "right": right, "from": spans[0], "to": spans[1]}

    def windows(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The windows of each context as bits: bit j for the one that starts j units before the anchor."""
        low = np.maximum(self.window - right, 0).astype(np.uint64)
        return (np.uint64(2) << left.astype(np.uint64)) - (np.uint64(1) << low)


class ByteBodies:
    """Contexts of bytes, in fields of one width, zero outside the context."""

    def __init__(self, spec: Spec, data: np.ndarray):
        self.spec, self.data = spec, data

    @staticmethod
    def of(spec: Spec, texts: list[bytes], a: dict[str, np.ndarray]) -> ByteBodies:
        width = spec.reach + spec.window
        base = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        buffer = np.frombuffer(bytes(spec.reach) + b"".join(texts) + bytes(spec.window), np.uint8)
        data = np.lib.stride_tricks.sliding_window_view(buffer, width)[base[a["row"]] + a["pos"]] if len(a["row"]) else np.zeros((0, width), np.uint8)
        ragged = np.flatnonzero((a["left"] < spec.reach) | (a["right"] < spec.window))
        column = np.arange(width)
        data[ragged] *= (column >= spec.reach - a["left"][ragged, None]) & (column < spec.reach + a["right"][ragged, None])
        return ByteBodies(spec, data)

    @staticmethod
    def join(parts: list[ByteBodies]) -> ByteBodies:
        return ByteBodies(parts[0].spec, np.concatenate([p.data for p in parts]))

    def take(self, rows: np.ndarray) -> ByteBodies:
        return ByteBodies(self.spec, self.data[rows])

    def differ(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (self.data[a] != self.data[b]).any(axis=1)

    def codes(self) -> np.ndarray:
        """A hash of each."""
        n, width = self.data.shape
        wide = np.zeros((n, -(-width // 8) * 8), np.uint8)
        wide[:, :width] = self.data
        out = np.zeros(n, np.uint64)
        for column in wide.view(np.uint64).T:
            out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + column)
        return out

    def window(self, rows: np.ndarray, j: np.ndarray, left: np.ndarray) -> ByteBodies:
        column, start = np.arange(self.data.shape[1]), (self.spec.reach - j)[:, None]
        return ByteBodies(self.spec, self.data[rows] * ((column >= start) & (column < start + self.spec.window)))

    def pack(self) -> bytes:
        return self.data.tobytes()

    @staticmethod
    def unpack(spec: Spec, data: bytes, n: int) -> ByteBodies:
        return ByteBodies(spec, np.frombuffer(data, np.uint8).reshape(n, spec.reach + spec.window))


class WordBodies:
    """Contexts of words, parted by single spaces."""

    def __init__(self, spec: Spec, data: np.ndarray):
        self.spec, self.data = spec, data

    @staticmethod
    def _array(values: list[bytes]) -> np.ndarray:
        out = np.empty(len(values), object)
        out[:] = values
        return out

    @staticmethod
    def of(spec: Spec, texts: list[bytes], a: dict[str, np.ndarray]) -> WordBodies:
        return WordBodies(spec, WordBodies._array([texts[r][i:j] for r, i, j in zip(a["row"].tolist(), a["from"].tolist(), a["to"].tolist(), strict=True)]))

    @staticmethod
    def join(parts: list[WordBodies]) -> WordBodies:
        return WordBodies(parts[0].spec, np.concatenate([p.data for p in parts]))

    def take(self, rows: np.ndarray) -> WordBodies:
        return WordBodies(self.spec, self.data[rows])

    def differ(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (self.data[a] != self.data[b]).astype(bool)

    def codes(self) -> np.ndarray:
        return np.fromiter(map(xxhash.xxh64_intdigest, self.data), np.uint64, len(self.data))

    def window(self, rows: np.ndarray, j: np.ndarray, left: np.ndarray) -> WordBodies:
        starts = left[rows] - j
        return WordBodies(self.spec, self._array([b" ".join(self.data[r].split(b" ")[s:s + self.spec.window]) for r, s in zip(rows.tolist(), starts.tolist(), strict=True)]))

    def pack(self) -> bytes:
        return b"\n".join(self.data)

    @staticmethod
    def unpack(spec: Spec, data: bytes, n: int) -> WordBodies:
        return WordBodies(spec, WordBodies._array(data.split(b"\n") if n else []))


def _bodies(spec: Spec) -> type:
    return WordBodies if spec.words else ByteBodies


class Entries:
    """Contexts grouped to distinct ones; each has a value: its first document, or how often it occurs."""

    def __init__(self, spec: Spec, h: np.ndarray, c: np.ndarray, v: np.ndarray, left: np.ndarray, right: np.ndarray, bodies: ByteBodies | WordBodies):
        self.spec = spec
        order = np.lexsort((v, c, h)) if spec.earlier else np.lexsort((c, h))
        new = np.ones(len(order), bool)
        a, b = order[1:], order[:-1]
        alike = np.flatnonzero((h[a] == h[b]) & (c[a] == c[b]) & (left[a] == left[b]) & (right[a] == right[b]))
        new[alike + 1] = bodies.differ(a[alike], b[alike])  # contexts that meet are told apart by their text
        starts = np.flatnonzero(new)
        self.first = order[starts]
        self.of = np.empty(len(order), np.int64)
        self.of[order] = np.cumsum(new) - 1
        self.value = v[self.first] if spec.earlier else np.add.reduceat(v[order], starts) if len(order) else v
        self.late = v > self.value[self.of] if spec.earlier else self.value[self.of] > 1  # those whose windows go whatever other contexts there are
        self.h, self.left, self.right = h[self.first], left[self.first], right[self.first]
        self.bodies = bodies.take(self.first)
        self.full = spec.windows(left, right)

    def masks(self, found: np.ndarray) -> np.ndarray:
        """Per given context, from the windows of each distinct one that are to go, its own."""
        return np.where(self.late, self.full, found[self.of])


# Asks are rows (part, chunk, kind, data), answers rows (chunk, kind, part, data); data are plain arrays
# one after the other, in an order that the chunk finds again by computing its asks anew.

_ASK, _ANSWER = "part int, chunk int, kind int, data binary", "chunk int, kind int, part int, data binary"
_ANCHORS, _CONTEXTS, _WINDOWS = 1, 2, 3


def _split(part: np.ndarray, parts: int) -> list[tuple[int, np.ndarray]]:
    order = np.argsort(part, kind="stable")
    cuts = np.searchsorted(part[order], np.arange(parts + 1))
    return [(p, order[a:b]) for p, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if b > a]


def _rows(columns: str, rows: list[tuple]) -> pa.Table:
    fields = [c.split() for c in columns.split(", ")]
    kinds = {"int": pa.int32(), "binary": pa.binary()}
    return pa.table({name: pa.array([r[i] for r in rows], kinds[kind]) for i, (name, kind) in enumerate(fields)})


def _listed(table: pa.Table, *names: str) -> zip:
    return zip(*(table.column(n).to_pylist() for n in names), strict=True)


class _Chunk:
    """One chunk's rows and what the answers so far say of them."""

    def __init__(self, spec: Spec, parts: int, wide: bool, rows: pa.Table, answers: pa.Table | None):
        self.spec, self.parts, self.number = spec, parts, rows.column("chunk")[0].as_py()
        self.rows = rows.sort_by([("order", "ascending"), ("rid", "ascending")])
        self.texts = spec.texts(self.rows.column("text"))
        self.orders = self.rows.column("order").to_numpy()
        self.found = spec.anchors(self.texts)
        hashes, self.inverse, self.counts = np.unique(self.found["hash"], return_inverse=True, return_counts=True)
        self.narrow = hashes if wide else (hashes >> np.uint64(32)).astype(np.uint32)
        self.first = _split((hashes % np.uint64(parts)).astype(np.int64), parts)  # a hash's part is the same in each round
        if answers is not None:
            self.answers = {(k, p): d for k, p, d in _listed(answers, "kind", "part", "data")}
            flags = (self.counts > 1).astype(np.uint8)
            for part, at in self.first:
                flags[at] = np.maximum(flags[at], np.frombuffer(self.answers[_ANCHORS, part], np.uint8))
            self._contexts(flags)

    def first_asks(self) -> pa.Table:
        """Each distinct anchor, and of how many contexts it is here, up to 255."""
        contexts = np.ones(len(self.counts), np.int64)
        several = np.flatnonzero(self.counts[self.inverse] > 1)
        order = several[np.lexsort((self.found["context"][several], self.inverse[several]))]
        a, b = order[1:], order[:-1]
        changes = (self.inverse[a] == self.inverse[b]) & (self.found["context"][a] != self.found["context"][b])
        contexts += np.bincount(self.inverse[a[changes]], minlength=len(contexts))
        contexts = np.minimum(contexts, 255).astype(np.uint8)
        return _rows(_ASK, [(part, self.number, _ANCHORS, self.narrow[at].tobytes() + contexts[at].tobytes()) for part, at in self.first])

    def _contexts(self, flags: np.ndarray) -> None:
        """flags: 1 for anchors that occur elsewhere, 2 for those of very many contexts."""
        self.use = np.flatnonzero(flags[self.inverse])
        a = {n: x[self.use] for n, x in self.found.items()}
        values = self.orders[a["row"]] if self.spec.earlier else np.ones(len(self.use), np.int64)
        self.contexts = e = Entries(self.spec, a["hash"], a["context"], values, a["left"], a["right"], _bodies(self.spec).of(self.spec, self.texts, a))
        hot = flags[self.inverse[self.use[e.first]]] == 2
        self.sent = [(_CONTEXTS, e, p, at) for p, at in self._dealt(e.h, np.flatnonzero(~hot))]
        self.windows, hot = None, np.flatnonzero(hot)
        if len(hot):
            j = np.arange(self.spec.reach + 1)
            i, j = np.nonzero((e.full[e.first][hot, None] >> j.astype(np.uint64)) & np.uint64(1))
            self.owner, self.bit = hot[i], j
            bodies = e.bodies.window(self.owner, j, e.left)
            h = _mix(bodies.codes() + j.astype(np.uint64))
            self.windows = Entries(self.spec, h, h, e.value[self.owner], j, self.spec.window - j, bodies)
            self.sent += [(_WINDOWS, self.windows, p, at) for p, at in self._dealt(self.windows.h, np.arange(len(self.windows.h)))]

    def _dealt(self, h: np.ndarray, entries: np.ndarray) -> list[tuple[int, np.ndarray]]:
        return [(p, entries[at]) for p, at in _split((h[entries] % np.uint64(self.parts)).astype(np.int64), self.parts)]

    def second_asks(self) -> pa.Table:
        press = zstandard.ZstdCompressor(level=1).compress
        plain = lambda e, at: e.h[at].tobytes() + e.value[at].tobytes() + e.left[at].astype(np.uint8).tobytes() + e.right[at].astype(np.uint8).tobytes()
        return _rows(_ASK, [(p, self.number, kind, len(at).to_bytes(8, "little") + plain(e, at) + press(e.bodies.take(at).pack())) for kind, e, p, at in self.sent])

    def covered(self) -> list[np.ndarray]:
        """Per row of the chunk, which of its units stand in a window that is to go."""
        spec, e = self.spec, self.contexts
        found = {_CONTEXTS: np.zeros(len(e.h), np.uint64), _WINDOWS: np.zeros(0 if self.windows is None else len(self.windows.h), np.uint64)}
        for kind, _, part, at in self.sent:
            found[kind][at] = np.frombuffer(self.answers[kind, part], np.uint64)
        if self.windows is not None:
            gone = self.windows.masks(found[_WINDOWS]) > 0
            np.bitwise_or.at(found[_CONTEXTS], self.owner[gone], np.uint64(1) << self.bit[gone].astype(np.uint64))
        mask = e.masks(found[_CONTEXTS])
        row, pos, left, right = (self.found[n][self.use] for n in ("row", "pos", "left", "right"))
        whole = (mask == e.full) & (mask > 0)
        starts, ends, of = [pos[whole] - left[whole]], [pos[whole] + right[whole]], [row[whole]]
        some = np.flatnonzero((mask > 0) & ~whole)
        for j in range(spec.reach + 1):
            hit = some[(mask[some] >> np.uint64(j) & np.uint64(1)).astype(bool)]
            starts.append(pos[hit] - j)
            ends.append(pos[hit] - j + spec.window)
            of.append(row[hit])
        starts, ends, of = np.concatenate(starts), np.concatenate(ends), np.concatenate(of)
        sizes = np.array([(t.count(b" ") + 1 if t else 0) if spec.words else len(t) for t in self.texts], np.int64)
        base = np.concatenate([[0], np.cumsum(sizes + 1)])
        step = np.zeros(base[-1] + 1, np.int32)
        np.add.at(step, base[of] + starts, 1)
        np.add.at(step, base[of] + ends, -1)
        inside = np.cumsum(step) > 0
        return [inside[b:b + s] for b, s in zip(base[:-1].tolist(), sizes.tolist(), strict=True)]


def _answer_anchors(wide: bool, hot: int) -> Callable:
    kind, width = (np.uint64, 9) if wide else (np.uint32, 5)

    def run(rows: pa.Table) -> pa.Table:
        asks = list(_listed(rows, "chunk", "part", "data"))
        sizes = [len(d) // width for _, _, d in asks]
        hashes = np.concatenate([np.frombuffer(d, kind, n) for (_, _, d), n in zip(asks, sizes, strict=True)])
        contexts = np.concatenate([np.frombuffer(d, np.uint8, n, (width - 1) * n) for (_, _, d), n in zip(asks, sizes, strict=True)])
        order = np.argsort(hashes, kind="stable")
        s = hashes[order]
        starts = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
        total = np.add.reduceat(contexts[order], starts, dtype=np.int64)
        met = np.diff(np.append(starts, len(s)))
        flags = np.empty(len(s), np.uint8)
        flags[order] = np.repeat(np.where(total > hot, 2, met > 1).astype(np.uint8), met)
        return _rows(_ANSWER, [(c, _ANCHORS, p, f.tobytes()) for (c, p, _), f in zip(asks, np.split(flags, np.cumsum(sizes)[:-1]), strict=True)])

    return run


def _answer_contexts(spec: Spec, settle: Callable) -> Callable:
    def run(rows: pa.Table) -> pa.Table:
        asks = list(_listed(rows, "chunk", "kind", "part", "data"))
        unpress, sizes, columns, bodies = zstandard.ZstdDecompressor().decompress, [], [], []
        for *_, d in asks:
            n = int.from_bytes(d[:8], "little")
            sizes.append(n)
            columns.append((np.frombuffer(d, np.uint64, n, 8), np.frombuffer(d, np.int64, n, 8 + 8 * n), np.frombuffer(d, np.uint8, n, 8 + 16 * n), np.frombuffer(d, np.uint8, n, 8 + 17 * n)))
            bodies.append(_bodies(spec).unpack(spec, unpress(d[8 + 18 * n:]), n))
        h, v, left, right = (np.concatenate([c[i] for c in columns]) for i in range(4))
        joined = _bodies(spec).join(bodies)
        del bodies
        e = Entries(spec, h, joined.codes(), v, left.astype(np.int64), right.astype(np.int64), joined)
        starts = np.flatnonzero(np.concatenate([[True], e.h[1:] != e.h[:-1]]))
        if spec.earlier:  # some context of the anchor first occurs in a later text than the anchor itself
            open_anchors = np.maximum.reduceat(e.value, starts) > np.minimum.reduceat(e.value, starts)
        else:
            open_anchors = np.diff(np.append(starts, len(e.h))) > 1
        at = np.flatnonzero(np.repeat(open_anchors, np.diff(np.append(starts, len(e.h)))))
        found = np.zeros(len(e.h), np.uint64)
        if len(at):
            found[at] = settle(spec, e.h[at], e.value[at], e.left[at], e.right[at], e.bodies.take(at).data)
        masks = e.masks(found)
        return _rows(_ANSWER, [(c, k, p, m.tobytes()) for (c, k, p, _), m in zip(asks, np.split(masks, np.cumsum(sizes)[:-1]), strict=True)])

    return run


def dealt_to(size: int) -> tuple[int, int]:
    """The numbers of chunks and of parts for so many bytes; they decide where work is done, never what is found."""
    growth = min(MOST_GROWTH, max(1.0, math.sqrt(size / ROOT_BYTES)))
    return max(1, min(MAX_CHUNKS, math.ceil(size / (CHUNK_BYTES * growth)))), max(1, math.ceil(size / (PART_BYTES * growth)))


def cover(docs: DataFrame, spec: Spec, settle: Callable, finish: Callable, schema: str, key: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """finish(rows, texts, masks) for each chunk: an Arrow table, its texts as bytes, and per row which units go.

    settle(spec, h, value, left, right, bodies) compares the contexts of each anchor hash h and gives
    those windows of each that are to go, as bits. rows has k (the key) and the carried columns as
    c0, c1 and so on. Null keys come last. Repeated rows go to different chunks, as their numbers in
    the table differ; a lost task that reads its rows again, from files or a checkpoint, gives them
    the same numbers. The texts' size is read first, to fix the numbers of chunks and parts.
    """
    size = docs.select(F.sum(F.coalesce(F.octet_length(text), F.lit(0)).cast("long")).alias("n")).first()["n"] or 0
    chunks, parts = dealt_to(size)
    wide, hot = size > 1 << 33, HOT_CONTEXTS
    order = F.coalesce(F.col(key).cast("long"), F.lit((1 << 63) - 1))
    numbered = docs.select(order.alias("order"), F.monotonically_increasing_id().alias("rid"), F.col(key).alias("k"), F.col(text).alias("text"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(carry)])
    by_chunk = numbered.withColumn("chunk", F.pmod(F.xxhash64("order", "rid"), F.lit(chunks)).cast("int")).groupBy("chunk")

    def first_asks(rows: pa.Table) -> pa.Table:
        return _Chunk(spec, parts, wide, rows, None).first_asks()

    def second_asks(rows: pa.Table, answers: pa.Table) -> pa.Table:
        return _Chunk(spec, parts, wide, rows, answers).second_asks()

    def last(rows: pa.Table, answers: pa.Table) -> pa.Table:
        chunk = _Chunk(spec, parts, wide, rows, answers)
        return finish(chunk.rows, chunk.texts, chunk.covered())

    anchors = by_chunk.applyInArrow(first_asks, _ASK).groupBy("part").applyInArrow(_answer_anchors(wide, hot), _ANSWER)
    contexts = by_chunk.cogroup(anchors.groupBy("chunk")).applyInArrow(second_asks, _ASK).groupBy("part").applyInArrow(_answer_contexts(spec, settle), _ANSWER)
    return by_chunk.cogroup(anchors.unionByName(contexts).groupBy("chunk")).applyInArrow(last, schema)
