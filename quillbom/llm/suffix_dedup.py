"""Removal of byte strings that an earlier document has, by longest-previous-factor arrays.

The suffixes to compare come from windows.cover(): those that start in a window around an anchor
which several documents hold; no others can have a previous factor of the window's length. Each part
builds its suffix array, the array of longest common prefixes, and from both, by the previous and
the next suffix of smaller position, the longest previous factor of every suffix. Where that is at
least the window's length an earlier document holds the string, so this copy goes and the first
stays. Suffixes are compared over the window's length only, as longer factors are unions of windows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillbom.llm import windows

#: Bytes of an anchor.
ANCHOR = 24


def suffix_order(keys: np.ndarray, position: np.ndarray) -> np.ndarray:
    """Order of the rows of keys, by all their columns and then by position. Columns are compared as far as ties go."""
    order = np.lexsort((position, keys[:, 0]))
    group = np.cumsum(np.concatenate([[0], keys[order[1:], 0] != keys[order[:-1], 0]]))
    for c in range(1, keys.shape[1]):
        tied = np.concatenate([[False], group[1:] == group[:-1]])
        tied |= np.concatenate([tied[1:], [False]])
        at = np.flatnonzero(tied)
        if not len(at):
            break
        rows, g = order[at], group[at]
        inner = np.lexsort((position[rows], keys[rows, c], g))
        rows, g = rows[inner], g[inner]
        order[at] = rows
        differs = np.zeros(len(order), np.int64)
        differs[at[1:]] = (g[1:] == g[:-1]) & (keys[rows[1:], c] != keys[rows[:-1], c])
        new = np.concatenate([[0], group[1:] != group[:-1]]) | differs
        group = np.cumsum(new)
    return order


def common_prefixes(keys: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Bytes that each suffix in the order shares with the one before it; the first shares none."""
    out = np.zeros(len(order), np.int64)
    at = np.arange(1, len(order))
    for c in range(keys.shape[1]):
        x = keys[order[at], c] ^ keys[order[at - 1], c]
        out[at] += sum((x >> np.uint64(8 * k) == 0).astype(np.int64) for k in range(8))
        at = at[x == 0]
        if not len(at):
            break
    return out


def _before(position: np.ndarray, lcp: np.ndarray, least: int) -> np.ndarray:
    """What each suffix shares with the nearest one before it of smaller position; 0 if that is under least.

    All suffixes look back at once: one whose candidate is not smaller goes on to that one's own
    candidate, as everything between those two is not smaller either.
    """
    candidate, common = np.arange(len(position)) - 1, lcp.copy()
    active = np.arange(len(position))
    while len(active):
        active = active[(candidate[active] >= 0) & (common[active] >= least)]
        active = active[position[candidate[active]] >= position[active]]
        over = candidate[active]
        common[active], candidate[active] = np.minimum(common[active], common[over]), candidate[over]
    return np.where((candidate >= 0) & (common >= least), common, 0)


def longest_previous_factor(position: np.ndarray, lcp: np.ndarray, least: int = 1) -> np.ndarray:
    """Per suffix in suffix order, its longest match with one of smaller position; matches under least count as 0.

    It is the longer of those with the nearest smaller positions before and after it in the order.
    """
    back = np.concatenate([[0], lcp[:0:-1]]) if len(lcp) else lcp
    return np.maximum(_before(position, lcp, least), _before(position[::-1], back, least)[::-1])


def settle(spec: windows.Spec, h: np.ndarray, value: np.ndarray, left: np.ndarray, right: np.ndarray, body: np.ndarray) -> np.ndarray:
    """Per context the windows that an earlier document holds; value is the context's first document."""
    width = -(-spec.window // 8) * 8
    keys, owner, bit = [], [], []
    for j in range(spec.reach + 1):
        rows = np.flatnonzero((left >= j) & (right >= spec.window - j))
        field = np.zeros((len(rows), width), np.uint8)
        field[:, : spec.window] = body[rows, spec.reach - j: spec.reach - j + spec.window]
        keys.append(field.view(">u8").astype(np.uint64))
        owner.append(rows)
        bit.append(np.full(len(rows), j, np.uint64))
    keys, owner, bit = np.concatenate(keys), np.concatenate(owner), np.concatenate(bit)
    masks = np.zeros(len(value), np.uint64)
    order = suffix_order(keys, value[owner])
    lcp = np.minimum(common_prefixes(keys, order), spec.window)
    hit = order[longest_previous_factor(value[owner[order]], lcp, spec.window) >= spec.window]
    np.bitwise_or.at(masks, owner[hit], np.uint64(1) << bit[hit])
    return masks


def _spans(gone: np.ndarray) -> int:
    return int(np.count_nonzero(np.diff(np.concatenate([[0], gone.view(np.int8)])) == 1))


def _digests(rows: pa.Table, texts: list[bytes], masks: list[np.ndarray]) -> pa.Table:
    kept = [np.frombuffer(t, np.uint8)[~m].tobytes() if m.any() else t for t, m in zip(texts, masks, strict=True)]
    return pa.table({
        "k": rows.column("k"),
        "n_bytes": pa.array([len(t) for t in texts], pa.int64()),
        "n_removed": pa.array([len(t) - len(k) for t, k in zip(texts, kept, strict=True)], pa.int64()),
        "n_spans": pa.array(map(_spans, masks), pa.int64()),
        "kept_sha256": pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()),
    })


def _texts(rows: pa.Table, texts: list[bytes], masks: list[np.ndarray]) -> pa.Table:
    """Kept texts; a character that loses a byte goes as a whole."""
    kept = [np.frombuffer(t, np.uint8)[~m].tobytes().decode(errors="ignore") if m.any() else t.decode() for t, m in zip(texts, masks, strict=True)]
    carried = {c: rows.column(c) for c in rows.column_names if c[0] == "c" and c[1:].isdigit()}
    return pa.table({
        "k": rows.column("k"), "kept_text": pa.array(kept, pa.string()),
        "n_removed": pa.array([int(m.sum()) for m in masks], pa.int64()), "n_bytes": pa.array([len(t) for t in texts], pa.int64()), **carried,
    })


def remove_repeats(docs: DataFrame, length: int = 50, key: str = "doc_id", text: str = "text", digests: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """Removes each byte covered by a string of length bytes that starts in a row of smaller key.

    Per row: the key, n_bytes, n_removed, and either kept_text and the columns named in carry, or
    n_spans and kept_sha256. A carried column that has the name of a result takes its place; other
    columns of docs are not read. Null texts count as empty; rows of one key, repeated ones too,
    never take from each other; null keys come after all others. A very long text is in one chunk as
    a whole and takes memory in proportion. An empty table gives no rows.
    """
    spec = windows.Spec(length, min(ANCHOR, length), words=False, earlier=True)
    kind = docs.schema[key].dataType.simpleString()
    schema = f"k {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" if digests else f"k {kind}, kept_text string, n_removed long, n_bytes long"
    if digests:
        return windows.cover(docs, spec, settle, _digests, schema, key, text).withColumnRenamed("k", key)
    schema += "".join(f", c{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(carry))
    found = windows.cover(docs, spec, settle, _texts, schema, key, text, carry)
    own = [F.col(c).alias(key if c == "k" else c) for c in ("k", "kept_text", "n_removed", "n_bytes") if (key if c == "k" else c).lower() not in {c.lower() for c in carry}]
    return found.select(*own, *[F.col(f"c{i}").alias(c) for i, c in enumerate(carry)])


def cleaned(docs: DataFrame, length: int = 50, key: str = "doc_id", text: str = "text", count: str = "n_chars") -> DataFrame:
    """docs, of the same columns, with texts that have lost what remove_repeats() removes; the column
    count, if there is one, holds their characters anew. Null texts that lose nothing become empty."""
    columns = docs.columns
    found = remove_repeats(docs.toDF(*[f"v{i}" for i in range(len(columns))]), length, f"v{columns.index(key)}", f"v{columns.index(text)}", carry=tuple(f"v{i}" for i in range(len(columns)) if columns[i] != text))
    value = lambda i, c: F.col("kept_text") if c == text else F.length("kept_text").cast(docs.schema[c].dataType) if c == count else F.col(f"v{i}")
    return found.select(*[value(i, c).alias(c) for i, c in enumerate(columns)])
