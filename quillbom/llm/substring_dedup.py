"""Removal of passages of words that occur more than once, by seed and extend.

Documents meet on winnowed anchors, the seeds (windows.cover()). Around a seed that occurs in several
contexts, matches are extended word by word to both sides, for all occurrences at once: occurrences
that agree so far have the same name, and each further word parts them, until one is alone. A seed
that agrees with another over at least the length, to both sides together, lies in a repeat; the
maximal repeats are the unions of these stretches, and every word in one goes.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from quillbom.llm import windows

#: Words of an anchor.
ANCHOR = 8


def _named(names: np.ndarray, more: np.ndarray) -> np.ndarray:
    """New names for pairs of a name and one more; -1 where either is -1 or the pair occurs once."""
    ok = np.flatnonzero((names >= 0) & (more >= 0))
    out = np.full(len(names), -1, np.int64)
    if len(ok):
        pair = names[ok] * (int(more.max()) + 1) + more[ok]
        _, inverse, counts = np.unique(pair, return_inverse=True, return_counts=True)
        out[ok] = np.where(counts[inverse] > 1, inverse, -1)
    return out


def settle(spec: windows.Spec, h: np.ndarray, value: np.ndarray, left: np.ndarray, right: np.ndarray, bodies: np.ndarray) -> np.ndarray:
    """Per context the windows that another context of its seed holds in the same place.

    A window is compared in each place of a seed of its own, so one that holds two seeds is not
    counted twice; contexts of which there are copies are settled before.
    """
    n, reach, anchor = len(value), spec.reach, spec.anchor
    words = [w for b in bodies for w in b.split(b" ")]
    numbers, _ = pd.factorize(np.array(words, object))
    size = left + right
    table = np.full((n, reach + spec.window), -1, np.int64)  # by place around the seed
    owner = np.repeat(np.arange(n), size)
    place = np.arange(len(words)) - np.repeat(np.cumsum(size) - size, size) - np.repeat(left, size) + reach
    table[owner, place] = numbers
    seed = np.unique(h, return_inverse=True)[1]
    for k in range(anchor):
        seed = _named(seed, table[:, reach + k])
    to_left, to_right = [seed], [seed]
    for k in range(reach):
        to_left.append(_named(to_left[-1], table[:, reach - 1 - k]))
        to_right.append(_named(to_right[-1], table[:, reach + anchor + k]))
    masks = np.zeros(n, np.uint64)
    for j in range(reach + 1):
        masks[_named(to_left[j], to_right[reach - j]) >= 0] |= np.uint64(1) << np.uint64(j)
    return masks


def _kept(text: bytes, gone: np.ndarray) -> bytes:
    return b" ".join(compress(text.split(b" "), (~gone).tolist())) if len(gone) else b""


def _digests(rows: pa.Table, texts: list[bytes], masks: list[np.ndarray]) -> pa.Table:
    return pa.table({
        "k": rows.column("k"),
        "n_words": pa.array([len(m) for m in masks], pa.int64()),
        "n_removed": pa.array([int(m.sum()) for m in masks], pa.int64()),
        "kept_sha256": pa.array([hashlib.sha256(_kept(t, m)).hexdigest() for t, m in zip(texts, masks, strict=True)], pa.string()),
    })


def _texts(rows: pa.Table, texts: list[bytes], masks: list[np.ndarray]) -> pa.Table:
    return pa.table({
        "k": rows.column("k"),
        "kept_text": pa.array([_kept(t, m).decode() for t, m in zip(texts, masks, strict=True)], pa.string()),
        "n_removed": pa.array([int(m.sum()) for m in masks], pa.int64()),
        "n_words": pa.array([len(m) for m in masks], pa.int64()),
    })


def remove_repeats(docs: DataFrame, length: int = 35, key: str = "doc_id", text: str = "text", digests: bool = False) -> DataFrame:
    """Removes each word covered by a window of length words that starts anywhere else too.

    Per row: the key, n_words, n_removed, and kept_text (words joined by one space) or its SHA-256.
    Null and empty texts have no words; repeated rows are texts of their own and take from each
    other, and null keys do no harm. A very long text is in one chunk as a whole and takes memory in
    proportion. An empty table gives no rows. Other columns of docs, of any name, are not read.
    """
    spec = windows.Spec(length, min(ANCHOR, length), words=True, earlier=False)
    kind = docs.schema[key].dataType.simpleString()
    schema = f"k {kind}, n_words long, n_removed long, kept_sha256 string" if digests else f"k {kind}, kept_text string, n_removed long, n_words long"
    return windows.cover(docs, spec, settle, _digests if digests else _texts, schema, key, text).withColumnRenamed("k", key)
