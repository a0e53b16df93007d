"""Exact top-k by inner product with vector-approximation files.

1. The file. Each batch of vectors becomes a block: ids, and for every component a cell of a uniform
   grid, a byte each, with the grid's own bounds. Only these blocks meet the queries, in groups of
   bounded size; exact vectors stay where they are.
2. Scanning. From the cells alone follow a lower and an upper bound of each score. A group passes on,
   for each query, the candidates whose upper bound reaches its own k-th best lower bound.
3. Reading. The k-th best lower bound over all groups is one that the k-th result can't fall below.
   The k candidates of the best lower bounds are read first; then, of the others, those whose upper
   bound reaches the k-th exact score of these: for all others it is certain that they come later.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillbom.llm.shared import checkpoint_dir, small_batches

#: Candidates and queries of a group, on average.
BLOCK_ROWS = 16_384
QUERY_ROWS = 1024
#: Cells of each component's grid.
CELLS = 256
_EXACT = float(1 << 53)


def integer_vectors(vectors: DataFrame, scale: int, key: str, vector: str) -> DataFrame:
    """(row, id, d, v, copies): components floor(scale * x) of d of them; rows with a null key, a null vector, or a null or
    non-finite component are left out; rows of the same id and vector are one, with their number."""
    x = F.col(vector)
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    kept = vectors.where(F.col(key).isNotNull() & x.isNotNull()).where(finite)
    rows = kept.select(F.col(key).cast("long").alias("id"), F.transform(x, lambda c: F.floor(F.lit(float(scale)) * c.cast("double"))).alias("v"))
    grouped = rows.groupBy("id", "v").agg(F.count("*").alias("copies")).withColumn("d", F.size("v"))
    return grouped.withColumn("row", F.monotonically_increasing_id()).checkpoint()  # fixes the numbers


class Approximation:
    """Cells of the candidates' components; score bounds follow from the cells alone."""

    def __init__(self, cells: np.ndarray, low: np.ndarray, width: np.ndarray):
        self.cells, self.low, self.width = cells, low, width

    @staticmethod
    def of(exact: np.ndarray) -> Approximation:
        data = exact.astype(np.float64)
        low = data.min(axis=0)
        width = (data.max(axis=0) - low) / CELLS
        cells = np.clip((data - low) / np.where(width > 0, width, 1.0), 0, CELLS - 1).astype(np.uint8)
        return Approximation(cells, low, width)

    def scores(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Approximate scores, and per query how far they may be off, rounding included."""
        q = queries.astype(np.float64)
        middle = (q * self.width) @ self.cells.T.astype(np.float64) + (q @ (self.low + self.width / 2))[:, None]
        size = np.abs(q) @ (np.abs(self.low) + self.width * CELLS)
        return middle, np.abs(q) @ self.width * 0.5001 + size * 1e-9 + 1e-9


def blocks(rows: DataFrame, approximate: bool) -> DataFrame:
    """(d, ids, data, low, width): the batches of rows (row, v), as cells or as they are."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for d, part in batch.groupby("d"):
                exact = np.array(part["v"].tolist(), np.int64).reshape(len(part), d)
                ids = part["row"].to_numpy(np.int64).tobytes()
                if approximate:
                    a = Approximation.of(exact)
                    out.append((d, ids, a.cells.tobytes(), a.low.tobytes(), a.width.tobytes()))
                else:
                    out.append((d, ids, exact.tobytes(), b"", b""))
            yield pd.DataFrame(out, columns=["d", "ids", "data", "low", "width"])

    return small_batches(rows).select("row", "d", "v").mapInPandas(run, "d int, ids binary, data binary, low binary, width binary")


def bounded(file: DataFrame, asked: DataFrame, k: int, groups: int, query_groups: int) -> DataFrame:
    """(asked, row, lower, upper): rows of candidates that a group can't rule out for the row of a query."""

    def run(queries: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        out = []
        for d, own in queries.groupby("d"):
            q_ids = np.concatenate([np.frombuffer(b, np.int64) for b in own["ids"]])
            q = np.frombuffer(b"".join(own["data"]), np.int64).reshape(len(q_ids), d)
            best = np.full((len(q), k), -np.inf)  # the k best lower bounds so far
            seen = []
            for r in held[held["d"] == d].itertuples(index=False):
                ids = np.frombuffer(r.ids, np.int64)
                cells = np.frombuffer(r.data, np.uint8).reshape(len(ids), d)
                middle, slack = Approximation(cells, np.frombuffer(r.low), np.frombuffer(r.width)).scores(q)
                middle[q_ids[:, None] == ids] = -np.inf  # a query is no candidate of its own
                lower = middle - slack[:, None]
                best = -np.partition(-np.concatenate([best, lower], axis=1), k - 1, axis=1)[:, :k]
                i, j = np.nonzero(middle + slack[:, None] >= np.where(np.isfinite(best.min(axis=1)), best.min(axis=1), np.finfo(float).min)[:, None])
                seen.append((i, ids[j], lower[i, j], (middle + slack[:, None])[i, j]))
            if seen:
                i, ids, lower, upper = (np.concatenate(x) for x in zip(*seen, strict=True))
                stay = upper >= best.min(axis=1)[i]
                out.append(pd.DataFrame({"asked": q_ids[i[stay]], "row": ids[stay], "lower": lower[stay], "upper": upper[stay]}))
        kinds = {"asked": "int64", "row": "int64", "lower": "float64", "upper": "float64"}
        return pd.concat(out).astype(kinds) if out else pd.DataFrame({c: pd.Series(dtype=t) for c, t in kinds.items()})

    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    deal = lambda n: F.pmod(F.xxhash64("d", "ids"), F.lit(n)).cast("int")
    left = asked.withColumn("j", deal(query_groups)).withColumn("i", every(groups))
    right = file.withColumn("i", deal(groups)).withColumn("j", every(query_groups))
    return left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInPandas(run, "asked long, row long, lower double, upper double")


def scored(pairs: DataFrame, exact: DataFrame) -> DataFrame:
    """pairs (asked, row) with the exact scores of their vectors, clamped to 64 bits, and id and copies of the row."""
    both = pairs.join(exact.select("row", "id", "copies", F.col("v").alias("w")), "row")
    both = both.join(exact.select(F.col("row").alias("asked"), "v"), "asked")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            yield rows[["asked", "row", "id", "copies"]].assign(score=[product(v, w) for v, w in zip(rows["v"], rows["w"], strict=True)])

    return both.select("asked", "row", "id", "copies", "v", "w").mapInPandas(run, "asked long, row long, id long, copies long, score long")


def product(v: np.ndarray, w: np.ndarray) -> int:
    """The inner product of two integer vectors, within 64 bits."""
    v, w = np.asarray(v, np.int64), np.asarray(w, np.int64)
    if float(np.abs(v.astype(np.float64)).max(initial=0)) * float(np.abs(w.astype(np.float64)).max(initial=0)) * max(1, len(v)) < _EXACT:
        return int(v @ w)
    return max(min(sum(a * b for a, b in zip(v.tolist(), w.tolist(), strict=True)), (1 << 63) - 1), -(1 << 63))


def _first(rows: DataFrame, k: int, by: list[str], *order: Column) -> DataFrame:
    """The k first rows of each key, numbered by rank; each task cuts its rows before they are shuffled."""
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return ranked.where(F.col("rank") <= k)


def search(vectors: DataFrame, k: int = 10, every: int = 100, scale: int = 1024, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score of the k best candidates of each query.

    Queries are the rows whose key is divisible by every, candidates all rows but the query's own;
    only vectors of the query's dimension are candidates. Rows that repeat a key are queries and
    candidates each for itself. Queries without candidates have no rows, nor has an empty table.
    Ties go to the smaller key. Scores outside 64 bits are clamped. Other columns, of any name, are
    not read; a very long vector is one row of its block.
    """
    checkpoint_dir(vectors.sparkSession)
    exact = integer_vectors(vectors, scale, key, vector)
    asked = exact.where(F.col("id") % every == 0)
    sizes = exact.select(F.count("*").alias("n"), F.count(F.when(F.col("id") % every == 0, 1)).alias("q"), F.max("copies").alias("copies")).first()
    groups, query_groups = max(1, -(-sizes["n"] // BLOCK_ROWS)), max(1, -(-sizes["q"] // QUERY_ROWS))
    # of equal vectors only the first can be results, and the query's own may be one of them
    candidates = _first(exact, k + 1, ["v"], F.asc("id"))
    met = bounded(blocks(candidates, approximate=True), blocks(asked, approximate=False), k, groups, query_groups).checkpoint()
    first = _first(met, k, ["asked"], F.desc("lower"), F.asc("row")).select("asked", "row")
    read = scored(first, exact).checkpoint()
    certain = read.groupBy("asked").agg(F.when(F.count("*") >= k, F.min("score")).alias("least"))
    others = met.join(certain, "asked").where(F.col("least").isNull() | (F.col("upper") >= F.col("least") - F.abs("least") * 1e-12 - 1)).join(first, ["asked", "row"], "left_anti")
    found = read.unionByName(scored(others.select("asked", "row"), exact))
    named = asked.select(F.col("row").alias("asked"), F.col("id").alias("query_id"), "copies")
    if (sizes["copies"] or 1) > 1:
        own = scored(asked.where("copies > 1").select(F.col("row").alias("asked"), "row"), exact).withColumn("copies", F.col("copies") - 1)  # the other rows that are like the query's
        each = lambda most: F.explode(F.sequence(F.lit(1).cast("long"), most)).alias("copy")
        found = found.unionByName(own).select("asked", "id", "score", each(F.least("copies", F.lit(k).cast("long"))))
        named = named.select("asked", "query_id", each(F.col("copies")))
    best = _first(found, k, ["asked"], F.desc("score"), F.asc("id")).select("asked", "rank", F.col("id").alias("vec_id"), "score")
    return best.join(named, "asked").select("query_id", "rank", "vec_id", "score")
