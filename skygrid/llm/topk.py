"""Exact top-k search by inner product on a vector-approximation file.

Each component is quantised into 256 cells between its least and largest value, and a vector's cells, a byte a component, are
written beside the vectors as a column of their own.  Only this file is scanned: the edges of its cells bound each product from
both sides.  A first slab of it gives each query a threshold, the kth lower bound found there; the scan of all slabs leaves the
candidates whose upper bound reaches it.  Exact vectors are then read in the order of the bounds, the first ``head`` of each query,
and of the others those whose bound reaches the kth exact score; what is left can't be among the k best.

Queries come in blocks, so a task holds one slab of cells and one block whatever the tables' sizes; a pair's exact score needs
the two vectors only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skygrid.llm.common import cut, small_batches

CELLS = 256
#: The least and the greatest long that are doubles.
LEAST, MOST = -float(1 << 63), float((1 << 63) - 1024)
EPS = 2.0**-52


def as_integers(vector: Column, scale: int = 1024) -> Column:
    """floor(scale * x) of each component x as double; those beyond the range of a long count as its ends."""
    return F.transform(vector, lambda x: F.floor(F.greatest(F.least(x.cast("double") * scale, F.lit(MOST)), F.lit(LEAST))))


def usable(vector: Column) -> Column:
    """False for a null vector, and one that holds a null, a NaN or an infinity."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vector.isNotNull() & ~bad, F.lit(False))


def _matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """Vectors as rows, shorter ones filled up with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(column):
        return np.zeros((0, width), np.int64)
    offsets = column.offsets.to_numpy()
    out = np.zeros((len(column), width), np.int64)
    out[np.arange(width)[None, :] < np.diff(offsets)[:, None]] = column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
    return out


def _exact(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Inner products of rows, those beyond a long as its ends."""
    if not x.size:
        return np.zeros(len(x), np.int64)
    if (np.abs(x.astype(float)) * np.abs(y.astype(float))).sum(axis=1).max() < float(1 << 62):
        return np.einsum("ij,ij->i", x, y)
    return np.array([max(-(1 << 63), min((1 << 63) - 1, sum(int(a) * int(b) for a, b in zip(r, q, strict=True)))) for r, q in zip(x, y, strict=True)], np.int64)


class Grid:
    """Least and largest value of each component, and the width of its cells; differences are taken modulo 2**64, where they are exact."""

    def __init__(self, low: list[int], high: list[int]) -> None:
        self.low, self.high = np.array(low, np.int64), np.array(high, np.int64)
        self.width = (self.high.view(np.uint64) - self.low.view(np.uint64)) // np.uint64(CELLS) + np.uint64(1)

    def cells(self, x: np.ndarray) -> np.ndarray:
        """Cells of vectors, a byte each."""
        return ((x.view(np.uint64) - self.low.view(np.uint64)) // self.width).astype(np.uint8)

    def edges(self, cell: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The least and the largest vector of cells."""
        left = self.low.astype(float) + cell * self.width.astype(float)
        return left, np.minimum(left + (self.width.astype(float) - 1), self.high.astype(float))

    def bounds(self, left: np.ndarray, right: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of the products of queries y with all rows, rounding errors taken off and added."""
        y = y.astype(float)
        plus, minus = np.maximum(y, 0), np.minimum(y, 0)
        most = np.maximum(np.abs(self.low.astype(float)), np.abs(self.high.astype(float))) + self.width.astype(float)
        slack = (np.abs(y) @ most * EPS * 4 * (len(self.low) + 2))[:, None]
        return plus @ left.T + minus @ right.T - slack, plus @ right.T + minus @ left.T + slack


def find_grid(vectors: DataFrame) -> tuple[int, Grid]:
    """Number of rows of (v), and the grid of their components; a component that some vectors lack counts as 0 there."""

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            width = int(max(np.diff(batch.column(0).offsets.to_numpy()), default=0))
            x = _matrix(batch.column(0), width)
            if len(x):
                columns = [np.arange(-1, width), np.r_[0, x.min(axis=0)], np.r_[0, x.max(axis=0)], np.full(width + 1, len(x))]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["at", "low", "high", "n"])

    found = vectors.select("v").mapInArrow(ends, "at long, low long, high long, n long").groupBy("at")
    rows = sorted(found.agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n")).collect())  # a row per component
    n = rows[0]["n"] if rows else 0
    grid = [(r["low"], r["high"]) if r["n"] == n else (min(0, r["low"]), max(0, r["high"])) for r in rows[1:]] or [(0, 0)]
    return n, Grid([a for a, _ in grid], [b for _, b in grid])


def exact_top_k(
    vectors: DataFrame, is_query: Column, *, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", slab: int = 32_768, block: int = 2048, head: int | None = None
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of ``vectors`` with ``is_query`` the k rows of highest integer inner product.

    Rank 1 is the highest; ties go to the smaller id; a query with fewer candidates has fewer rows.  Vectors that are null
    or hold a null or non-finite component, and null ids, take no part.  A shorter vector is filled up with zeros; an empty one
    scores 0.  Rows with the query's id are its own and no candidates; of repeated query ids the smallest vector asks;
    other repeated rows are candidates each.  Scores beyond a long are clipped.  An empty table gives no rows.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    head = head or 4 * k
    own = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"), F.coalesce(is_query, F.lit(False)).alias("is_query"))
    own = own.where(F.col("id").isNotNull() & usable(F.col("v"))).withColumn("v", as_integers(F.col("v")))
    n, grid = find_grid(own)
    width, slabs = len(grid.low), max(1, -(-n // slab))

    def approximate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = grid.cells(_matrix(batch.column(2), width))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([c.tobytes() for c in cells], pa.binary())], [*batch.schema.names, "cells"])

    numbered = own.select(F.monotonically_increasing_id().alias("row"), "id", "v", "is_query")
    file = cut(numbered.mapInArrow(approximate, "row long, id long, v array<long>, is_query boolean, cells binary"))
    queries = cut(file.where("is_query").groupBy("id").agg(F.min("v").alias("v")))
    blocks = max(1, -(-queries.count() // block))
    cells = file.select("row", "id", "cells", F.pmod(F.xxhash64("row"), F.lit(slabs)).cast("int").alias("s"))
    asking = queries.select(F.col("id").alias("query_id"), F.col("v").alias("q"), F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("b"))

    def scan(candidates: pa.Table, asking: pa.Table) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
        """For each query its place, its id, which candidates aren't its own, and their bounds."""
        ids, packed = candidates.column("id").to_numpy(), np.frombuffer(b"".join(candidates.column("cells").to_pylist()), np.uint8)
        left, right = grid.edges(packed.reshape(len(ids), -1) if len(ids) else np.zeros((0, width), np.uint8))
        query_ids, y = asking.column("query_id").to_numpy(), _matrix(asking.column("q"), width)
        for first in range(0, len(y), 64):
            below, above = grid.bounds(left, right, y[first : first + 64])
            for q in range(len(below)):
                yield first + q, int(query_ids[first + q]), ids != query_ids[first + q], below[q], above[q]

    def kth(values: np.ndarray) -> float:
        return float(np.partition(values, len(values) - k)[len(values) - k]) if len(values) >= k else -np.inf

    def threshold(candidates: pa.Table, asking: pa.Table) -> pa.Table:
        rows = [(i, kth(below[other])) for _, i, other, below, _ in scan(candidates, asking)]
        return pa.table([pa.array([i for i, _ in rows], pa.int64()), pa.array([t for _, t in rows], pa.float64())], ["query_id", "least"])

    def search(candidates: pa.Table, asking: pa.Table) -> pa.Table:
        least, rows = asking.column("least").to_numpy(), candidates.column("row").to_numpy()
        out: tuple[list, list, list] = ([], [], [])
        for q, i, other, below, above in scan(candidates, asking):
            near = np.flatnonzero(other & (above >= max(least[q], kth(below[other]))))
            for c, v in zip(out, (np.full(len(near), i), rows[near], above[near]), strict=True):
                c.append(v)
        columns = [np.concatenate([np.zeros(0, kind), *c]) for c, kind in zip(out, (np.int64, np.int64, float), strict=True)]
        return pa.table([pa.array(c) for c in columns], ["query_id", "row", "bound"])

    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("b")
    least = cells.where("s = 0").select("*", every).groupBy("b").cogroup(asking.groupBy("b")).applyInArrow(threshold, "query_id long, least double")
    asking = asking.join(least, "query_id", "left").fillna(float("-inf"), ["least"])
    right = asking.select("*", F.explode(F.sequence(F.lit(0), F.lit(slabs - 1))).alias("s"))
    found = cells.select("*", every).groupBy("s", "b").cogroup(right.groupBy("s", "b")).applyInArrow(search, "query_id long, row long, bound double")
    order = Window.partitionBy("query_id").orderBy(F.desc("bound"), "row")
    found = cut(found.withColumn("place", F.row_number().over(order)))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            value = _exact(_matrix(batch.column(2), width), _matrix(batch.column(3), width))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(value, pa.int64())], ["query_id", "vec_id", "score"])

    def scored(pairs: DataFrame) -> DataFrame:
        rows = pairs.join(file.select("row", F.col("id").alias("vec_id"), "v"), "row").join(queries.select(F.col("id").alias("query_id"), F.col("v").alias("q")), "query_id")
        return rows.select("query_id", "vec_id", "v", "q").mapInArrow(score, "query_id long, vec_id long, score long")

    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    first = cut(scored(found.where(F.col("place") <= head)))
    certain = first.withColumn("rank", F.row_number().over(best)).where(F.col("rank") == k).select("query_id", F.col("score").alias("kth"))
    rest = found.where(F.col("place") > head).join(certain, "query_id", "left").where(F.col("kth").isNull() | (F.col("bound") >= F.col("kth")))
    out = first.unionAll(scored(rest)).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return out.select("query_id", "rank", "vec_id", "score")
