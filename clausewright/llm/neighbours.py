"""Nearest neighbours by collision counting (query-aware hashing).

Every vector is projected on PROJECTIONS random lines; on each line a block of
vectors keeps its projections sorted. A query's window on a line is centred on its own
projection and widens from round to round (virtual rehashing: the same arrays serve
every radius). A vector inside the windows of COLLISIONS lines is a candidate and has
its true distance taken; the search ends when the k-th distance found is so small
against the window's width that a closer vector would have collided with high
probability.

Vectors that lie near each other share a cell, that of the nearest of at most PIVOTS
pivots, which are sampled from the vectors; a cell of many vectors is several blocks.
A query first searches a block of its two nearest cells: the k-th distance there
bounds the window that it can need. Of every cell, the least and greatest projection
on each line are known; where fewer than COLLISIONS lines have the cell within that
window, none of its vectors can be a candidate, and the query does not go there. So
queries meet only cells that can hold an answer; a block's vectors are copied once for
every QUERY_ROWS queries that come to it. Every vector that takes part is in one block.

Only pivots, cells' bounds and counts reach the driver: PIVOTS rows, and one for each
length of vectors.

Defined cases: vectors that are null, empty, zero, or that hold null or non-finite
components take no part, as query or candidate; a null id takes no part; vectors of
different lengths are no neighbours: each length is searched by itself; of repeated ids
each row is a candidate of its own, and none is a candidate of a query with its id; the
asking rows of one id are one query, whose distance to a candidate is that of the
nearest of their vectors; fewer than k candidates are all returned; vectors of any length are read whole; ties go
to the least id; an empty table gives no rows; columns other than those named are ignored, whatever their names.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausewright.llm.durable import durable

PROJECTIONS = 64
#: Lines on which a candidate must be inside the window.
COLLISIONS = 44
#: Half-width of the first window and growth per round, in units of the typical
#: spread of projections.
FIRST, GROWTH = 0.7, 1.25
#: A search is done when its k-th distance is at most this many half-widths.
REACH = 0.8
PIVOTS = 1024
#: Vectors for which a pivot is taken, and the most in a block.
CELL_ROWS = 4096
BLOCK_ROWS = 8192
QUERY_ROWS = 1024
#: Cells that a query searches for its first bound.
NEAR_CELLS = 2
SEED = 11

FOUND = "query_id bigint, vec_id bigint, score double"


def usable(vector: Column) -> Column:
    """Whether a vector takes part."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def lines(size: int) -> np.ndarray:
    """The random lines for vectors of a length."""
    return np.random.default_rng(SEED).normal(size=(size, PROJECTIONS))


class Block:
    """Vectors with their sorted projections."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        self.ids, self.vectors = ids, vectors
        self.lines = lines(vectors.shape[1])
        projected = vectors @ self.lines
        order = np.argsort(projected, axis=0, kind="stable")
        self.sorted = np.ascontiguousarray(np.take_along_axis(projected, order, axis=0).T)
        self.order = np.ascontiguousarray(order.T)
        self.norms = (vectors**2).sum(axis=1)
        self.unit = float(projected.std(axis=0).mean()) or 1.0

    def nearest(self, own: int, query: np.ndarray, k: int, most: float = np.inf) -> tuple[np.ndarray, np.ndarray]:
        """Rows and distances of the k nearest found, nearest first, ties by id. Windows
        grow to a half-width of most, where the k-th distance elsewhere asks for no more."""
        n = len(self.ids)
        centre = query @ self.lines
        norm = float(query @ query)
        counts = np.zeros(n, np.int64)
        seen = self.ids == own
        others = n - int(seen.sum())
        squares = np.full(n, np.inf)
        low = np.array([self.sorted[j].searchsorted(centre[j]) for j in range(PROJECTIONS)])
        high = low.copy()
        half = min(FIRST * self.unit, most)
        found = 0
        while found < others:
            inside = []
            for j in range(PROJECTIONS):
                a, b = self.sorted[j].searchsorted(centre[j] - half), self.sorted[j].searchsorted(centre[j] + half, side="right")
                inside += [self.order[j, a : low[j]], self.order[j, high[j] : b]]
                low[j], high[j] = min(a, low[j]), max(b, high[j])
            counts += np.bincount(np.concatenate(inside), minlength=n)
            fresh = np.flatnonzero((counts >= COLLISIONS) & ~seen)
            seen[fresh] = True
            found += len(fresh)
            squares[fresh] = self.norms[fresh] + norm - 2 * (self.vectors[fresh] @ query)
            if found >= k and np.partition(squares, k - 1)[k - 1] <= (REACH * half) ** 2:
                break
            if half >= most:
                break
            half = min(half * GROWTH, most)
        if found > k:
            last = np.partition(squares, k - 1)[k - 1]
            near = np.flatnonzero(squares <= last + 1e-9 * (norm + abs(last)))
        else:
            near = np.flatnonzero(np.isfinite(squares))
        distances = np.sqrt(((self.vectors[near] - query) ** 2).sum(axis=1))
        chosen = np.lexsort((self.ids[near], distances))[:k]
        return near[chosen], distances[chosen]

    def nearest_of_any(self, own: int, queries: np.ndarray, k: int, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids and distances of the k rows nearest to any of the queries, as above."""
        found = [self.nearest(own, query, k, half) for query, half in zip(queries, most, strict=True)]
        rows, distances = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((self.ids[rows], distances))
        _, first = np.unique(rows[order], return_index=True)
        chosen = order[np.sort(first)][:k]
        return self.ids[rows[chosen]], distances[chosen]


def _by_length(vectors: list) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Length, places and values of the vectors of each length."""
    sizes = np.array([len(v) for v in vectors])
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        yield int(size), at, np.array([vectors[i] for i in at])


def _with_cells(rows: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """rows with cells: the numbers of the nearest pivots of a vector's length."""

    def near(texts: pa.Array) -> pa.Array:
        out = [[0]] * len(texts)
        for size, at, vectors in _by_length(texts.to_pylist()):
            if size in pivots:
                own = pivots[size]
                for start in range(0, len(at), 2048):
                    part = vectors[start : start + 2048]
                    cells = np.argsort((own**2).sum(axis=1) - 2 * part @ own.T, axis=1, kind="stable")[:, :NEAR_CELLS]
                    for i, c in zip(at[start : start + 2048], cells.tolist(), strict=True):
                        out[i] = c
        return pa.array(out, pa.list_(pa.int32()))

    return rows.withColumn("cells", F.arrow_udf(near, "array<int>")("v"))


def _bounds(rows: DataFrame) -> DataFrame:
    """n, cell, line, low, high: the least and greatest projections of cells' vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low: dict[tuple[int, int], np.ndarray] = {}
        high: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            cells = batch.column(0).to_numpy()
            for size, at, vectors in _by_length(batch.column(1).to_pylist()):
                projected = vectors @ lines(size)
                for cell in np.unique(cells[at]):
                    own, key = projected[cells[at] == cell], (size, int(cell))
                    low[key] = np.minimum(low.get(key, np.inf), own.min(axis=0))
                    high[key] = np.maximum(high.get(key, -np.inf), own.max(axis=0))
        keys = list(low)
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()), *[pa.array([x[k].tolist() for k in keys], pa.list_(pa.float64())) for x in (low, high)]],
            names=["n", "cell", "low", "high"],
        )

    parts = rows.select("cell", "v").mapInArrow(run, "n int, cell int, low array<double>, high array<double>")
    each = parts.select("n", "cell", F.posexplode(F.arrays_zip("low", "high")).alias("line", "b"))
    return each.groupBy("n", "cell", "line").agg(F.min("b.low").alias("low"), F.max("b.high").alias("high"))


class _Plan:
    """Cells with their blocks and bounds; at most PIVOTS cells and one a length."""

    def __init__(self, counts: dict[tuple[int, int], int], block_rows: int) -> None:
        self.cells = sorted(counts)
        self.blocks = [-(-counts[c] // block_rows) for c in self.cells]
        self.number = {c: i for i, c in enumerate(self.cells)}
        self.low = np.full((len(self.cells), PROJECTIONS), -np.inf)
        self.high = np.full((len(self.cells), PROJECTIONS), np.inf)

    def bound(self, rows: list) -> None:
        for n, cell, line, low, high in rows:
            self.low[self.number[n, cell], line], self.high[self.number[n, cell], line] = low, high

    def met(self, size: int, centres: np.ndarray, halves: np.ndarray) -> np.ndarray:
        """Which cells (columns) can hold a candidate in queries' windows (rows)."""
        out = np.zeros((len(centres), len(self.cells)), bool)
        own = [i for i, (n, _) in enumerate(self.cells) if n == size]
        for i in own:
            inside = (self.low[i] <= centres + halves[:, None]) & (self.high[i] >= centres - halves[:, None])
            out[:, i] = inside.sum(axis=1) >= COLLISIONS
        return out


def _search(vectors: DataFrame, asked: DataFrame, plan: _Plan, k: int, query_rows: int, told: str) -> DataFrame:
    """What queries (row, query_id, v, half, place) find in places of vectors: the k
    best (query_id, vec_id, score) of each place, or (told = "row") each row's k-th
    distance there. A place's vectors are copied once for every query_rows queries."""
    counts = {r[0]: r[1] for r in asked.groupBy("place").count().collect()}
    groups = F.get(F.from_json(F.lit(json.dumps([-(-counts.get(i, 0) // query_rows) for i in range(sum(plan.blocks))])), "array<int>"), F.col("place"))
    dealt = vectors.withColumn("groups", groups).filter("groups > 0").withColumn("group", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)))
    asking = asked.withColumn("group", F.pmod(F.xxhash64("query_id", F.lit("query")), groups).cast("int"))

    def search(_: tuple, held: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(held) and len(queries):
            own = Block(held["vec_id"].to_numpy(), np.stack(held["v"].to_numpy()))
            if told == "row":
                kth = [own.nearest(q, np.asarray(v), k)[1] for q, v in zip(queries["query_id"], queries["v"], strict=True)]
                return pd.DataFrame({"row": queries["row"].to_numpy(), "score": [d[k - 1] if len(d) == k else np.inf for d in kth]})
            for query, same in queries.groupby("query_id"):
                ids, distances = own.nearest_of_any(query, np.stack(same["v"].to_numpy()), k, same["half"].to_numpy())
                found.append(pd.DataFrame({"query_id": query, "vec_id": ids, "score": distances}))
        columns = [c.split()[0] for c in kind.split(", ")]
        return pd.concat(found) if found else pd.DataFrame({c: [] for c in columns})

    kind = "row bigint, score double" if told == "row" else FOUND
    left = dealt.select("place", "group", "vec_id", "v").groupBy("place", "group")
    right = asking.select("place", "group", "row", "query_id", "v", "half").groupBy("place", "group")
    return left.cogroup(right).applyInPandas(search, kind)


def nearest_neighbours(
    df: DataFrame, queries: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", cell_rows: int = CELL_ROWS, block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score for every id that queries selects."""
    rows = df.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"), F.coalesce(queries, F.lit(False)).alias("asks"))
    rows = rows.filter(F.col("vec_id").isNotNull() & usable(F.col("v")))
    keyed = rows.withColumn("order", F.xxhash64("v"))
    wanted = min(PIVOTS, -(-rows.count() // cell_rows))
    last = keyed.select("order").distinct().orderBy("order").limit(wanted).agg(F.max("order")).first()[0]
    sample = keyed.filter(F.col("order") <= F.lit(last)).groupBy("order").agg(F.first("v").alias("v")).collect()  # at most PIVOTS
    pivots = {size: own for size, _, own in _by_length([r.v for r in sorted(sample)])}
    placed = _with_cells(rows, pivots).withColumns({"n": F.size("v"), "cell": F.get("cells", F.lit(0)), "row": F.monotonically_increasing_id()})
    placed = durable(placed, "vectors")
    plan = _Plan({(r[0], r[1]): r[2] for r in placed.groupBy("n", "cell").count().collect()}, block_rows)
    plan.bound(_bounds(placed).collect())
    first = dict(zip(plan.cells, np.cumsum([0, *plan.blocks]).tolist(), strict=False))
    known = F.from_json(F.lit(json.dumps([{"n": n, "c": c, "b": b, "f": first[n, c]} for (n, c), b in zip(plan.cells, plan.blocks, strict=True)])), "array<struct<n:int,c:int,b:int,f:int>>")
    cell_of = lambda n, c: F.get(F.filter(known, lambda x: (x["n"] == n) & (x["c"] == c)), F.lit(0))
    place_in = lambda cell, key: (cell["f"] + F.pmod(F.xxhash64(key), cell["b"])).cast("int")
    vectors = placed.withColumn("place", place_in(cell_of(F.col("n"), F.col("cell")), F.col("row"))).select("vec_id", "v", "place")

    asked = placed.filter("asks").select("row", F.col("vec_id").alias("query_id"), "v", "n", "cells", F.lit(float("inf")).alias("half"))
    near = asked.withColumn("cell", F.explode(F.filter("cells", lambda c: cell_of(F.col("n"), c).isNotNull())))
    near = near.withColumn("place", place_in(cell_of(F.col("n"), F.col("cell")), F.col("row")))
    kth = _search(vectors, near, plan, k, query_rows, "row").groupBy("row").agg(F.min("score").alias("kth"))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 512):
                batch = whole.slice(start, 512)
                kept, out, halves = [], [], []
                bounds = batch.column(3).to_numpy(zero_copy_only=False)
                for size, at, own in _by_length(batch.column(2).to_pylist()):
                    centres = own @ lines(size)
                    half = bounds[at] / REACH + 1e-6 * (1 + np.abs(centres).max(axis=1))  # sums in another order end in other bits
                    met = plan.met(size, centres, half)
                    for i, cells, h in zip(at, met, half, strict=True):
                        to = [first[plan.cells[c]] + b for c in np.flatnonzero(cells) for b in range(plan.blocks[c])]
                        kept += [i] * len(to)
                        out += to
                        halves += [h] * len(to)
                told = batch.select([0, 1, 2]).take(pa.array(kept, pa.int64()))
                yield pa.RecordBatch.from_arrays([*told.columns, pa.array(halves, pa.float64()), pa.array(out, pa.int32())], names=["row", "query_id", "v", "half", "place"])

    bounded = durable(asked.select("row", "query_id", "v").join(kth, "row").select("row", "query_id", "v", "kth"), "bounded-queries")
    routed = durable(bounded.mapInArrow(places, "row bigint, query_id bigint, v array<double>, half double, place int"), "routed-queries")
    found = _search(vectors, routed, plan, k, query_rows, "found")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
