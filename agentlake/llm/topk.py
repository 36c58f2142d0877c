"""Exact top-k inner products by a Voronoi join.

Vectors become integers. Pivots, a bounded sample of the queries, deal queries and data to cells by nearest pivot. Cells
are summed up: of its queries, a cell i has the greatest distance r from its pivot p; of its data, a cell j has the
greatest distance R and how many there are. For a data vector v every query q of cell i has p.v - r|v| <= q.v <= p.v + r|v|;
the (k+1)-th greatest lower bound over all data is reached by k others than the query itself. Data of cell j can matter to
cell i only if p_i.p_j + |p_i| R_j + r_i (|p_j| + R_j) reaches that far, and of it only the vectors whose own upper bound
does; these are counted and sent. Neighbouring cells of few queries are solved together, so no vector is sent to more than
a unit of them; a hot cell is many blocks of queries and slices of the data sent to it, whose lists are merged.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from agentlake.llm.shared import materialise

#: Queries in a block and data vectors in a slice that are solved together (both bound a task's memory).
QUERIES_AT_ONCE, DATA_AT_ONCE = 512, 8192
#: Vectors that a task sends on at once.
ROWS_AT_ONCE = 16_384
#: Largest sum of products that doubles hold exactly.
EXACT = 2**53


def _integers(batches: Iterator[pa.RecordBatch], scale: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, out = [], []
        for vec_id, vector in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if vec_id is None or vector is None or any(x is None for x in vector):
                continue
            vector = np.array(vector, dtype=float)
            if not np.isfinite(vector).all():
                continue
            with np.errstate(over="ignore"):
                x = np.floor(scale * vector)
            if not (np.abs(x) < 2**62).all():
                raise OverflowError("a finite component may leave 64 bits as an integer")
            ids.append(vec_id)
            out.append(x.astype("<i8").tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.binary())], ["vec_id", "v"])


def matrix(column, dims: int) -> np.ndarray:
    """Vectors as rows; shorter ones are filled up with zeros."""
    out = np.zeros((len(column), dims), dtype=np.int64)
    for i, x in enumerate(column):
        x = np.frombuffer(x, dtype="<i8")
        out[i, : len(x)] = x
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer a @ b.T: by doubles where no sum can leave their exact range, else by integers."""
    bound = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(a.shape[1], 1)
    if bound < EXACT:
        return np.rint(a.astype(float) @ b.T.astype(float)).astype(np.int64)
    if bound < 2**63:
        return a @ b.T
    raise OverflowError("an inner product may leave 64 bits")


def _cells(batches: Iterator[pa.RecordBatch], pivots: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(vec_id, v, cell, distance): the nearest pivot of each query."""
    p = pivots.astype(float)
    for batch in batches:
        if not batch.num_rows:
            continue
        x = matrix(batch.column(1).to_pylist(), p.shape[1]).astype(float)
        far = (x**2).sum(1)[:, None] - 2 * x @ p.T + (p**2).sum(1)[None, :]
        cell = far.argmin(1)
        distance = np.sqrt(((x - p[cell]) ** 2).sum(1))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cell.astype(np.int32)), pa.array(distance)], ["vec_id", "v", "cell", "distance"])


def _reach(x: np.ndarray, pivots: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """p.v and r|v| with the rounding of doubles on the safe side: (data, cells)."""
    slack = radius[None, :] * np.sqrt((x.astype(float) ** 2).sum(1))[:, None]
    return x.astype(float) @ pivots.T.astype(float), slack * (1 + 1e-9) + 1e-3


def _bounds(batches: Iterator[pa.RecordBatch], pivots: np.ndarray, radius: np.ndarray, k: int) -> Iterator[pa.RecordBatch]:
    """The k greatest lower bounds of each cell in a part of the data."""
    best = np.full((k, len(pivots)), -np.inf)
    for batch in batches:
        if batch.num_rows:
            centre, slack = _reach(matrix(batch.column(1).to_pylist(), pivots.shape[1]), pivots, radius)
            best = -np.sort(-np.concatenate([best, centre - slack]), axis=0)[:k]
    cell, value = np.tile(np.arange(len(pivots), dtype=np.int32), k), best.ravel()
    real = np.isfinite(value)
    yield pa.RecordBatch.from_arrays([pa.array(cell[real]), pa.array(value[real])], ["cell", "low"])


@dataclass
class Plan:
    """What tasks need to know of all cells; arrays of at most ``most_pivots`` rows (and columns).

    Cells are solved in units: neighbouring cells of few queries share one, so that a vector is sent to them once, and a
    cell of many queries is a unit of its own in several blocks.
    """

    pivots: np.ndarray
    radius: np.ndarray  # of a cell's queries
    floor: np.ndarray  # lower bound of a cell's k-th score
    meets: np.ndarray  # (data cell, query cell): whether data of the one can matter to the other
    unit: np.ndarray  # of each cell
    blocks: np.ndarray  # of queries, of each unit

    def wanted(self, batch: pa.RecordBatch) -> np.ndarray:
        """(data, cells): which vectors (vec_id, v, cell, distance) can matter to which cells' queries."""
        centre, slack = _reach(matrix(batch.column(1).to_pylist(), self.pivots.shape[1]), self.pivots, self.radius)
        return (centre + slack >= self.floor[None, :]) & self.meets[batch.column(2).to_numpy()]

    def sent(self, wanted: np.ndarray) -> np.ndarray:
        """(data, units): which vectors go to which units."""
        out = np.zeros((len(wanted), len(self.blocks)), dtype=bool)
        for cell, unit in enumerate(self.unit):
            out[:, unit] |= wanted[:, cell]
        return out


def units(pivots: np.ndarray, n_queries: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Each cell's unit, and the units' blocks: from a cell on to the nearest left while their queries fit into a block."""
    unit, blocks = np.zeros(len(pivots), dtype=np.int64), []
    p, left = pivots.astype(float), set(range(len(pivots)))
    at, room = 0, 0
    while left:
        near = min(left, key=lambda c: (float(((p[c] - p[at]) ** 2).sum()), c))
        if not blocks or n_queries[near] > room:
            blocks.append(max(1, -(-int(n_queries[near]) // most)))
            room = most if blocks[-1] == 1 else 0
        unit[near] = len(blocks) - 1
        room -= min(room, int(n_queries[near]))
        left.remove(near)
        at = near
    return unit, np.array(blocks, dtype=np.int64)


def pieces(batches: Iterator[pa.RecordBatch], rows: int = 2048) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first in range(0, batch.num_rows, rows):
            yield batch.slice(first, rows)


def _counted(batches: Iterator[pa.RecordBatch], plan: Plan, n_queries: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Vectors sent to each unit, and pairs of vectors and queries that they make (at unit -1)."""
    sent, pairs = np.zeros(len(plan.blocks), dtype=np.int64), 0
    for batch in pieces(batches):
        wanted = plan.wanted(batch)
        sent += plan.sent(wanted).sum(0)
        pairs += int((wanted.sum(0) * n_queries).sum())
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, len(sent), dtype=np.int32)), pa.array(np.concatenate([[pairs], sent]))], ["unit", "sent"])


def _dealt(batches: Iterator[pa.RecordBatch], plan: Plan, slices: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Each data vector for each block of queries of each unit that it can matter to."""
    for batch in pieces(batches):
        rows, units_ = np.nonzero(plan.sent(plan.wanted(batch)))
        times = plan.blocks[units_]
        rows, units_ = np.repeat(rows, times), np.repeat(units_, times)
        blocks = np.arange(len(rows)) - np.repeat(np.cumsum(times) - times, times)
        ids = batch.column(0).to_numpy()
        for a in range(0, len(rows), ROWS_AT_ONCE):
            row, unit, block = (x[a : a + ROWS_AT_ONCE] for x in (rows, units_, blocks))
            part = (ids[row] * 0x9E3779B1 & 0x7FFFFFFF) % slices[unit]
            at = pa.array(row)
            yield pa.RecordBatch.from_arrays([pa.array(unit.astype(np.int32)), pa.array(block.astype(np.int32)), pa.array(part.astype(np.int32)), batch.column(0).take(at), batch.column(1).take(at)], ["unit", "block", "slice", "vec_id", "v"])


def _solved(left: pa.Table, right: pa.Table, k: int, dims: int) -> pa.Table:
    """The k best of a slice of data for a block of queries; ties go to the smaller vec_id."""
    order = np.argsort(right["vec_id"].to_numpy(), kind="stable")
    ids = right["vec_id"].to_numpy()[order]
    data = matrix(right["v"].to_pylist(), dims)[order]
    queries = left["vec_id"].to_numpy()
    out: list[list] = [[], [], []]
    if len(ids) and len(queries):
        scores = products(matrix(left["v"].to_pylist(), dims), data)
        for i, q in enumerate(queries):
            at = np.flatnonzero(ids != q)
            s = scores[i][at]
            if len(s) > k:
                least = np.partition(s, len(s) - k)[len(s) - k]
                keep = np.flatnonzero(s >= least)
                at, s = at[keep], s[keep]
            best = np.lexsort((ids[at], -s))[:k]
            out[0] += [q] * len(best)
            out[1] += ids[at][best].tolist()
            out[2] += s[best].tolist()
    return pa.table({"query_id": pa.array(out[0], pa.int64()), "vec_id": pa.array(out[1], pa.int64()), "score": pa.array(out[2], pa.int64())})


@dataclass
class Voronoi:
    """data and queries (vec_id, v, cell, distance), the plan, how many vectors go to each unit, and how many pairs of a
    vector and a query the bounds leave of all."""

    data: DataFrame
    queries: DataFrame
    plan: Plan
    sent: np.ndarray
    pairs: int
    all_pairs: int


CELLS = "vec_id long, v binary, cell int, distance double"


def grouped(vectors: DataFrame, k: int, every: int, scale: int, most_pivots: int) -> Voronoi | None:
    """The join before any data is sent; None without queries."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    plain = materialise(rows.mapInArrow(partial(_integers, scale=scale), "vec_id long, v binary"), "integers")
    asked = plain.filter(F.col("vec_id") % every == 0)
    size = plain.agg(F.count(F.lit(1)), F.max(F.octet_length("v"))).first()
    chosen = asked.distinct().orderBy(F.xxhash64("vec_id"), "vec_id").limit(most_pivots).collect()  # at most ``most_pivots`` rows
    if not chosen:
        return None
    pivots = matrix([r["v"] for r in chosen], size[1] // 8)
    m = len(pivots)
    data = materialise(plain.mapInArrow(partial(_cells, pivots=pivots), CELLS), "cells")
    queries = materialise(data.filter(F.col("vec_id") % every == 0).distinct(), "queries")

    def told(df: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        summary = {r[0]: r for r in df.groupBy("cell").agg(F.max("distance"), F.count(F.lit(1))).collect()}  # a row per pivot
        return np.array([summary[c][1] if c in summary else 0.0 for c in range(m)]), np.array([summary[c][2] if c in summary else 0 for c in range(m)])

    radius, n_queries = told(queries)
    reach, _ = told(data)
    lows = data.mapInArrow(partial(_bounds, pivots=pivots, radius=radius, k=k + 1), "cell int, low double")
    ranked = lows.withColumn("n", F.row_number().over(Window.partitionBy("cell").orderBy(F.desc("low")))).filter(F.col("n") == k + 1)
    reached = {r[0]: r[1] for r in ranked.select("cell", "low").collect()}  # a row per pivot
    # a repeated id may stand k + 1 times for the query itself: then nothing is known
    repeats = asked.groupBy("vec_id").count().filter("count > 1").limit(1).count()
    floor = np.array([-np.inf if repeats else reached.get(c, -np.inf) for c in range(m)])
    p = pivots.astype(float)
    norm = np.sqrt((p**2).sum(1))
    most = p @ p.T + norm[None, :] * reach[:, None] + radius[None, :] * (norm + reach)[:, None]
    plan = Plan(pivots, radius, floor, (most * (1 + np.sign(most) * 1e-9) + 1e-3 >= floor[None, :]) & (n_queries > 0)[None, :], *units(pivots, n_queries, QUERIES_AT_ONCE))
    counts = data.mapInArrow(partial(_counted, plan=plan, n_queries=n_queries), "unit int, sent long").groupBy("unit").agg(F.sum("sent"))
    counted = {r[0]: r[1] for r in counts.collect()}  # a row per unit
    return Voronoi(data, queries, plan, np.array([counted.get(u, 0) for u in range(len(plan.blocks))]), counted.get(-1, 0), size[0] * int(n_queries.sum()))


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, scale: int = 256, most_pivots: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose vec_id is divisible by ``every`` the ``k`` greatest inner products.

    Vectors (vec_id, embedding) that are null, hold nulls or non-finite numbers, or have a null id take no part; shorter
    ones count as filled up with zeros, very long ones count whole, and a finite component too large for an integer fails
    the query. A query has no rows if there is no other vector. Rows that repeat a vec_id are candidates of their own, but
    none for a query of that id; if its rows hold several vectors, it has the best of what they find together. Ties go to the smaller vec_id.
    An empty table gives no rows; other columns are ignored, whatever their names.
    """
    found = grouped(vectors, k, every, scale, most_pivots)
    if found is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    plan, dims = found.plan, found.plan.pivots.shape[1]
    slices = np.maximum(1, -(-found.sent // DATA_AT_ONCE))
    sent = found.data.mapInArrow(partial(_dealt, plan=plan, slices=slices), "unit int, block int, slice int, vec_id long, v binary")
    among = lambda x, column: F.element_at(F.array(*(F.lit(int(n)) for n in x)), F.col(column) + 1)
    asked = found.queries.withColumn("unit", among(plan.unit, "cell")).filter(among(found.sent > 0, "unit") == 1)
    asked = asked.withColumn("block", F.pmod(F.xxhash64("vec_id", "v"), among(plan.blocks, "unit")).cast("int")).withColumn("slice", F.explode(F.sequence(F.lit(0), among(slices, "unit") - 1)))
    key = ["unit", "block", "slice"]
    solved = asked.select(*key, "vec_id", "v").groupBy(*key).cogroup(sent.groupBy(*key)).applyInArrow(partial(_solved, k=k, dims=dims), "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return solved.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
