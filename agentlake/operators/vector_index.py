"""Approximate vector search: an inverted file of cells, stored as a table.

``build`` finds centres on a bounded sample, deals all vectors to their nearest centre and writes them partitioned by cell;
``append`` deals new vectors to the same cells. ``search`` looks at each query's nearest cells only: the scan is pruned to
cells that some query probes, each vector goes to one task, and queries, not vectors, are copied. How many cells a query
probes isn't guessed: ``probes_for`` takes the fewest that find a given share of the true neighbours of a sample of queries.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from agentlake.operators.retrieval import MOST_RESULTS, top

#: Vectors that centres are found on, and the most cells: what the driver and every task hold.
SAMPLE, MOST_CELLS = 20_000, 2048
#: Vectors and queries of a cell that are met together; vectors that are dealt at once.
VECTORS_AT_ONCE, QUERIES_AT_ONCE, ROWS_AT_ONCE = 65_536, 2048, 4096


def _unit(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lists of one length as rows of length 1 (rows without a length stay zero), and whether they have one."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)
    length = np.sqrt((x * x).sum(axis=1))
    return x / np.where(length > 0, length, 1)[:, None], length > 0


def _centres(x: np.ndarray, n: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means from evenly spaced rows; a centre without vectors stays."""
    centres = x[np.linspace(0, len(x) - 1, n).astype(int)].copy()
    for _ in range(rounds):
        owner = np.concatenate([(x[a : a + ROWS_AT_ONCE] @ centres.T).argmax(axis=1) for a in range(0, len(x), ROWS_AT_ONCE)])
        total = np.zeros_like(centres)
        np.add.at(total, owner, x)
        length = np.sqrt((total * total).sum(axis=1))
        centres[length > 0] = total[length > 0] / length[length > 0, None]
    return centres


@dataclass(frozen=True)
class Index:
    """cells (cell, centre) and vectors (vec_id, embedding, cell, slice) below a folder."""

    spark: SparkSession
    path: str

    def centres(self) -> np.ndarray:
        return np.array([r["centre"] for r in self.spark.read.parquet(f"{self.path}/cells").orderBy("cell").collect()])  # at most MOST_CELLS

    def vectors(self) -> DataFrame:
        return self.spark.read.schema("vec_id long, embedding array<double>, slice int, cell int").parquet(f"{self.path}/vectors")


def _usable(vectors: DataFrame, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """vec_id, embedding of vectors that are there, hold numbers only and have a length."""
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(column).cast("array<double>").alias("embedding"))
    wrong = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).filter(~wrong & F.exists("embedding", lambda x: x != 0))


def _dealt(batches: Iterator[pa.RecordBatch], centres: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a in range(0, batch.num_rows, ROWS_AT_ONCE):
            part = batch.slice(a, ROWS_AT_ONCE)
            x, _ = _unit(part.column(1))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array((x @ centres.T).argmax(axis=1).astype(np.int32))], ["vec_id", "embedding", "cell"])


def _load(vectors: DataFrame, centres: np.ndarray, path: str) -> None:
    """Dealt and written by cell; a cell of many vectors is written by several tasks, in slices."""
    dealt = _usable(vectors).mapInArrow(partial(_dealt, centres=centres), "vec_id long, embedding array<double>, cell int")
    slices = max(1, -(-vectors.count() // VECTORS_AT_ONCE))
    dealt = dealt.withColumn("slice", F.pmod(F.xxhash64("vec_id"), F.lit(slices)).cast("int"))
    dealt.repartitionByRange("cell", "slice").sortWithinPartitions("cell", "slice").write.mode("append").partitionBy("cell").parquet(f"{path}/vectors")


def build(vectors: DataFrame, path: str, cells: int | None = None) -> Index:
    """An index of all ``vectors`` (vec_id, embedding; one length) in a new folder. cells: about the square root of their
    number unless given. Vectors that are null, without length or not finite, and those without an id, are left out."""
    rows = _usable(vectors)
    n = rows.count()
    if not n:
        raise ValueError("no vectors to index")
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("embedding").toArrow()  # at most SAMPLE rows
    x, _ = _unit(sample["embedding"].combine_chunks())
    cells = min(cells or max(1, int(np.sqrt(n))), MOST_CELLS, len(x))
    centres = _centres(x, cells)
    vectors.sparkSession.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cell int, centre array<double>").coalesce(1).write.mode("errorifexists").parquet(f"{path}/cells")
    _load(vectors, centres, path)
    return Index(vectors.sparkSession, path)


def append(index: Index, vectors: DataFrame) -> None:
    """New vectors go to the cells that there are."""
    _load(vectors, index.centres(), index.path)


def _probed(batches: Iterator[pa.RecordBatch], centres: np.ndarray, probes: int) -> Iterator[pa.RecordBatch]:
    """(vec_id, embedding, cell) for each of a query's nearest cells."""
    for batch in batches:
        for a in range(0, batch.num_rows, ROWS_AT_ONCE):
            part = batch.slice(a, ROWS_AT_ONCE)
            x, _ = _unit(part.column(1))
            near = np.argsort(-(x @ centres.T), axis=1, kind="stable")[:, :probes]
            at = pa.array(np.repeat(np.arange(len(x)), near.shape[1]))
            yield pa.RecordBatch.from_arrays([part.column(0).take(at), part.column(1).take(at), pa.array(near.ravel().astype(np.int32))], ["vec_id", "embedding", "cell"])


def _met(left: pa.Table, right: pa.Table, k: int) -> pa.Table:
    """The k best cosines, rounded to 6 places, of a slice of a cell's vectors for a block of its queries."""
    out: list[list[np.ndarray]] = [[np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0)]]
    if left.num_rows and right.num_rows:
        queries, _ = _unit(left["embedding"].combine_chunks())
        ids, asked = right["vec_id"].to_numpy(), left["vec_id"].to_numpy()
        data, _ = _unit(right["embedding"].combine_chunks())
        for a in range(0, len(queries), 256):
            scores = np.round(queries[a : a + 256] @ data.T, 6)
            for i, score in enumerate(scores):
                at = np.arange(len(score)) if len(score) <= k else np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
                at = at[np.lexsort((ids[at], -score[at]))[:k]]
                for column, values in zip(out, (np.full(len(at), asked[a + i]), ids[at], score[at]), strict=True):
                    column.append(values)
    return pa.table([pa.array(np.concatenate(x)) for x in out], ["query_id", "vec_id", "score"])


def search(index: Index, queries: DataFrame, k: int, probes: int) -> DataFrame:
    """query_id, rank, vec_id, score: the k greatest cosines (at most 20) among each query's ``probes`` nearest cells.

    queries: query_id, q. With as many probes as cells the search is exact. Ties go to the smaller vec_id.
    """
    k = min(max(k, 1), MOST_RESULTS)
    asked = _usable(queries, "query_id", "q").mapInArrow(partial(_probed, centres=index.centres(), probes=probes), "vec_id long, embedding array<double>, cell int")
    blocks = F.ceil(F.count(F.lit(1)) / QUERIES_AT_ONCE).cast("int").alias("blocks")
    held = index.vectors().groupBy("cell").agg((F.max("slice") + 1).alias("slices"))
    plan = F.broadcast(asked.groupBy("cell").agg(blocks).join(held, "cell"))  # a row for each cell, at most MOST_CELLS
    each = lambda n, name: F.explode(F.sequence(F.lit(0), F.col(n) - 1)).alias(name)
    asked = asked.join(plan, "cell").withColumn("block", F.pmod(F.xxhash64("vec_id"), "blocks").cast("int")).select("cell", "block", each("slices", "slice"), "vec_id", "embedding")
    data = index.vectors().join(plan.select("cell", "blocks"), "cell").select("cell", each("blocks", "block"), "slice", "vec_id", "embedding")
    key = ["cell", "block", "slice"]
    found = asked.groupBy(*key).cogroup(data.groupBy(*key)).applyInArrow(partial(_met, k=k), "query_id long, vec_id long, score double")
    return top(found, "query_id", [F.desc("score"), F.col("vec_id")], k).select("query_id", "rank", "vec_id", "score")


def _best(batches: Iterator[pa.RecordBatch], queries: pa.Table, k: int) -> Iterator[pa.RecordBatch]:
    """(query_id, vec_id, score, cell): each batch's best for all sample queries."""
    for batch in batches:
        for a in range(0, batch.num_rows, ROWS_AT_ONCE):
            part = pa.Table.from_batches([batch.slice(a, ROWS_AT_ONCE)])
            found = _met(queries, part, k)
            cell = part["cell"].take(pc.index_in(found["vec_id"], value_set=part["vec_id"].combine_chunks()))
            yield from found.append_column("cell", cell).combine_chunks().to_batches()


def probes_for(index: Index, queries: DataFrame, k: int, goal: float = 0.95, sample: int = 100) -> int:
    """The fewest probes with which ``sample`` queries (smallest hashes of their id) find the share ``goal`` of their true
    k neighbours, which one pass over all vectors gives."""
    some = _usable(queries, "query_id", "q").orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).toArrow()  # ``sample`` rows
    if not some.num_rows:
        return 1
    near = index.vectors().select("vec_id", "embedding", "cell").mapInArrow(partial(_best, queries=some, k=k), "query_id long, vec_id long, score double, cell int")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    true = near.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "cell").collect()  # k rows for each of the sample
    centres = index.centres()
    x, _ = _unit(some["embedding"].combine_chunks())
    place = dict(zip(some["vec_id"].to_pylist(), np.argsort(np.argsort(-(x @ centres.T), axis=1, kind="stable"), axis=1), strict=True))
    needed = sorted(int(place[r["query_id"]][r["cell"]]) + 1 for r in true)
    return needed[max(0, int(np.ceil(goal * len(needed))) - 1)] if needed else 1
