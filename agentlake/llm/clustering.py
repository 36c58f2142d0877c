"""Centroid clustering by delta Lloyd: exact integer k-means that redoes only what a round has changed.

What is kept from round to round is each vector's owner and distance (a table beside the vector) and, on the driver, the
sum and the number of each cluster's vectors (k rows, whatever the data). A centroid that its round left where it was is
unchanged. A vector whose owner is unchanged can only go over to a changed centroid, so it is compared with those alone; one
whose owner moved is compared with all. Vectors that go over are summed up as signed transfers, minus for the cluster they
leave and plus for the one they join, task by task; the sums are carried on with these and never made anew.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agentlake.llm.shared import materialise, release_table
from agentlake.llm.topk import EXACT
from agentlake.llm.words import tidy

#: Vectors that are compared at once (bounds a task's memory).
ROWS_AT_ONCE = 8192
#: Components below this in magnitude keep sums of 10**11 vectors and distances of thousands of components within 64 bits.
MOST = 2**26


def flat(column: pa.Array, dims: int) -> np.ndarray:
    """Lists of ``dims`` numbers, none null, as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dims)


@tidy
def _integers(batches: Iterator[pa.RecordBatch], dims: int, scale: int) -> Iterator[pa.RecordBatch]:
    """(vec_id, v) of the vectors that take part: v is their components as 32-bit integers."""
    for batch in batches:
        vectors = batch.column(1)
        right = pc.fill_null(pc.equal(pc.list_value_length(vectors), dims), False)
        batch = batch.filter(right)
        values = batch.column(1).flatten()
        whole = np.isfinite(pc.fill_null(values, float("nan")).to_numpy(zero_copy_only=False)).reshape(-1, dims).all(axis=1)
        batch = batch.filter(pa.array(whole))
        x = np.floor(scale * flat(batch.column(1), dims))
        if np.abs(x).max(initial=0) >= MOST:
            raise OverflowError("a component leaves the range of integers whose sums are exact")
        for a in range(0, len(x), ROWS_AT_ONCE):
            part = x[a : a + ROWS_AT_ONCE].astype("<i4")
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, ROWS_AT_ONCE), pa.array([r.tobytes() for r in part], pa.binary())], ["vec_id", "v"])


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<i4").reshape(len(column), dims)


def distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances (rows, centroids): by doubles where no sum can leave their exact range, else by integers."""
    most = float(max(np.abs(x).max(initial=0), np.abs(centroids).max(initial=0)))
    kind = float if 4 * most * most * max(x.shape[1], 1) < EXACT else np.int64
    a, b = x.astype(kind), centroids.astype(kind)
    return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None, :]).astype(np.int64)


def nearest(x: np.ndarray, owner: np.ndarray, distance: np.ndarray, centroids: np.ndarray, changed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's nearest centroid (ties: the smaller number) and distance, given those before ``changed`` ones moved."""
    owner, distance = owner.copy(), distance.copy()
    lost = (owner < 0) | changed[owner]
    for rows, among in ((np.flatnonzero(lost), np.arange(len(centroids))), (np.flatnonzero(~lost), np.flatnonzero(changed))):
        if not len(rows) or not len(among):
            continue
        far = distances(x[rows], centroids[among])
        best = far.argmin(1)  # the first of equals, and ``among`` ascends
        d, c = far[np.arange(len(rows)), best], among[best]
        if among.size < len(centroids):
            stays = (distance[rows] < d) | ((distance[rows] == d) & (owner[rows] < c))
            d, c = np.where(stays, distance[rows], d), np.where(stays, owner[rows], c)
        owner[rows], distance[rows] = c, d
    return owner, distance


@tidy
def _assigned(batches: Iterator[pa.RecordBatch], centroids: np.ndarray, changed: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(vec_id, v, was, cluster, distance) from (vec_id, v, cluster, distance)."""
    for batch in batches:
        for a in range(0, batch.num_rows, ROWS_AT_ONCE):
            part = batch.slice(a, ROWS_AT_ONCE)
            was, before = part.column(2).to_numpy(), part.column(3).to_numpy()
            owner, distance = nearest(matrix(part.column(1), centroids.shape[1]), was, before, centroids, changed)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(was), pa.array(owner.astype(np.int32)), pa.array(distance)], ["vec_id", "v", "was", "cluster", "distance"])


@tidy
def _transfers(batches: Iterator[pa.RecordBatch], k: int, dims: int) -> Iterator[pa.RecordBatch]:
    """(cluster, signed number and sums of the vectors that this task's rows bring it or take from it)."""
    total = np.zeros((k + 1, dims + 1), dtype=np.int64)  # the last row is for vectors that had no owner
    for batch in batches:
        one = np.concatenate([np.ones((batch.num_rows, 1), dtype=np.int64), matrix(batch.column(0), dims)], axis=1)
        np.add.at(total, batch.column(2).to_numpy(), one)
        np.subtract.at(total, batch.column(1).to_numpy(), one)
    touched = np.flatnonzero(total[:k].any(axis=1))
    yield pa.RecordBatch.from_arrays([pa.array(touched.astype(np.int32)), pa.array(list(total[touched]), pa.list_(pa.int64()))], ["cluster", "moved"])


@dataclass
class Clustering:
    """vectors (vec_id, v, was, cluster, distance) after the last assignment, the final centroids, and how many vectors
    went over in each assignment."""

    vectors: DataFrame
    centroids: np.ndarray
    moved: list[int]


def delta_lloyd(vectors: DataFrame, k: int = 40, rounds: int = 5, dims: int = 64, scale: int = 256, salt: str = "2:") -> Clustering | None:
    """``rounds`` of assigning and moving centroids and a last assignment; None without a vector that takes part."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    plain = materialise(rows.mapInArrow(partial(_integers, dims=dims, scale=scale), "vec_id long, v binary"), "integers")
    order = F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")).cast("binary"), 256)
    chosen = plain.orderBy(order.asc_nulls_last(), "v").limit(k).collect()  # k rows
    if not chosen:
        release_table(plain)
        return None
    centroids = np.stack([np.frombuffer(r["v"], dtype="<i4") for r in chosen]).astype(np.int64)
    n = len(centroids)
    sums, changed, moved = np.zeros((n, dims + 1), dtype=object), np.ones(n, dtype=bool), []  # object: Python's integers
    table = plain.select("vec_id", "v", F.lit(-1).alias("cluster"), F.lit(0).cast("long").alias("distance"))
    last = plain
    for r in range(rounds + 1):
        if not changed.any():
            moved.append(0)
            continue
        now = materialise(table.mapInArrow(partial(_assigned, centroids=centroids, changed=changed), "vec_id long, v binary, was int, cluster int, distance long"), "assigned")
        release_table(last)
        last, table = now, now.select("vec_id", "v", "cluster", "distance")
        signed = now.filter("was <> cluster").select("v", "was", "cluster").mapInArrow(partial(_transfers, k=n, dims=dims), "cluster int, moved array<long>")
        each = signed.select("cluster", F.posexplode("moved").alias("at", "x")).groupBy("cluster", "at").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x"))
        came = 0
        for cluster, at, x in each.collect():  # at most k * (dims + 1) rows
            sums[cluster, at] += int(x)
        came = now.filter("was <> cluster").count()
        moved.append(came)
        if r < rounds:
            new = np.array([[s // row[0] for s in row[1:]] if row[0] else list(old) for row, old in zip(sums.tolist(), centroids.tolist(), strict=True)], dtype=np.int64)
            changed, centroids = (new != centroids).any(axis=1), new
    return Clustering(last, centroids, moved)


def cluster(vectors: DataFrame, k: int = 40, rounds: int = 5, dims: int = 64, scale: int = 256, salt: str = "2:") -> DataFrame:
    """vec_id, cluster, distance (squared), centroid (of the cluster, integers), cluster_inertia and inertia (distance summed).

    Components x become floor(scale * x). The first centroids are the ``k`` vectors with the smallest sha256 of ``salt``
    and vec_id (fewer, if there are fewer vectors); ties of distance go to the smaller number, a cluster without vectors
    keeps its centroid, others move to the floor of the mean. Vectors that are null, not of ``dims`` components or hold
    nulls or non-finite numbers take no part and have no row. Repeated rows and ids are vectors of their own (of equal ids
    the smaller vector is chosen first); a null vec_id takes part but is chosen last. Components of 2**26 and more after
    scaling fail the run. An empty table gives no rows; other columns are ignored, whatever their names.
    """
    found = delta_lloyd(vectors, k, rounds, dims, scale, salt)
    spark = vectors.sparkSession
    if found is None:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, centroid array<long>, cluster_inertia long, inertia long")
    each = found.vectors.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia")).collect()  # at most k rows
    total = sum(r["cluster_inertia"] for r in each)
    known = spark.createDataFrame([(r["cluster"], found.centroids[r["cluster"]].tolist(), r["cluster_inertia"], total) for r in each], "cluster int, centroid array<long>, cluster_inertia long, inertia long")
    return found.vectors.join(F.broadcast(known), "cluster").select("vec_id", "cluster", "distance", "centroid", "cluster_inertia", "inertia")
