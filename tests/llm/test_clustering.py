"""Delta Lloyd against plain Lloyd, and its SQL."""

import hashlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from agentlake.llm import clustering, queries


def plain(rows, k, rounds, dims):
    """(vec_id, cluster, distance) sorted, and the centroids."""
    held = [(i, tuple(int(np.floor(256 * float(x))) for x in v)) for i, v in rows if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v)]
    order = sorted(held, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), np.array(r[1], dtype="<i4").tobytes()))
    centroids = [list(v) for _, v in order[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(centroids)) for _, v in held]

    for _ in range(rounds):
        owner = assign()
        for n in range(len(centroids)):
            mine = [v for (_, v), (_, c) in zip(held, owner, strict=True) if c == n]
            if mine:
                centroids[n] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    return sorted((str(i), c, d) for (i, _), (d, c) in zip(held, assign(), strict=True)), centroids


def some(seed=1, n=400, dims=5):
    r = np.random.default_rng(seed)
    x = np.concatenate([r.normal(size=(n, dims)), np.repeat(r.normal(size=(1, dims)), 130, axis=0), np.round(r.normal(size=(40, dims)))])
    rows = [(i, [float(v) for v in x[i]]) for i in range(len(x))]
    odd = [(900, None), (901, [1.0, None, 0.0, 0.0, 0.0]), (902, [float("nan")] * dims), (903, [float("inf")] * dims), (904, [1.0] * (dims - 1)), (905, []), (None, [0.5] * dims), (7, rows[7][1]), (7, [0.25] * dims)]
    return rows + odd


@pytest.mark.parametrize("k", [3, 25, 2000])
def test_against_plain_lloyd(spark, k):
    rows = some() if k < 2000 else some(n=20)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("v", F.lit("clash")).withColumn("cluster", F.lit(-7)).repartition(4)
    want, centroids = plain(rows, k, 5, 5)
    got = clustering.cluster(df, k=k, dims=5).collect()
    assert sorted((str(g["vec_id"]), g["cluster"], g["distance"]) for g in got) == want
    assert all(g["centroid"] == centroids[g["cluster"]] and g["inertia"] == sum(w[2] for w in want) for g in got)
    assert all(g["cluster_inertia"] == sum(w[2] for w in want if w[1] == g["cluster"]) for g in got)


def test_unchanged_work_is_left_out(spark):
    """Far groups settle: later assignments move nobody, and once no centroid has changed there is no pass at all."""
    r = np.random.default_rng(3)
    x = np.concatenate([c + 0.1 * r.normal(size=(100, 4)) for c in 50 * r.normal(size=(3, 4))])
    df = spark.createDataFrame([(i, [float(v) for v in x[i]]) for i in range(300)], "vec_id long, embedding array<double>")
    found = clustering.delta_lloyd(df, k=3, rounds=12, dims=4)
    assert found.moved[0] == 300 and found.moved[-1] == 0 and len(found.moved) == 13
    asked, full = [], clustering.distances
    try:
        clustering.distances = lambda a, b: asked.append((len(a), len(b))) or full(a, b)
        owner, distance = np.array([0, 1, 2, 2]), np.array([4, 1, 9, 1])
        c = np.array([[0], [10], [20]])
        now, d = clustering.nearest(np.array([[2], [11], [17], [21]]), owner, distance, c, np.array([True, False, False]))
    finally:
        clustering.distances = full
    assert asked == [(1, 3), (3, 1)] and now.tolist() == [0, 1, 2, 2] and d.tolist() == [4, 1, 9, 1]


def test_empty_and_too_large(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert clustering.cluster(none).count() == 0 and clustering.cluster(none).columns == ["vec_id", "cluster", "distance", "centroid", "cluster_inertia", "inertia"]
    with pytest.raises(Exception, match="exact"):
        clustering.cluster(spark.createDataFrame([(1, [1e9])], "vec_id long, embedding array<double>"), dims=1).count()
    big = np.array([[2**25, -(2**25)]])
    assert clustering.distances(big, -big).tolist() == [[2**53]]


def test_query_equals_sql(spark):
    folder = "/root/testdata/sf0.001"
    got = sorted(tuple(r) for r in queries.op12_clustering(spark, folder).collect())
    c = duckdb.connect()
    c.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet'")
    assert got == sorted(c.sql(queries.ORACLE_SQL["op12_clustering"]).fetchall()) and len(got) == 500
