"""The hash forest against brute force: the share of true neighbours found, exact scores, and odd rows."""

from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from agentlake.llm import hash_forest

ALL = hash_forest.Settings(goal=1.0)


def searched(df, **kwargs):
    got = defaultdict(list)
    for g in sorted(hash_forest.neighbours(df, **kwargs).collect(), key=lambda g: (g["query_id"], g["rank"])):
        assert g["rank"] == len(got[g["query_id"]]) + 1
        got[g["query_id"]].append((g["vec_id"], g["score"]))
    return got


def brute(ids, x, k, every):
    out = {}
    for i, q in zip(ids, x, strict=True):
        if i % every == 0:
            score = (x * q).sum(axis=1)
            out[i] = [(int(ids[j]), float(score[j])) for j in np.lexsort((ids, -score)) if ids[j] != i][:k]
    return out


def share(got, want):
    return sum(len({i for i, _ in got[q]} & {i for i, _ in w}) for q, w in want.items()) / sum(len(w) for w in want.values())


def table(spark, ids, x, kind="float"):
    rows = [(int(i), [float(v) for v in row]) for i, row in zip(ids, x, strict=True)]
    return spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").withColumn("keys", F.lit("clash")).withColumn("node", F.lit(1)).repartition(4)


@pytest.mark.parametrize("shape", ["sphere", "groups", "norms"])
def test_recall(spark, shape):
    """9,000 vectors without structure, in tight groups, and of very different norms; exact scores in all."""
    r = np.random.default_rng(2)
    x = r.normal(size=(9000, 32))
    if shape == "groups":
        x = r.normal(size=(60, 32))[r.integers(0, 60, 9000)] + 0.05 * x
    x /= np.linalg.norm(x, axis=1)[:, None]
    if shape == "norms":
        x *= r.lognormal(0, 1, size=(9000, 1))
    x = x.astype("float32").astype(float)
    ids = np.arange(9000)
    settings = hash_forest.Settings(trees=32, goal=0.93)
    df = table(spark, ids, x)
    got, want = searched(df, k=10, every=40, settings=settings), brute(ids, x, 10, 40)
    assert share(got, want) >= 0.9 and set(got) == set(want)
    for q, found in got.items():
        assert all(s == float((x[i] * x[q]).sum()) for i, s in found) and len(found) == 10
        assert found == sorted(found, key=lambda f: (-f[1], f[0])) and q not in [i for i, _ in found]


def test_enough_for_each_level():
    """Half of the queries that stop with few candidates miss their neighbours; those with many find them."""
    seen = [(30, [2, 0], 2)] * 10 + [(500, [2, 3], 2)] * 10
    assert hash_forest._fewest(seen, 9, 0.9) == 40 and hash_forest._fewest(seen, 9, 0.7) == 10
    assert hash_forest._fewest(seen[:10], 9, 0.9) is None and hash_forest._fewest([], 9, 0.9) is None


def test_dense_places_find_theirs(spark):
    """A thousand near copies among others: the queries among them find their nearest as the rest do."""
    r = np.random.default_rng(12)
    x = r.normal(size=(5000, 24))
    x[:1000] = x[0] + 0.05 * r.normal(size=(1000, 24))
    x /= np.linalg.norm(x, axis=1)[:, None]
    got, want = searched(table(spark, np.arange(5000), x, "double"), k=10), brute(np.arange(5000), x, 10, 20)
    dense = {q: w for q, w in want.items() if q < 1000}
    assert share(got, dense) >= 0.85 and share(got, want) >= 0.9


def test_copies_ties_and_odd_rows(spark):
    """A third of the rows are one vector, queries among them; with the whole share as the goal and all queries in the sample, all is found."""
    r = np.random.default_rng(8)
    x = r.normal(size=(900, 6))
    x[100:400] = x[100]
    x[500:520] = -x[100]
    ids = np.arange(900)
    odd = [(2000, None), (2020, [1.0, None]), (2040, [0.0] * 6), (2060, [float("nan")] * 6), (2080, [float("inf")] + [1.0] * 5), (2100, []), (None, [9.0] * 6), (3, [float(v) for v in x[3]]), (2121, [0.5])]
    df = table(spark, ids, x, "double").select("vec_id", "embedding").union(spark.createDataFrame(odd, "vec_id long, embedding array<double>"))
    want = brute(np.append(ids, 2121), np.concatenate([x, [[0.5, 0, 0, 0, 0, 0]]]), 7, 20)
    assert dict(searched(df, k=7, settings=ALL)) == want
    assert hash_forest.neighbours(df.limit(0)).count() == 0 and hash_forest.neighbours(df.filter("vec_id in (20, 2000)")).count() == 0
    two = searched(df.filter("vec_id in (20, 21, 22)"), k=7, settings=ALL)
    assert list(two) == [20] and sorted(i for i, _ in two[20]) == [21, 22]


def test_few_near_copies_are_not_enough(spark):
    """A query whose close company is one near copy, which all trees hold, still gets all of its k."""
    r = np.random.default_rng(6)
    x = r.normal(size=(4000, 16))
    x[1::20] = x[::20] + 1e-6 * r.normal(size=(200, 16))
    got = searched(table(spark, np.arange(4000), x, "double"), k=10, settings=hash_forest.Settings(trees=16, goal=0.3, axes=16))
    assert len(got) == 200 and all(len(found) == 10 for found in got.values())


def test_repeated_id_counts_once(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 1.0]), (1, [1.0, 1.0]), (2, [2.0, 0.0]), (2, [-1.0, 0.0])]
    got = searched(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=5, settings=ALL)
    least = min(rows[3:], key=lambda r: np.array(r[1]).tobytes())[1]
    assert got == {0: sorted([(1, 1.0), (2, least[0])], key=lambda f: -f[1])}


def test_pieces_and_levels(spark, monkeypatch):
    """Nodes cut into slices and blocks, and nodes too many to broadcast, give the same rows."""
    r = np.random.default_rng(5)
    x = r.normal(size=(1500, 8))
    df = table(spark, np.arange(1500), x)
    settings = hash_forest.Settings(trees=12, goal=0.8, axes=8)
    want = searched(df, k=5, every=15, settings=settings)
    for name, value in (("DATA_AT_ONCE", 100), ("QUERIES_AT_ONCE", 3), ("GROUP", 500), ("MOST_NODES", 2)):
        monkeypatch.setattr(hash_forest, name, value)
    assert searched(df, k=5, every=15, settings=settings) == want


def test_strings_are_prefixes():
    turned = [np.eye(3)]
    near = hash_forest.strings(np.array([[0.1, -3.0, 2.0], [0.2, -9.0, 1.0], [0.2, 9.0, 1.0]]), turned, 2)[:, 0]
    assert near[0] == near[1] == ((((1 << 6) << 7) | 2) << 7 | 5) and near[2] >> 7 == ((1 << 6) << 7) | 3
