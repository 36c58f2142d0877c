"""Kept indexes: the same results as without them, when built at once or in loads; approximate search finds its share."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from agentlake.operators import inverted_index, retrieval, vector_index


def texts(seed=3, n=600):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    weights = [1 / (i + 1) for i in range(300)]
    out = [(i, " ".join(r.choices(vocabulary, weights, k=r.choice([1, 5, 40, 200])))) for i in range(n)]
    return out + [(n, None), (n + 1, ""), (n + 2, "!!! ..."), (n + 3, "w1 " * 5000), (n + 4, out[5][1]), (n + 5, out[5][1])]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(texts(), "doc_id long, text string").repartition(3)


@pytest.fixture(scope="module")
def asked(spark):
    r = random.Random(9)
    rows = [(i, " ".join(f"w{min(299, int(r.paretovariate(0.7)))}" for _ in range(r.randint(1, 12)))) for i in range(60)]
    return spark.createDataFrame([*rows, (100, None), (101, ""), (102, "unknown words"), (103, rows[0][1])], "query_id long, query string")


def plain(df):
    return sorted((r["query_id"], r["rank"], r["doc_id"], round(r["score"], 8)) for r in df.collect())


@pytest.fixture(scope="module")
def want(docs, asked):
    return plain(retrieval.bm25(docs, asked, 10))


@pytest.mark.parametrize("words,block,pushed", [(2_000_000, 128, 1000), (2500, 8, 1000), (900, 3, 5)])
def test_inverted_index(spark, docs, asked, want, tmp_path, monkeypatch, words, block, pushed):
    """One segment or many, one block or many, tokens pushed down or joined."""
    monkeypatch.setattr(inverted_index, "PUSHED", pushed)
    index = inverted_index.append(spark, f"{tmp_path}/index", docs, words, block)
    assert plain(inverted_index.search(index, asked, 10)) == want
    assert (index.segments().count() > 10) == (words < 5000)


def test_loads_equal_one(spark, docs, asked, want, tmp_path):
    for part in (docs.filter("doc_id < 100"), docs.filter("doc_id between 100 and 400"), docs.filter("doc_id > 400")):
        index = inverted_index.append(spark, f"{tmp_path}/index", part)
    assert plain(inverted_index.search(index, asked, 10)) == want
    assert index.segments().agg(F.sum("documents")).first()[0] == docs.count()


def test_scoring_stops_early():
    """Documents of one block outweigh all others by far: the rest isn't scored, and the result is the same."""
    n = 6400
    docs, tf, length = np.arange(n), np.where(np.arange(n) < 128, 50, 1), np.full(n, 60)
    weight = tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / 60))
    scored = []

    class Seen(np.ndarray):
        def __getitem__(self, at):
            if isinstance(at, np.ndarray):
                scored.append(at.size)
            return super().__getitem__(at)

    part = (2.0, docs, weight.view(Seen), np.arange(50), np.arange(51) * 128, np.maximum.reduceat(weight, np.arange(50) * 128))
    ids, scores = inverted_index._early([part], 10)
    assert ids.tolist() == list(range(10)) and (scores == round(2 * weight[0], 9)).all() and sum(scored) <= 4 * 128


def test_cache_asks_only_what_is_new(spark, docs, asked, want, tmp_path):
    index = inverted_index.append(spark, f"{tmp_path}/index", docs)
    calls = []

    def run(queries, k):
        calls.append(sorted(r["query"] for r in queries.collect()))
        return inverted_index.search(index, queries, k)

    ask = lambda q, k=10, version="a": inverted_index.cached(spark, f"{tmp_path}/kept", q, k, "bm25", version, run)
    first = asked.filter("query_id < 30")
    assert plain(ask(first)) == [w for w in want if w[0] < 30] and len(calls) == 1
    assert plain(ask(asked)) == want and len(calls) == 2 and not {*calls[0]} & {*calls[1]} and "unknown words" in calls[1]
    assert plain(ask(asked)) == want and len(calls) == 2  # what found nothing is kept too
    ask(asked, version="b")
    ask(asked, k=3)
    assert len(calls) == 4 and len(calls[3]) == len(calls[2]) == asked.select("query").na.drop().distinct().count()
    version = index.version()
    inverted_index.append(spark, f"{tmp_path}/index", spark.createDataFrame([(9999, "w1")], "doc_id long, text string"))
    assert index.version() != version


# --- vectors ---


def vectors(spark, n=4000, dims=24, seed=1):
    r = np.random.default_rng(seed)
    x = r.normal(size=(40, dims))[r.integers(0, 40, n)] + 0.6 * r.normal(size=(n, dims))
    x[100:600] = x[100] + 0.01 * r.normal(size=(500, dims))  # a dense place
    rows = [(i, [float(v) for v in x[i]]) for i in range(n)] + [(n, None), (n + 20, [0.0] * dims), (n + 40, [float("nan")] * dims), (None, [1.0] * dims)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)


def test_vector_index(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(vector_index, "VECTORS_AT_ONCE", 900)
    monkeypatch.setattr(vector_index, "QUERIES_AT_ONCE", 7)
    data = vectors(spark)
    asked = data.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    sound = data.filter("vec_id < 4000")
    want = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in retrieval.vector_top(sound, asked.filter("query_id < 4000"), 5).collect()}
    index = vector_index.build(data.filter("vec_id < 3000 or vec_id is null or vec_id >= 4000"), f"{tmp_path}/cells")
    vector_index.append(index, data.filter("vec_id between 3000 and 3999"))
    assert index.vectors().count() == 4000
    cells = len(index.centres())
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in vector_index.search(index, asked, 5, cells).collect()}
    assert got == want  # all cells: exact
    probes = vector_index.probes_for(index, asked, 5)
    found = vector_index.search(index, asked, 5, probes)
    pairs = {(r["query_id"], r["vec_id"]) for r in found.collect()}
    share = len(pairs & {(q, v) for (q, _), (v, _) in want.items()}) / len(want)
    assert 0.9 <= share and probes < cells / 4
    assert "CartesianProduct" not in found._jdf.queryExecution().toString() and "NestedLoop" not in found._jdf.queryExecution().toString()


def test_vector_query_finds_its_share(spark):
    from agentlake.plans.queries import QUERIES

    folder = "/root/testdata/sf0.01"
    import agentlake.plans.index_queries  # noqa: F401 - adds its own

    want, got = ({(r["query_id"], r["vec_id"]) for r in QUERIES[name](spark, folder).collect()} for name in ("vector_topk", "vector_ann"))
    assert len(want & got) / len(want) >= 0.9 and len(got) == len(want)


def test_empty_vector_index(spark, tmp_path):
    with pytest.raises(ValueError):
        vector_index.build(spark.createDataFrame([], "vec_id long, embedding array<double>"), f"{tmp_path}/none")
