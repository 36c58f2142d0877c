"""Periodic runs against brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from agentlake.llm import queries, runs

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(words):
    """All (start, length, period), by walking equal positions of every period."""
    found = {}
    for p in range(1, len(words) // 4 + 1):
        a = 0
        while a < len(words) - p:
            b = a
            while b < len(words) - p and words[b] == words[b + p]:
                b += 1
            if b - a + p >= max(6, 4 * p):
                found.setdefault((a, b - a + p), p)  # smaller periods come first
            a = b + 1
    return sorted((s, n, p) for (s, n), p in found.items())


def collapsed(words, found):
    gone = {i for s, n, p in found for i in range(s + p, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def texts(seed=2):
    r = random.Random(seed)
    out = [None, "", " \t\n ", "a", "a a a a a", "a a a a a a", "a b " * 4, "a b a b a b a", "x " * 500 + "y", "Ab aB " * 5, "a b " * 7, "\x1cz " * 6, "\x85 " * 8]
    for _ in range(120):
        w = []
        while len(w) < r.choice([5, 30, 200]):
            w += r.choices("abcd"[: r.randint(1, 4)], k=r.randint(1, 6)) * r.randint(1, 9)
        out.append(r.choice([" ", "\n", " \r\n"]).join(w) + r.choice(["", " "]))
    thue = [0]
    while len(thue) < 512:
        thue += [1 - x for x in thue]
    out += [" ".join(map(str, thue)), " ".join(map(str, thue)) * 5, " ".join(f"w{r.randint(0, 9**9)}" for _ in range(3000)) + " v w" * 40_000]
    return out


def test_against_brute_force(spark):
    rows = [(i, t, "clash", 1, 2) for i, t in enumerate(texts())] + [(None, "q " * 9, "", 1, 2), (3, "q " * 9, "", 1, 2), (3, "q " * 9, "", 1, 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, runs string, start int, n_words int").repartition(3)
    got = sorted((str(g["doc_id"]), [tuple(r) for r in g["runs"]], g["n_words"], g["collapsed"]) for g in runs.word_runs(df).collect())
    want = []
    for i, t, *_ in rows:
        w = WORD.findall(t or "")
        found = brute(w) if len(w) < 10_000 else [(3000, 80_000, 2)]
        want.append((str(i), found, len(w), collapsed(w, found)))
    assert got == sorted(want)
    assert runs.word_runs(df.limit(0)).count() == 0


def test_blocks_and_pairs_of_any_size(monkeypatch):
    r = np.random.default_rng(1)
    size = np.array([0, 3, 900, 40, 0, 500])
    codes = r.integers(0, 2, size.sum())
    want = runs.find_runs(codes, size)
    monkeypatch.setattr(runs, "PAIRS_AT_ONCE", 7)
    assert (runs.find_runs(codes, size) == want).all() and len(want) > 20


def test_wrong_hashes_are_noticed(monkeypatch):
    """Hashes of a seed that call everything equal: verification sends the block to the next seed."""
    r = np.random.default_rng(4)
    codes, size = r.integers(0, 2, 400), np.array([400])
    want, right, seeds = runs.find_runs(codes, size), runs.PrefixHashes, []

    class Wrong(right):
        def __init__(self, codes, seed):
            super().__init__(codes, seed)
            seeds.append(seed)

        def same(self, at, period, n):
            return np.ones(len(at), dtype=bool) if seeds[-1] == 0 else super().same(at, period, n)

    monkeypatch.setattr(runs, "PrefixHashes", Wrong)
    assert (runs.find_runs(codes, size) == want).all() and seeds == [0, 1]


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001"])
def test_query(spark, folder):
    got = {g["doc_id"]: g for g in queries.op11_periodic_runs(spark, folder).collect()}
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    for doc_id, text in docs:
        w = WORD.findall(text or "")
        h = zlib.crc32(str(doc_id).encode())
        g, n = h // 10, len(w)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        found, x = brute(w), got[doc_id]
        best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
        assert (x["start"], x["length"], x["period"]) == (best or (None,) * 3) and x["n_runs"] == len(found)
        assert x["exponent_milli"] == (best and 1000 * best[1] // best[2])
        assert x["runs_sha256"] == hashlib.sha256("".join(f"{s},{m},{p}\n" for s, m, p in found).encode()).hexdigest()
        assert x["collapsed_sha256"] == hashlib.sha256(collapsed(w, found).encode()).hexdigest()
    assert sum(g["n_runs"] > 0 for g in got.values()) > 5


def test_query_on_odd_rows(spark, tmp_path):
    rows = [(None, "a b c d e f"), (7, None), (8, ""), (9, "z " * 9), (-5, "u v w x y z"), (9, "z " * 9)]
    spark.createDataFrame(rows, "doc_id long, text string").withColumn("best", F.lit(1)).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op11_periodic_runs(spark, str(tmp_path)).collect()
    empty = hashlib.sha256(b"").hexdigest()
    assert len(got) == 6 and {g["n_runs"] for g in got if g["doc_id"] == 9} == {1}
    assert all(g["start"] is None and g["exponent_milli"] is None and g["runs_sha256"] == g["collapsed_sha256"] == empty for g in got if g["doc_id"] in (7, 8))
