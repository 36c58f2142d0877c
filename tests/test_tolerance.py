"""Tolerance joins against all pairs."""

import math
import random

from agentlake.operators import episodes, tolerance


def agrees(v, d, scales):
    return any(d == v * s or (v * s != 0 and math.isfinite(v * s) and abs(d - v * s) <= abs(v * s) * 1e-6) for s in scales)


def test_near_pairs(spark):
    r = random.Random(5)
    numbers = [(g, x) for g in "ab" for x in (0.0, 1.0, -1.0, 1000.0, float("inf"), 1e308, 1e-300, 2.0**53)]
    numbers += [(r.choice("ab"), r.uniform(-5, 5) * 10 ** r.randint(-12, 12)) for _ in range(300)]
    claims = [(g, x * s * (1 + e)) for g, x in numbers for s in (1, 1e3, 1e-6) for e in (0, 0.99e-6, -0.99e-6, 1.02e-6, -1.02e-6, 3e-6) if r.random() < 0.3]
    claims += [("a", 0.0), ("b", -0.0), ("a", None), ("a", math.nan), ("c", 1.0), ("a", 1e300)]
    claims = [("hot", 1.0)] * 2000 + claims
    left, right = spark.createDataFrame(claims, "g string, value double").repartition(3), spark.createDataFrame([*numbers, ("hot", 1.0), ("hot", 1.0000009), ("a", None)], "g string, number double")
    pairs = tolerance.near_pairs(left, right, by=["g"], scales=episodes.SCALES)
    got = {(p["g"], p["value"], p["number"]) for p in pairs.collect()}
    sound = {(g, v) for g, v in claims if v is not None and v == v}
    want = {(g, v, d) for g, v in sound for h, d in [*numbers, ("hot", 1.0), ("hot", 1.0000009)] if g == h and agrees(v, d, episodes.SCALES)}
    assert got == want and len(want) > 300 and pairs.count() == len(got)
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert tolerance.near_pairs(left.limit(0), right, by=["g"]).count() == 0
