"""Statistics as Column expressions over counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Z95 = 1.959963984540054


def wilson(successes: Column, n: Column, z: float = Z95) -> Column:
    """Wilson interval of a share as {low, high}; (0, 1) for n = 0 (A10)."""
    n = n.cast("double")
    p = successes / F.nullif(n, F.lit(0.0))
    scale = 1 + z * z / n
    centre = (p + z * z / (2 * n)) / scale
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / scale
    none = n == 0
    return F.struct(
        F.when(none, 0.0).otherwise(F.greatest(F.lit(0.0), centre - half)).alias("low"),
        F.when(none, 1.0).otherwise(F.least(F.lit(1.0), centre + half)).alias("high"),
    )


def pass_at_k(n: Column, c: Column, k: int) -> Column:
    """Unbiased 1 - C(n-c, k) / C(n, k); 1 if fewer than k fail; an error outside 0 <= c <= n, 1 <= k <= n."""
    bad = (c < 0) | (c > n) | (n < k) | F.lit(k < 1)
    miss = F.aggregate(F.sequence(F.lit(0), F.lit(k - 1)), F.lit(1.0), lambda acc, i: acc * (n - c - i) / (n - i).cast("double"))
    return F.when(bad, F.raise_error(F.lit("pass@k needs 0 <= c <= n and 1 <= k <= n")).cast("double")).when(n - c < k, 1.0).otherwise(1 - miss)


def mcnemar(gained: Column, lost: Column) -> Column:
    """Exact two-sided McNemar p from discordant counts (A16): min(1, 2 * sum C(n, i) / 2^n up to the smaller count).

    Terms grow from 2^-n by products, in logarithms, so that n may be large.
    """
    n, m = (gained + lost).cast("double"), F.least(gained, lost)
    start = F.struct((-n * F.log(F.lit(2.0))).alias("log"), F.lit(0.0).alias("sum"))
    step = lambda acc, i: F.struct((acc["log"] + F.when(i > 0, F.log((n - i + 1) / F.greatest(i, F.lit(1)))).otherwise(0.0)).alias("log"), acc["sum"].alias("sum"))

    def add(acc: Column, i: Column) -> Column:
        moved = step(acc, i)
        return F.struct(moved["log"].alias("log"), (moved["sum"] + F.exp(moved["log"])).alias("sum"))

    total = F.aggregate(F.sequence(F.lit(0).cast("long"), m.cast("long")), start, add)["sum"]
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * total))


def ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
