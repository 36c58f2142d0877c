"""Joins of numbers that are equal within a relative tolerance, under several scales, as equality joins of bins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RELATIVE = 1e-6
#: Bins of zero and of infinity, which no other number has.
ZERO, ENDLESS = -(2**62), 2**62


def near(number: Column, target: Column, relative: float = RELATIVE) -> Column:
    """Whether a number is within ``relative`` of a target; zero and infinity only equal themselves."""
    return (number == target) | ((target != 0) & (F.abs(target) != float("inf")) & (F.abs(number - target) <= F.abs(target) * relative))


def _bins(x: Column, relative: float, slack: float) -> Column:
    """The logarithmic bins, twice the tolerance wide, in which numbers within ``slack`` tolerances of |x| lie; odd ones for negative numbers."""
    at = lambda k: F.floor((F.ln(F.abs(x)) + k * relative) / (2 * relative)).cast("long")
    odd = F.when(x < 0, 1).otherwise(0)
    finite = F.when((x != 0) & (F.abs(x) != float("inf")), F.transform(F.sequence(at(-slack), at(slack)), lambda b: b * 2 + odd))
    return F.coalesce(finite, F.array(F.when(x == 0, F.lit(ZERO)).otherwise(F.lit(ENDLESS) + odd).cast("long")))


def near_pairs(claims: DataFrame, numbers: DataFrame, by: Sequence[str] = (), scales: Sequence[float] = (1.0,), relative: float = RELATIVE) -> DataFrame:
    """Distinct (by, value, number) of values of ``claims`` (by, value) that, times some scale, are near a number of
    ``numbers`` (by, number); ``by`` columns must be equal (J8, J10, N13).

    Repeated values and numbers collapse before the join, so a frequent one is one row. A number has one bin; a value has
    the one or two bins for each scale that hold all that is near, so the join is by equality and nothing is paired that
    isn't nearly equal. Nulls and NaN match nothing.
    """
    known = lambda df, c: df.select(*by, F.col(c).cast("double").alias(c)).filter(F.col(c).isNotNull() & ~F.isnan(c)).distinct()
    targets = known(claims, "value").select(*by, "value", F.explode(F.array(*(F.col("value") * float(s) for s in scales))).alias("target"))
    targets = targets.select(*by, "value", "target", F.explode(_bins(F.col("target"), relative, 1.1)).alias("bin"))
    found = known(numbers, "number").withColumn("bin", _bins(F.col("number"), relative, 0.0)[0])
    return targets.join(found, [*by, "bin"]).filter(near(F.col("number"), F.col("target"), relative)).select(*by, "value", "number").distinct()
