"""Paired comparisons: alignment, McNemar, bootstrap, max-statistic permutation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from agentlake.functions.stats import mcnemar
from agentlake.operators.order import global_index


def aligned(base: DataFrame, final: DataFrame, key: str = "uid") -> DataFrame:
    """Both runs by key with flags for keys on one side only (J1, J2); both sides are hashed on the key once."""
    left = base.select(key, F.col("correct").alias("base"), F.lit(True).alias("_l"))
    right = final.select(key, F.col("correct").alias("final"), F.lit(True).alias("_r"))
    both = left.join(right, key, "full_outer")
    return both.select(key, "base", "final", F.coalesce("_l", F.lit(False)).alias("in_base"), F.coalesce("_r", F.lit(False)).alias("in_final"))


def paired_counts(pairs: DataFrame, *by: str) -> DataFrame:
    """n, gained, lost, delta and the exact McNemar p over all and by keys."""
    b, f = F.col("base") > 0, F.col("final") > 0
    out = pairs.groupBy(*by) if by else pairs.groupBy()
    out = out.agg(F.count(F.lit(1)).alias("n"), F.count_if(~b & f).alias("gained"), F.count_if(b & ~f).alias("lost"))
    return out.withColumn("delta", (F.col("gained") - F.col("lost")) / F.col("n")).withColumn("p", F.round(mcnemar(F.col("gained"), F.col("lost")), 9))


def transitions(pairs: DataFrame, before: str, after: str, order: str) -> DataFrame:
    """Counts of (before, after), the most common first, then the first seen (J2, T-8)."""
    return pairs.groupBy(before, after).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first")).orderBy(F.desc("n"), "first")


def compare(before: DataFrame, after: DataFrame, metric: str) -> DataFrame:
    """Means by question of both runs, delta and questions improved, regressed, unchanged."""
    mean = lambda df, name: df.groupBy("split", "uid").agg(F.avg(metric).alias(name))
    both = mean(before, "b").join(mean(after, "f"), ["split", "uid"])
    d = F.col("f") - F.col("b")
    return both.groupBy("split").agg(
        F.count(F.lit(1)).alias("questions"), F.avg("b").alias("baseline"), F.avg("f").alias("final"), F.avg(d).alias("delta"),
        F.count_if(d > 0).alias("improved"), F.count_if(d < 0).alias("regressed"), F.count_if(d == 0).alias("unchanged"),
    )


def compare_interval(before: DataFrame, after: DataFrame, metric: str, draws: int = 1000) -> DataFrame:
    """95 % bootstrap interval of the mean delta over questions of all splits (A14 with A17)."""
    mean = lambda df, name: df.groupBy("split", "uid").agg(F.avg(metric).alias(name))
    d = mean(before, "b").join(mean(after, "f"), ["split", "uid"]).select("split", "uid", (F.col("f") - F.col("b")).alias("d"))
    rows = global_index(d, ["split", "uid"], "i")
    return bootstrap(rows, rows.count(), draws)


def question_conflicts(a: DataFrame, b: DataFrame, key: str = "uid", question: str = "question") -> DataFrame:
    """Keys of both runs under which they ask different questions (F18); must be empty before runs are compared."""
    both = a.select(key, F.col(question).alias("_a")).join(b.select(key, F.col(question).alias("_b")), key)
    return both.filter(~F.col("_a").eqNullSafe(F.col("_b"))).select(key).distinct()


def hashed(*parts: Column) -> Column:
    """Leading 60 bits of md5 as a number that SQL elsewhere can compute as well."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 15), 16, 10).cast("long")


def bootstrap(pairs: DataFrame, n: int, draws: int = 1000, seed: str = "b", exact: bool = True) -> DataFrame:
    """95 % interval of the mean difference d over questions (i = 0 .. n - 1, d).

    Draw j of resample b is question hash(seed, b, j) mod n, so resamples agree between runs and machines (T8). Only the
    distinct values of d and their counts matter to a mean; the draws are generated in parallel and summed map-side.
    ``exact``: linear percentiles; else nearest rank sorted[int(q * draws)].
    """
    spark = pairs.sparkSession
    picks = spark.range(draws * n).select((F.col("id") / n).cast("long").alias("b"), F.pmod(hashed(F.lit(seed), F.col("id").cast("string")), F.lit(n)).alias("i"))
    means = picks.join(pairs.filter("d <> 0").select("i", "d"), "i", "left").groupBy("b").agg((F.sum(F.coalesce("d", F.lit(0))) / n).alias("m"))
    if exact:
        return means.agg(F.percentile("m", F.lit(0.025)).alias("low"), F.percentile("m", F.lit(0.975)).alias("high"))
    at = lambda q: F.element_at(F.sort_array(F.collect_list("m")), F.lit(min(draws, int(q * draws) + 1)))
    return means.agg(at(0.025).alias("low"), at(0.975).alias("high"))  # ``draws`` numbers


def max_stat_p(deltas: DataFrame, permutations: int = 1000, seed: str = "p") -> DataFrame:
    """Selection-adjusted p over checkpoints (A18): joint sign flips of each question's differences, the largest absolute
    sum compared with the observed one; (hits + 1) / (permutations + 1). Input: uid, checkpoint, d.

    All-zero rows can't change a sum and go first. The permutation numbers are a generated range.
    """
    kept = deltas.filter("d <> 0")
    observed = kept.groupBy("checkpoint").agg(F.sum("d").alias("s")).agg(F.max(F.abs("s")).alias("observed"))  # a row
    numbers = F.explode(F.sequence(F.lit(0), F.lit(permutations - 1))).alias("k")
    sign = F.when(F.pmod(hashed(F.lit(seed), F.col("uid").cast("string"), F.col("k").cast("string")), F.lit(2)) == 0, 1).otherwise(-1)
    sums = kept.select("uid", "checkpoint", "d", numbers).groupBy("k", "checkpoint").agg(F.sum(sign * F.col("d")).alias("s"))
    tops = sums.groupBy("k").agg(F.max(F.abs("s")).alias("top")).join(F.broadcast(observed))
    return tops.agg(((F.count_if(F.col("top") >= F.col("observed")) + 1) / F.lit(permutations + 1.0)).alias("p"))


def best_checkpoint(counts: DataFrame) -> DataFrame:
    """The checkpoint of most gained - lost, the first on ties."""
    return counts.agg(F.max_by("checkpoint", F.struct(F.col("gained") - F.col("lost"), -F.col("checkpoint"))).alias("checkpoint"))


def last_answers(turns: DataFrame, key: str, answer: Column) -> DataFrame:
    """The answer of the latest turn that has one."""
    return turns.withColumn("_a", answer).filter("_a is not null").groupBy(key).agg(F.max_by("_a", "turn").alias("answer"), F.max("turn").alias("turn"))


def first_per_key(df: DataFrame, keys: list[str], order: list[str], limit: int) -> DataFrame:
    """One row for each key, then the first few."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n").orderBy(*order).limit(limit)
