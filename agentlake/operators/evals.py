"""Evaluation: validity verdicts, group variance, pass@k, summaries, integrity, gates, rollups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agentlake.functions.stats import pass_at_k, ratio, wilson

# What a result's status may be besides 'scored'.
INFRA = ("model_error", "tool_error", "judge_error", "timeout", "other_error")


def verdict(results: DataFrame, expected: int | None = None) -> DataFrame:
    """n, n_scored, a count for each infrastructure kind, valid and reasons (A8). ``results`` has status."""
    out = results.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "scored").alias("n_scored"), *(F.count_if(F.col("status") == k).alias(k) for k in INFRA))
    bad = sum((F.col(k) for k in INFRA), F.lit(0))
    reasons = F.array_compact(F.array(
        F.when(F.col("n") == 0, "no results"),
        F.when(bad > 0, "infrastructure errors"),
        F.when(F.lit(expected).isNotNull() & (F.col("n") != F.lit(expected or 0)), "unexpected number of results"),
    ))
    return out.withColumn("reasons", reasons).withColumn("valid", F.size("reasons") == 0)


def group_spread(results: DataFrame, group: str = "group", reward: str = "reward") -> DataFrame:
    """Each group's n, min, max, population std and whether it holds an infrastructure error; two numbers a row cross the shuffle."""
    infra = F.bool_or(F.col("status") != "scored")
    return results.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.min(reward).alias("low"), F.max(reward).alias("high"), F.stddev_pop(reward).alias("std"), infra.alias("infra"))


def group_variance(spread: DataFrame) -> DataFrame:
    """Shares of groups that are all equal, all wrong (max 0), all right (min = the greatest reward, > 0) and mixed (A9),
    without groups that hold infrastructure errors; Wilson interval of mixed; mean of the population std."""
    clean = spread.filter(~F.col("infra"))
    top = clean.agg(F.max("high").alias("top"))  # a row
    counted = clean.join(F.broadcast(top))
    equal = F.col("low") == F.col("high")
    out = counted.agg(
        F.count(F.lit(1)).alias("groups"), F.count_if(equal).alias("all_equal"), F.count_if(equal & (F.col("high") == 0)).alias("all_wrong"),
        F.count_if(equal & (F.col("low") == F.col("top")) & (F.col("top") > 0)).alias("all_right"), F.count_if(~equal).alias("mixed"), F.avg("std").alias("mean_std"),
    )
    ci = wilson(F.col("mixed"), F.col("groups"))
    shares = [ratio(F.col(c), F.col("groups")).alias(f"{c}_share") for c in ("all_equal", "all_wrong", "all_right", "mixed")]
    return out.select("groups", *shares, ci["low"].alias("mixed_low"), ci["high"].alias("mixed_high"), "mean_std")


def baseline_gate(rates: DataFrame, rate: str = "rate", saturated: float = 0.5, effective: float = 0.40, marginal: float = 0.20) -> DataFrame:
    """Groups that teach something, are saturated or floored, and what to do about it."""
    r = F.col(rate)
    out = rates.agg(F.count(F.lit(1)).alias("groups"), F.count_if((r > 0) & (r < 1)).alias("effective"), F.count_if(r > saturated).alias("saturated"), F.count_if(r == 0).alias("floored"))
    share = ratio(F.col("effective"), F.col("groups"))
    return out.withColumn("share", share).withColumn("verdict", F.when(share >= effective, "proceed").when(share >= marginal, "marginal").otherwise("stop"))


def complete_groups(results: DataFrame, samples: int, group: str = "uid") -> DataFrame:
    """n, c (rewards > 0) of groups with exactly ``samples`` results, all scored."""
    out = results.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("reward") > 0).alias("c"), F.bool_and(F.col("status") == "scored").alias("scored"))
    return out.filter((F.col("n") == samples) & F.col("scored"))


def summary(results: DataFrame, samples: int, group: str = "uid") -> DataFrame:
    """Questions, fully scored, successes, pass@1, pass@3 (null under 3 samples), mixed, zero and all groups."""
    full = complete_groups(results, samples, group)
    at3 = F.avg(pass_at_k(F.col("n"), F.col("c"), 3)) if samples >= 3 else F.lit(None).cast("double")
    right = full.agg(
        F.count(F.lit(1)).alias("fully_scored"), F.coalesce(F.sum("c"), F.lit(0)).alias("successes"), F.avg(pass_at_k(F.col("n"), F.col("c"), 1)).alias("pass_1"), at3.alias("pass_3"),
        F.count_if((F.col("c") > 0) & (F.col("c") < F.col("n"))).alias("mixed"), F.count_if(F.col("c") == 0).alias("zero"), F.count_if(F.col("c") == F.col("n")).alias("all"),
    )
    return results.agg(F.count_distinct(group).alias("questions")).join(right)  # a row each


def mixed_uids(results: DataFrame, samples: int, allowed: DataFrame | None = None) -> DataFrame:
    """uids whose complete, scored groups hold both 0 and 1 (F15); other rewards fail, as do uids that aren't allowed."""
    out = results.groupBy("uid").agg(F.min("reward").alias("low"), F.max("reward").alias("high"), F.count(F.lit(1)).alias("n"), F.bool_and((F.col("status") == "scored") & F.col("reward").isin(0.0, 1.0)).alias("clean"))
    sound = F.when((F.col("n") == samples) & F.col("clean"), F.col("low") < F.col("high")).otherwise(F.raise_error(F.lit("incomplete, unscored or non-binary group")).cast("boolean"))
    kept = out.filter(sound).select("uid")
    return kept if allowed is None else kept.join(allowed.select("uid"), "uid", "left_semi")


def integrity_problems(results: DataFrame, questions: DataFrame) -> DataFrame:
    """(id, problem) rows (F17): repeated, missing and unexpected ids; scored without a score; a score though not scored."""
    counts = results.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.bool_or((F.col("status") == "scored") & F.col("score").isNull()).alias("bare"), F.bool_or((F.col("status") != "scored") & F.col("score").isNotNull()).alias("extra"))
    both = counts.join(questions.select("id").distinct().withColumn("asked", F.lit(True)), "id", "full_outer")
    found = F.array_compact(F.array(
        F.when(F.col("n") > 1, "repeated"), F.when(F.col("n").isNull(), "missing"), F.when(F.col("asked").isNull(), "unexpected"),
        F.when(F.col("bare"), "scored without a score"), F.when(F.col("extra"), "a score though not scored"),
    ))
    return both.select("id", F.explode(found).alias("problem"))


def answer_rollup(results: DataFrame, *keys: str) -> DataFrame:
    """Accuracy over all and by each key in one pass (A4 - A6): n, correct, answered, accuracy, accuracy among the answered.

    Input: correct and answered (0/1). The aggregate is a grouping set: (), (key1), (key2), ...
    """
    sets = [[], *([F.col(k)] for k in keys)]
    out = results.groupingSets(sets, *map(F.col, keys)).agg(
        F.grouping_id().alias("grain"), F.count(F.lit(1)).alias("n"), F.sum("correct").cast("long").alias("correct"), F.sum("answered").cast("long").alias("answered")
    )
    return out.withColumn("accuracy", ratio(F.col("correct"), F.col("n"))).withColumn("among_answered", ratio(F.col("correct"), F.col("answered")))


def map_totals(df: DataFrame, column: str) -> DataFrame:
    """Sums of a map column by its keys."""
    return df.select(F.explode(column).alias("key", "value")).groupBy("key").agg(F.sum("value").alias("total"))


def latency(df: DataFrame, value: str, *by: str) -> DataFrame:
    """n, median and nearest-rank p95 = sorted[min(n - 1, int(0.95 n))].

    The rank is found among counts of distinct values, so equal values combine map-side; positions come from a global
    order that is dealt by range, so a large group is many tasks.
    """
    from agentlake.operators.order import with_prefix

    counts = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("c"))
    placed = with_prefix(counts, [*by, value], "c", "latencies")
    groups = placed.groupBy(*by).agg(F.min("prefix").alias("first"), F.sum("c").alias("n")) if by else placed.agg(F.min("prefix").alias("first"), F.sum("c").alias("n"))
    joined = placed.join(groups, list(by)) if by else placed.join(F.broadcast(groups))  # a row
    ordered = joined.withColumn("upto", F.col("prefix") - F.col("first") + F.col("c"))
    at = lambda k: F.min(F.when(F.col("upto") > k, F.col(value)))
    p95 = at(F.least(F.col("n") - 1, F.floor(0.95 * F.col("n"))))
    low, high = at(F.floor((F.col("n") - 1) / 2)), at(F.floor(F.col("n") / 2))
    return ordered.groupBy(*by).agg(F.max("n").alias("n"), ((low + high) / 2).alias("median"), p95.alias("p95"))


def training_rollup(rows: DataFrame) -> DataFrame:
    """Trajectories and successes by category and by version, and over all, in one pass."""
    out = rows.groupingSets([[], [F.col("category")], [F.col("version")]], F.col("category"), F.col("version"))
    return out.agg(F.grouping_id().alias("grain"), F.count(F.lit(1)).alias("trajectories"), F.count_if(F.col("reward") > 0).alias("successes"), F.count_distinct("uid").alias("questions"))


def blended(rule: str = "rule", judge: str = "judge", alpha: float = 0.5, fallback: str = "rule"):
    """alpha * judge + (1 - alpha) * rule; without a judge score the rule, or 0 (N20); with whether they agree."""
    r, j = F.col(rule), F.col(judge)
    score = F.when(j.isNotNull(), alpha * j + (1 - alpha) * r).otherwise(r if fallback == "rule" else F.lit(0.0))
    agree = F.when(j.isNotNull(), ((j >= 0.5) == (r >= 0.5)).cast("double")).otherwise(0.0)
    return F.struct(score.alias("score"), agree.alias("agreement"), j.isNotNull().cast("double").alias("judge_valid"))


def first_resolved(attempts: DataFrame) -> DataFrame:
    """Of each request's attempts the first resolved, else the last, and how many were used (Q9, M9)."""
    order = F.struct(F.when(F.col("status") == "ok", 0).otherwise(1).alias("open"), F.when(F.col("status") == "ok", F.col("attempt")).otherwise(-F.col("attempt")).alias("at"))
    rest = F.struct(*[c for c in attempts.columns if c != "request"])
    return attempts.groupBy("request").agg(F.min_by(rest, order).alias("x")).select("request", "x.*")


def calibration(cases: DataFrame, need: float) -> DataFrame:
    """Whether enough labelled cases came out right."""
    return cases.agg(F.count(F.lit(1)).alias("n"), F.count_if("ok").alias("passed")).withColumn("calibrated", F.col("passed") >= need * F.col("n"))


def heldout_package(results: DataFrame) -> DataFrame:
    """Questions and right answers for each policy and checkpoint, over all and by hops (A24): rows policy, checkpoint, hop_type, correct."""
    rows = results.withColumn("hops", F.substring("hop_type", 1, 4))
    sets = [[F.col("policy"), F.col("checkpoint")], [F.col("policy"), F.col("checkpoint"), F.col("hops")]]
    return rows.groupingSets(sets, "policy", "checkpoint", "hops").agg(F.grouping("hops").cast("int").alias("all_hops"), F.count(F.lit(1)).alias("n"), F.sum("correct").cast("long").alias("correct"))


def gpu_hours(jobs: DataFrame) -> DataFrame:
    """Upper bound of GPU hours over jobs (gpus, minutes, retries)."""
    return jobs.agg(F.sum(F.col("gpus") * F.col("minutes") / 60 * (1 + F.col("retries"))).alias("gpu_hours"))


def judged_ratio(rows: DataFrame) -> DataFrame:
    """mean(judge_score) / mean(judge_valid) and the same of agreement (A27); null without a valid verdict."""
    over = lambda c: F.try_divide(F.avg(c), F.avg("judge_valid")).alias(c)
    return rows.agg(over("judge_score"), over("agreement"))


def scored_means(results: DataFrame, *by: str) -> DataFrame:
    """Over scored rows: means of em, cover and f1, answered or not, those that used tools, mean tool calls, and sums of
    errors (A4). Input: status, em, cover, f1, has_answer (0/1), n_tools, errors."""
    scored = results.filter(F.col("status") == "scored")
    return scored.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), *(F.avg(c).alias(c) for c in ("em", "cover", "f1")), F.count_if(F.col("has_answer") > 0).alias("answered"), F.count_if(F.col("has_answer") == 0).alias("no_answer"),
        F.count_if(F.col("n_tools") > 0).alias("used_tool"), F.avg("n_tools").alias("mean_tools"), F.sum("errors").cast("long").alias("errors"),
    )


def delivery(results: DataFrame, *by: str) -> DataFrame:
    """Submission rate, accuracy of answers that were submitted, and mean of what was delivered (the rest of A13). Input:
    submitted, correct (0/1), delivered."""
    out = results.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum("submitted").cast("long").alias("submitted"), F.sum(F.col("submitted") * F.col("correct")).cast("long").alias("right"), F.avg("delivered").alias("mean_delivered"))
    return out.select(*by, "n", ratio(F.col("submitted"), F.col("n")).alias("submission_rate"), ratio(F.col("right"), F.col("submitted")).alias("answer_accuracy"), "mean_delivered")
