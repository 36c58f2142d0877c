"""Episodes: observation ledgers, reference and value checks, rewards, evidence packing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from agentlake.functions import text as tx
from agentlake.functions.structured import report
from agentlake.operators.tolerance import near, near_pairs

OBSERVATION = "observation_id string, `order` int, tool string, args map<string,string>, outcome string, generated_by_request int, delivered_to_request int, delivered_text string"
COMPUTE_TOOLS = ("run_code", "calculator", "compute")
# Fixed value: what counts as a number in a claim.
NUMBER = r"\$?\d{1,3}(?:,\d{3})+(?:\.\d+)?|\$?\d+\.\d+|\$?\d+"
SCALES = (1.0, 1e3, 1e-3, 1e6, 1e-6, 1e9, 1e-9)


def parsed(episodes: DataFrame) -> DataFrame:
    """Episodes with their parsed report (Q3, Q4); a text that was never submitted is empty."""
    return episodes.withColumn("report", report(F.when(F.col("terminal_seen"), F.col("terminal_text")).otherwise("")))


def ledger(episodes: DataFrame) -> DataFrame:
    """episode_id with one row for each observation (Q12); repeated ids in an episode fail."""
    at = episodes.select("episode_id", F.explode("observations").alias("o")).select("episode_id", "o.*")
    n = F.count(F.lit(1)).over(Window.partitionBy("episode_id", "observation_id"))
    once = F.when(n > 1, F.raise_error(F.lit("repeated observation id")).cast("boolean")).otherwise(True)
    at = at.withColumn("_once", once).filter("_once").drop("_once")
    return at.withColumn("compute", F.col("tool").isin(*COMPUTE_TOOLS)).withColumn("delivered", F.col("delivered_text").isNotNull() & F.col("delivered_to_request").isNotNull())


def steps(reports: DataFrame) -> DataFrame:
    """episode_id, pos and fields of the steps of valid reports."""
    at = reports.filter(F.col("report.kind") == "valid").select("episode_id", F.posexplode("report.steps").alias("pos", "s"))
    return at.select("episode_id", "pos", "s.*")


def reference_issues(reports: DataFrame, observations: DataFrame) -> DataFrame:
    """(episode_id, step, code) (Q5, J6, J7): nonexistent, cross_episode, undelivered, impossible_chronology."""
    step = steps(reports)
    mine = observations.select("episode_id", F.col("observation_id").alias("observation"), "delivered", "compute", "generated_by_request", "delivered_to_request")
    at = step.join(mine, ["episode_id", "observation"], "left").withColumn("known", F.col("delivered").isNotNull())
    foreign = observations.groupBy(F.col("observation_id").alias("observation")).agg(F.lit(True).alias("elsewhere"))
    at = at.join(foreign, "observation", "left")
    direct = F.when(~F.col("known") & F.coalesce("elsewhere", F.lit(False)), "cross_episode").when(~F.col("known"), "nonexistent").when(~F.col("delivered"), "undelivered")
    first = at.withColumn("code", direct).filter("code is not null").select("episode_id", F.col("id").alias("step"), "code")
    needs = at.filter("known and delivered and compute").select("episode_id", "id", "generated_by_request", F.explode("depends_on").alias("need"))
    source = at.select("episode_id", F.col("id").alias("need"), F.col("delivered_to_request").alias("seen"))
    late = needs.join(source, ["episode_id", "need"], "left").filter("seen is null or seen > generated_by_request")
    return first.unionByName(late.select("episode_id", F.col("id").alias("step"), F.lit("impossible_chronology").alias("code")))


def numbers(c: Column) -> Column:
    return F.transform(F.regexp_extract_all(c, F.lit(NUMBER), F.lit(0)), lambda t: F.translate(t, "$,", "").cast("double"))


def claimed_numbers(c: Column) -> Column:
    """Numbers worth checking (N12): three integer digits or more, or a separator, decimals or currency; not a bare year."""
    found = F.regexp_extract_all(c, F.lit(NUMBER), F.lit(0))
    year = lambda t: t.rlike(r"^\d{4}$") & t.cast("string").between("1900", "2099")
    like = lambda t: ~year(t) & (t.rlike(r"[,.$]") | t.rlike(r"^\d{3,}"))
    return F.transform(F.filter(found, like), lambda t: F.translate(t, "$,", "").cast("double"))


def present(value: Column, delivered: Column) -> Column:
    """Whether a number is among others under some scale, within 1e-6."""
    return F.exists(F.array(*map(F.lit, SCALES)), lambda s: F.exists(delivered, lambda d: near(d, value * s)))


def fabricated_steps(reports: DataFrame, observations: DataFrame, leaves_only: bool = False) -> DataFrame:
    """(episode_id, step) whose claim states a number that no delivered observation of the episode holds (Q6, J8). ``leaves_only``: skip steps
    with dependencies, as the library rule does; the scoring rule looks at them too."""
    told = observations.filter("delivered").select("episode_id", F.explode(numbers(F.col("delivered_text"))).alias("number"))
    kinds = observations.select("episode_id", F.col("observation_id").alias("observation"), "compute")
    look = steps(reports).join(kinds, ["episode_id", "observation"]).filter("not compute")
    look = look.filter(F.size("depends_on") == 0) if leaves_only else look
    claims = look.select("episode_id", F.col("id").alias("step"), F.explode(claimed_numbers(F.col("claim"))).alias("value"))
    held = near_pairs(claims, told, by=["episode_id"], scales=SCALES).select("episode_id", "value")
    return claims.join(held, ["episode_id", "value"], "left_anti").select("episode_id", "step").distinct()


def rewarded(reports: DataFrame, observations: DataFrame, verdicts: DataFrame) -> DataFrame:
    """episode_id, category, score, late_inputs (Q10, Q11). ``verdicts``: episode_id, answer_correct, over_budget, path_status.

    Categories by precedence: abstention, malformed, invalid_path, fabricated, wrong, over_budget, infrastructure (no
    verdict), unsupported, correct. Late compute inputs are counted but don't disqualify.
    """
    issues = reference_issues(reports, observations).groupBy("episode_id").agg(F.count_if(F.col("code") != "impossible_chronology").alias("broken"), F.count_if(F.col("code") == "impossible_chronology").alias("late_inputs"))
    made_up = fabricated_steps(reports, observations).groupBy("episode_id").agg(F.count(F.lit(1)).alias("made_up"))
    at = reports.select("episode_id", F.col("report.kind").alias("kind")).join(issues, "episode_id", "left").join(made_up, "episode_id", "left").join(verdicts, "episode_id", "left")
    category = (
        F.when(F.col("kind") == "abstention", "abstention").when(F.col("kind") == "malformed", "malformed").when(F.col("broken") > 0, "invalid_path").when(F.col("made_up") > 0, "fabricated")
        .when(~F.coalesce("answer_correct", F.lit(False)), "wrong").when(F.coalesce("over_budget", F.lit(False)), "over_budget").when(F.col("path_status").isNull(), "infrastructure")
        .when(F.col("path_status") == "supported", "correct").otherwise("unsupported")
    )
    return at.select("episode_id", category.alias("category"), (category == "correct").cast("double").alias("score"), F.coalesce("late_inputs", F.lit(0)).alias("late_inputs"))


def delivered_at(observations: DataFrame, requests: DataFrame) -> DataFrame:
    """Each observation's first later request, which is when the policy sees it (W15, M8). requests: episode_id, request."""
    made = observations.select("episode_id", "observation_id", "generated_by_request")
    later = made.join(requests, "episode_id", "left").groupBy("episode_id", "observation_id", "generated_by_request")
    return later.agg(F.min(F.when(F.col("request") > F.col("generated_by_request"), F.col("request"))).alias("delivered_to_request"))


def recorded(text: Column, name: Column, most: int) -> Column:
    """An observation as the policy sees it (Q13): a marker line, then the text clipped to the budget, marker included."""
    head = F.concat(F.lit("[observation "), name, F.lit("]\n"))
    room = F.greatest(F.lit(most) - F.length(head), F.lit(0))
    suffix = F.lit("...(truncated)")
    cut = F.concat(F.substring(text, F.lit(1), F.greatest(room - F.length(suffix), F.lit(0))), F.substring(suffix, F.lit(1), room))
    return F.struct(F.concat(head, F.when(F.length(text) > room, cut).otherwise(text)).alias("text"), tx.tool_outcome(text).alias("outcome"))


def bounded_history(rows: DataFrame, budget: int) -> DataFrame:
    """Rows of each episode in order while their bytes fit; the one that overflows is cut, later ones drop."""
    w = Window.partitionBy("episode_id").orderBy("order").rowsBetween(Window.unboundedPreceding, 0)
    size = F.octet_length("text")
    at = rows.withColumn("_before", F.sum(size).over(w) - size).filter(F.col("_before") < budget)
    room = (F.lit(budget) - F.col("_before")).cast("int")
    cut = F.make_valid_utf8(F.substring(F.encode("text", "utf-8"), F.lit(1), room).cast("string"))
    return at.withColumn("text", F.when(size > room, F.regexp_replace(cut, "�+$", "")).otherwise(F.col("text"))).drop("_before")


def evidence(rows: DataFrame, budget: int) -> DataFrame:
    """Cited rows whole, then uncited ones in order where each still fits (Q14); an episode whose cited rows alone
    exceed the budget comes out with ``over_budget`` and none of the others. Input: episode_id, order, cited, tokens."""
    item = F.struct("order", "tokens")
    mine = rows.groupBy("episode_id").agg(F.sum(F.when(F.col("cited"), F.col("tokens")).otherwise(0)).alias("need"), F.sort_array(F.collect_list(F.when(~F.col("cited"), item))).alias("rest"))
    start = F.struct(F.col("need").alias("used"), F.array().cast("array<int>").alias("kept"))
    add = lambda s, x: F.when(s["used"] + x["tokens"] <= budget, F.struct((s["used"] + x["tokens"]).alias("used"), F.concat(s["kept"], F.array(x["order"].cast("int"))).alias("kept"))).otherwise(s)
    packed = mine.withColumn("p", F.aggregate("rest", start, add)).withColumn("over_budget", F.col("need") > budget)
    return packed.select("episode_id", "over_budget", F.when(~F.col("over_budget"), F.col("p.kept")).otherwise(F.array().cast("array<int>")).alias("uncited_kept"), F.when(F.col("over_budget"), F.col("need")).otherwise(F.col("p.used")).alias("tokens"))


def preview(kind: Column, ref_valid: Column, value_valid: Column, verdict: Column, answer_correct: Column) -> Column:
    """{status, score} of a candidate before training (Q10), by fixed precedence: ABSTENTION, ZERO for a malformed report,
    an invalid path or a fabricated value, UNKNOWN without a verdict, ZERO unsupported, UNKNOWN or ZERO by the answer,
    else SCORED. ``verdict``: struct of status, path_status, score."""
    score = verdict["score"]
    graded = F.coalesce((score > 0) & (score <= 1) & ~F.isnan(score), F.lit(False))
    status = (
        F.when(kind == "abstention", "ABSTENTION").when((kind == "malformed") | ~ref_valid | ~F.coalesce(value_valid, F.lit(True)), "ZERO")
        .when(verdict.isNull() | (verdict["status"] != "ok"), "UNKNOWN").when(verdict["path_status"] == "unsupported", "ZERO").when(answer_correct.isNull(), "UNKNOWN")
        .when(~answer_correct, "ZERO").when(graded, "SCORED").otherwise("UNKNOWN")
    )
    return F.struct(status.alias("status"), F.when(status == "SCORED", score).when(status != "UNKNOWN", 0.0).alias("score"))
