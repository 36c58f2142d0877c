"""Preparing question sets: nested training rows, answer cleaning, drop reasons, constraints, splits."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from agentlake.functions import text as tx
from agentlake.operators.order import global_index


def train_row(data_source: Column, question: Column, answers: Column, system: str, extra: Mapping[str, Column], agent: str = "tool_agent", ability: str = "search", style: str = "rule") -> Column:
    """The nested training row (P1, P2, P4): prompt messages, gold answers in reward_model only, the rest in extra_info."""
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return F.struct(
        data_source.alias("data_source"),
        F.lit(agent).alias("agent_name"),
        F.array(message("system", F.lit(system)), message("user", question)).alias("prompt"),
        F.lit(ability).alias("ability"),
        F.struct(F.lit(style).alias("style"), answers.alias("ground_truth")).alias("reward_model"),
        F.struct(*(c.alias(name) for name, c in extra.items())).alias("extra_info"),
    )


def multi_hop_rows(df: DataFrame) -> DataFrame:
    """Questions with answers and a drop reason (P6, F1, F2): unanswerable, no question, no answer; null if kept.

    Input: id, question, answer, answer_aliases, answerable, question_decomposition.
    """
    golds = tx.clean_answers(F.concat(F.array(F.coalesce("answer", F.lit(""))), F.coalesce("answer_aliases", F.array().cast("array<string>"))))
    hops = F.size(F.coalesce("question_decomposition", F.array()))
    reason = F.when(~F.coalesce("answerable", F.lit(True)), "unanswerable").when(tx.strip(F.coalesce("question", F.lit(""))) == "", "no question").when(F.size(golds) == 0, "no answer")
    return df.select("id", tx.strip("question").alias("question"), golds.alias("answers"), F.when(hops > 0, F.concat(hops.cast("string"), F.lit("hop"))).otherwise("").alias("hop_type"), reason.alias("drop_reason"))


def conversion_stats(rows: DataFrame) -> DataFrame:
    """Rows by drop reason, 'kept' for those without."""
    return rows.groupBy(F.coalesce("drop_reason", F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def math_rows(df: DataFrame, levels: Sequence[int] | None = None) -> DataFrame:
    """Total rows with level, boxed gold and a keep flag (P3, F3); dropping is a filter, so the schema never depends on data."""
    from agentlake.functions.numbers import boxed_answer

    out = df.withColumn("level_number", tx.level_number("level")).withColumn("gold", boxed_answer("solution"))
    wanted = F.col("level_number").isin(*levels) if levels else F.lit(True)
    return out.withColumn("keep", F.coalesce(wanted & (F.coalesce("gold", F.lit("")) != ""), F.lit(False)))


def reindexed(sources: Sequence[DataFrame], order: str) -> DataFrame:
    """Sources one after the other with a global index."""
    parts = [df.withColumn("source_order", F.lit(i)) for i, df in enumerate(sources)]
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    return global_index(union, ["source_order", order], "index")


def replicated(df: DataFrame, k: int, uid: str = "uid") -> DataFrame:
    """Each row k times with uid#i and the uid as group."""
    return df.withColumn("group", F.col(uid)).withColumn("sample", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))).withColumn(uid, F.concat_ws("#", "group", "sample"))


def prefix(df: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    """The first n rows in an explicit order (T-1); a top-n merge, no global sort."""
    return df.orderBy(*order).limit(n)


def by_id_list(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of an id list (id, pos) in its order (S15, J4); ids that aren't there come out with ``found`` false."""
    return ids.join(df.withColumn("found", F.lit(True)), ids["id"] == df[key], "left").withColumn("found", F.coalesce("found", F.lit(False)))


def repeated(df: DataFrame, key: str) -> DataFrame:
    """Keys that come more than once."""
    return df.groupBy(key).count().filter("count > 1")


def overlap(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct keys that both hold (F12, U3, J11); must be empty for disjoint splits."""
    return a.select(*keys).distinct().join(b.select(*keys).distinct(), list(keys), "left_semi")


def missing(wanted: DataFrame, given: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct keys wanted but not given."""
    return wanted.select(*keys).distinct().join(given, list(keys), "left_anti")


def stable_key(source: Column, source_id: Column) -> Column:
    """What names a question across artifacts."""
    return F.concat_ws(":", source, source_id.cast("string"))


def length_order(key: str) -> list[Column]:
    """Shorter ids first, then by value, so that numbered ids come in order (T-7)."""
    return [F.length(key), F.col(key)]


def unexpected_counts(df: DataFrame, wanted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys whose number of rows isn't the one wanted (keys, wanted) (F13, F14, F16), none counting as 0."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    both = counts.join(wanted, list(keys), "full_outer").select(*keys, F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("wanted", F.lit(0)).cast("long").alias("wanted"))
    return both.filter("n <> wanted")


def unequal_ids(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys on one side only (U5, F14, F16), with the side."""
    left = a.select(key).distinct().withColumn("in_a", F.lit(True))
    right = b.select(key).distinct().withColumn("in_b", F.lit(True))
    both = left.join(right, key, "full_outer").filter("in_a is null or in_b is null")
    return both.select(key, F.when(F.col("in_a"), "a").otherwise("b").alias("side"))


def map_difference(a: Column, b: Column) -> Column:
    """Keys whose values differ, null-safe."""
    keys = F.array_sort(F.array_union(F.map_keys(a), F.map_keys(b)))
    return F.filter(keys, lambda k: ~F.try_element_at(a, k).eqNullSafe(F.try_element_at(b, k)))


def without_credentials(knobs: Column) -> Column:
    """A map of settings without names of secrets."""
    return F.map_filter(knobs, lambda k, v: ~F.upper(k).rlike("(TOKEN|SECRET|PASSWORD|CREDENTIAL|API_?KEY|ACCESS_KEY|PRIVATE)"))


def missing_columns(df: DataFrame, required: Sequence[str]) -> list[str]:
    """Required columns that aren't there."""
    return [c for c in required if c not in df.columns]


def argument_problems(args: Column, required: Sequence[str], known: Sequence[str]) -> Column:
    """Missing and unknown argument names of a tool call (Q15): struct of two arrays."""
    keys = F.map_keys(args)
    return F.struct(F.array_except(F.array(*map(F.lit, required)), keys).alias("missing"), F.array_except(keys, F.array(*map(F.lit, known))).alias("unknown"))


def retention(checkpoints: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Checkpoints (name, step, complete) with ``keep`` (U8): those named and the last complete one. Unknown names fail."""
    unknown = missing(checkpoints.sparkSession.createDataFrame([(k,) for k in keep], "name string"), checkpoints, ["name"]).collect() if keep else []
    if unknown:
        raise ValueError(f"no such checkpoints: {[r[0] for r in unknown]}")
    last = checkpoints.filter("complete").agg(F.max_by("name", "step")).first()[0]
    return checkpoints.withColumn("keep", F.col("name").isin(*keep, *([last] if last else [])))


# --- splits ---


def allocation(counts: DataFrame, n: int) -> DataFrame:
    """Largest-remainder shares of n over strata (stratum, size) (W3): floors, then one each by remainder, ties by name."""
    everything = Window.partitionBy()
    exact = F.lit(n) * F.col("size") / F.sum("size").over(everything)
    out = counts.withColumn("floor", F.floor(exact)).withColumn("rest", exact - F.floor(exact))
    left = F.lit(n) - F.sum("floor").over(everything)
    rank = F.row_number().over(Window.orderBy(F.desc("rest"), "stratum"))
    out = out.withColumn("left", left).withColumn("rank", rank)
    return out.select("stratum", "size", (F.col("floor") + (F.col("rank") <= F.col("left")).cast("long")).alias("want"))


def hash_order(key: Column, seed: str = "") -> Column:
    """A fixed pseudorandom order (T-11, W4): sha256 of seed and key."""
    return F.sha2(F.concat(F.lit(seed), key.cast("string")), 256)


def hash_pick(df: DataFrame, stratum: str, key: str, want: DataFrame | int, seed: str = "") -> DataFrame:
    """The first rows of each stratum in hash order (W4, W5, W6, T-9, T-10): ``want`` is a number or (stratum, want).

    Ranks are found by ``row_number`` under a limit that Spark pushes below the shuffle (WindowGroupLimit), so a large
    stratum sends at most ``want`` rows from each task.
    """
    order = Window.partitionBy(stratum).orderBy(hash_order(F.col(key), seed), key)
    ranked = df.withColumn("_rank", F.row_number().over(order))
    if isinstance(want, int):
        return ranked.filter(F.col("_rank") <= want).drop("_rank")
    most = want.agg(F.max("want")).first()[0] or 0
    limits = want.select(F.col("stratum").alias(stratum), "want")
    return ranked.filter(F.col("_rank") <= most).join(F.broadcast(limits), stratum).filter("_rank <= want").drop("_rank", "want")


def model_label(run: Column, step: Column, hub_id: Column, given: Column, folder: Column) -> Column:
    """How a result names its model (P17): run/global_step_N, else hub id, else what was given, else the folder."""
    step_name = F.when(tx.first_present([run]).isNotNull() & step.isNotNull(), F.concat(run, F.lit("/global_step_"), step.cast("string")))
    return F.coalesce(step_name, tx.first_present([hub_id, given, folder]))


def filled_policy(policy: Column, defaults: Mapping[str, str] = {"samples_per_question": "1"}) -> Column:
    """A policy map with defaults where it says nothing."""
    base = F.create_map(*(F.lit(x) for kv in defaults.items() for x in kv))
    return F.map_concat(F.map_filter(base, lambda k, v: ~F.coalesce(F.map_contains_key(policy, k), F.lit(False))), F.coalesce(policy, F.create_map().cast("map<string,string>")))


def knob_problems(knobs: DataFrame, rules: DataFrame) -> DataFrame:
    """(name, problem) for every setting (name, value) that breaks its rule (name, kind, low, high, choices) (F21); unknown
    names are problems as well. All are reported, not the first."""
    both = knobs.join(rules, "name", "left")
    number = F.col("value").try_cast("double")
    numeric = F.col("kind").isin("int", "float")
    problem = (
        F.when(F.col("kind").isNull(), "unknown").when((F.col("kind") == "bool") & ~F.lower("value").isin("true", "false", "0", "1"), "not a boolean")
        .when((F.col("kind") == "int") & ~F.col("value").rlike(r"^[-+]?\d+$"), "not an integer").when((F.col("kind") == "float") & number.isNull(), "not a number")
        .when(numeric & ((number < F.col("low")) | (number > F.col("high"))), "out of bounds").when((F.col("kind") == "enum") & ~F.array_contains("choices", F.col("value")), "not a choice")
    )
    return both.withColumn("problem", problem).filter("problem is not null").select("name", "problem")


def indivisible(plans: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Rows with the pairs (total, part) of columns that don't divide."""
    found = F.array_compact(F.array(*(F.when(F.col(b).isNull() | (F.col(b) <= 0) | (F.col(a) % F.col(b) != 0), F.lit(f"{a} % {b}")) for a, b in pairs)))
    return plans.withColumn("indivisible", found)


def safe_identifier(c: Column) -> Column:
    """Whether a dotted name is made of plain identifiers."""
    return c.rlike(r"^[A-Za-z_][A-Za-z0-9_]*(\.[A-Za-z_][A-Za-z0-9_]*){0,2}$")


def unreached(nodes: DataFrame, probes: DataFrame) -> DataFrame:
    """Ordered pairs of nodes (node) without a successful probe (src, dst, ok) (J14). Nodes are a cluster's machines."""
    wanted = nodes.select(F.col("node").alias("src")).join(F.broadcast(nodes.select(F.col("node").alias("dst")))).filter("src <> dst")
    return wanted.join(probes.filter("ok").select("src", "dst"), ["src", "dst"], "left_anti")


def owned(tables: DataFrame, properties: DataFrame, owner: str, keep: Sequence[str]) -> DataFrame:
    """Tables (name) whose property says an owner, but those kept."""
    mine = properties.filter((F.col("key") == "owner") & (F.col("value") == owner)).select("name")
    return tables.join(mine, "name", "left_semi").filter(~F.col("name").isin(*keep))
