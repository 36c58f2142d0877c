"""Trace diagnostics: buckets, the exact-match decomposition, supporting recall, role spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from agentlake.functions import text as tx
from agentlake.functions.stats import ratio


def diagnosed(traces: DataFrame) -> DataFrame:
    """uid, hop, em, cover, answered, surfaced, bucket of traces (uid, hop_type, pred, em, cover_em, f1, gt, tool_texts)."""
    surfaced = tx.gold_surfaced(F.col("tool_texts"), F.col("gt"))
    out = traces.withColumn("answered", F.coalesce("pred", F.lit("")) != "").withColumn("surfaced", surfaced)
    return out.withColumn("bucket", tx.trace_bucket(F.col("em") > 0, F.col("answered"), F.col("f1"), F.col("surfaced")))


def decomposition(df: DataFrame, *by: str) -> DataFrame:
    """EM = P(S) P(C|S) + P(not S) P(C|not S) (A21); a conditional is null where its condition never holds. Input: surfaced, correct (boolean)."""
    s, c = F.col("surfaced"), F.col("correct")
    out = (df.groupBy(*by) if by else df.groupBy()).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(s).alias("n_surfaced"), F.count_if(s & c).alias("right_surfaced"), F.count_if(~s & c).alias("right_not"),
    )
    rest = F.col("n") - F.col("n_surfaced")
    return out.select(
        *by, "n", ratio(F.col("n_surfaced"), F.col("n")).alias("p_surfaced"),
        F.try_divide(F.col("right_surfaced").cast("double"), F.col("n_surfaced").cast("double")).alias("right_given_surfaced"),
        F.try_divide(F.col("right_not").cast("double"), rest.cast("double")).alias("right_given_not"),
        ratio(F.col("right_surfaced") + F.col("right_not"), F.col("n")).alias("em"),
    )


def supporting_recall(df: DataFrame) -> DataFrame:
    """Mean share of supporting titles surfaced, share of questions with all, EM given all (A22, U6). Input: wanted, surfaced (titles), em."""
    got = F.size(F.array_intersect("wanted", "surfaced")) / F.size(F.array_distinct("wanted"))
    full = df.filter(F.size("wanted") > 0).withColumn("r", got)
    return full.agg(F.count(F.lit(1)).alias("n"), F.avg("r").alias("mean_recall"), F.avg((F.col("r") == 1).cast("double")).alias("all_surfaced"), F.avg(F.when(F.col("r") == 1, F.col("em"))).alias("em_given_all"))


def with_supporting(traces: DataFrame, titles: DataFrame) -> DataFrame:
    """Supporting titles by question, else by uid (J5): two equi-joins, as an OR would compare all pairs."""
    by = lambda key, name: titles.select(F.col("key").alias(key), F.col("titles").alias(name)).dropDuplicates([key])
    out = traces.join(by("question", "_q"), "question", "left").join(by("uid", "_u"), "uid", "left")
    return out.withColumn("supporting_titles", F.coalesce("_q", "_u")).drop("_q", "_u")


def examples(df: DataFrame, bucket: str, order: str, n: int = 3) -> DataFrame:
    """The first few rows of each bucket."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(bucket).orderBy(order))).filter(F.col("rank") <= n)


def role_runs(turns: DataFrame, key: str, order: str, role: Column) -> DataFrame:
    """Spans of characters by role over a conversation's joined texts (E1, W9): neighbours of one role merge, empty texts
    drop out. key, role, start, end (in characters)."""
    full = turns.filter(F.length("text") > 0).select(key, order, role.alias("role"), F.length("text").alias("len"))
    w = Window.partitionBy(key).orderBy(order)
    cut = full.withColumn("new", (F.coalesce(F.lag("role").over(w), F.lit("")) != F.col("role")).cast("int"))
    at = cut.withColumn("run", F.sum("new").over(w)).withColumn("upto", F.sum("len").over(w))
    return at.groupBy(key, "run").agg(F.first("role").alias("role"), F.min(F.col("upto") - F.col("len")).cast("long").alias("start"), F.max("upto").cast("long").alias("end")).drop("run")


def split_spans(text: Column, spans: Column) -> Column:
    """Texts of spans (role, start, end), null unless they are sorted, contiguous and cover the whole text."""
    ends = F.aggregate(spans, F.lit(0), lambda at, s: F.when((at >= 0) & (s["start"] == at) & (s["end"] > at), s["end"]).otherwise(-1))
    cut = F.transform(spans, lambda s: F.struct(s["role"].alias("role"), F.substring(text, s["start"] + 1, s["end"] - s["start"]).alias("text")))
    return F.when((ends == F.length(text)) & (F.size(spans) > 0), cut)
