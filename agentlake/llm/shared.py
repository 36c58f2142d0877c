"""Helpers of the corpus operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agentlake.operators.order import materialise, narrow, release, release_table, shared_dir, with_prefix

__all__ = ["hot_join", "materialise", "narrow", "release", "release_table", "shared_dir", "text_or_empty", "with_prefix"]


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def hot_join(rows: DataFrame, table: DataFrame, keys: list[str], count: str, parts: int = 10_000) -> DataFrame:
    """``rows`` left join ``table`` on ``keys`` (not null in either), with the rows of hot keys joined where they lie.

    ``table`` has a row for each key and its number of rows in ``count`` (left out of the result). Keys that hold over
    1 / ``parts`` of all rows are at most ``parts``, so they are broadcast; the other rows are dealt by key.
    """
    rest = [c for c in table.columns if c not in (*keys, count)]
    total = rows.count()
    hot = materialise(table.filter(F.col(count) > max(1000, total // parts)).drop(count).withColumn("_agentlake_hot", F.lit(True)), "hot")
    if not hot.limit(1).count():
        return rows.join(table.drop(count), keys, "left")
    near = rows.join(F.broadcast(hot), keys, "left")
    met = near.filter("_agentlake_hot").select(*rows.columns, *rest)
    cold = near.filter("_agentlake_hot is null").select(*rows.columns)
    return met.unionByName(cold.join(table.drop(count), keys, "left").select(*rows.columns, *rest))
