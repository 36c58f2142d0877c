"""Contiguous shards of near-equal bytes from global prefix sums (DataFrame functions only).

Rows are ordered by (text hash, doc_id), so equal texts are neighbours. Per-partition totals give global byte
offsets; equal targets cut that line into shards. A group of equal texts that a cut would part goes whole to
the earlier shard if it holds at most ``whole`` of a shard's bytes; larger groups are parted at the cut.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agentlake.llm.shared import materialise, text_or_empty, with_prefix


def shard_by_bytes(docs: DataFrame, shards: int = 40, overhead: int = 16, whole: float = 0.01) -> DataFrame:
    """doc_id, size, text_crc32, law ('bytes'), shard, slot, grown_shard (null) for every row of ``docs``.

    Size is the UTF-8 bytes of the text (null: none) plus ``overhead``. Slots run from 0 without gaps in each
    shard. Null ids and repeated rows are rows like others; an empty table gives no rows.
    """
    text = text_or_empty()
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + overhead).cast("long").alias("size"),
        F.crc32(F.encode(text, "utf-8")).alias("text_crc32"),
        F.xxhash64(text).alias("key"),
    )
    placed = materialise(with_prefix(rows, ["key", "doc_id", "size", "text_crc32"], "size", "by_key"), "placed")
    total = placed.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    cut = F.least(F.lit(shards - 1), F.floor(F.col("prefix") * shards / F.lit(max(total, 1)))).cast("int")
    placed = placed.withColumn("shard", cut)
    edges = sorted(  # a row per shard
        placed.groupBy("shard").agg(F.min(F.struct("row_index", "key")).alias("low"), F.max(F.struct("row_index", "key")).alias("high")).collect(), key=lambda r: r["shard"]
    )
    parted = sorted({a["high"]["key"] for a, b in zip(edges, edges[1:], strict=False) if a["high"]["key"] == b["low"]["key"]})
    shard = F.col("shard")
    if parted:  # fewer than ``shards`` keys
        groups = placed.filter(F.col("key").isin(parted)).groupBy("key").agg(F.sum("size").alias("bytes"), F.min("shard").alias("to")).collect()
        for g in groups:
            if g["bytes"] <= whole * total / shards:
                shard = F.when(F.col("key") == g["key"], F.lit(g["to"])).otherwise(shard)
    placed = placed.withColumn("shard", shard)
    first = F.broadcast(placed.groupBy("shard").agg(F.min("row_index").alias("first")))  # a row per shard
    return placed.join(first, "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("row_index") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
