"""Exact dedup by an extendible-hash index on shared files (DataFrame functions only).

A first pass counts 64-bit text hashes. From the counts follows the directory: it doubles while any bucket holds more
than ``capacity`` distinct hashes, splitting only the overfull buckets, as deep as the corpus needs. A second pass sends
each document's whole text to the owner of its bucket, by the directory. Owner tasks hold key ranges (a bucket is a range
of hashes); they chain the texts whose hashes collide, told apart by their bytes, and what a document's entry in the chain
says is the document's result. Hot texts, those of over 1 / HOT of all documents, would overfill their owner: they are at
most HOT, so their entries are made map-side, by bytes too, and their documents meet them where they lie.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from agentlake.llm.shared import materialise, narrow, text_or_empty

#: A hash of more than 1 / HOT of all rows (and more than LEAST_HOT rows) is hot.
HOT, LEAST_HOT = 10_000, 1000
#: Deepest directory: bits of the hash.
MOST_BITS = 40
#: Distinct hashes that a bucket holds unless told otherwise, or as many as make about MOST_BUCKETS buckets.
CAPACITY, MOST_BUCKETS = 500, 1 << 15
#: Slots of the directory up to which (counted) it is broadcast; by default it has at most 8 * MOST_BUCKETS.
SLOTS_AT_ONCE = 1_000_000


def normalised(column: str = "text") -> Column:
    """Lower-case A-Z only; null counts as empty. ``lower`` does the same to texts of one byte a character, and faster."""
    text = text_or_empty(column)
    plain = F.octet_length(text) == F.length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def key_of(column: str = "text") -> Column:
    """A hash that equal normalised texts share. Texts that differ in the case of other letters collide on purpose: this is
    cheaper, and the chain tells them apart."""
    return F.xxhash64(F.lower(text_or_empty(column)))


def slot_of(key: str, bits: int) -> Column:
    """The first ``bits`` bits of a 64-bit hash."""
    return F.shiftrightunsigned(key, 64 - bits).cast("long") if bits else F.lit(0).cast("long")


def directory(counts: DataFrame, bits: int, capacity: int) -> DataFrame:
    """slot, depth, bucket: for each slot of ``bits`` bits (slot, n) the bucket that holds it.

    A bucket (depth, prefix) is split while it holds more than ``capacity`` and there are bits left, so a slot's bucket is
    its shortest prefix that holds no more. All depths are counted at once; nothing comes to the driver.
    """
    at = counts.select("slot", "n", F.explode(F.sequence(F.lit(0), F.lit(bits))).alias("depth"))
    prefix = F.expr(f"shiftright(slot, {bits} - depth)")
    held = at.groupBy("depth", prefix.alias("prefix")).agg(F.sum("n").alias("held")).filter((F.col("held") <= capacity) | (F.col("depth") == bits))
    met = at.select("slot", "depth", prefix.alias("prefix")).join(held, ["depth", "prefix"])
    found = met.groupBy("slot").agg(F.min(F.struct("depth", "prefix")).alias("b"))
    # depth and prefix in one number: a 1 before the prefix's bits
    return found.select("slot", F.col("b.depth").alias("depth"), (F.expr("shiftleft(1L, b.depth)") + F.col("b.prefix")).alias("bucket"))


def exact_dedup(docs: DataFrame, capacity: int | None = None, carried: tuple[str, ...] = (), hot: int = HOT, least_hot: int = LEAST_HOT) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256, bucket, local_depth, chain, and a struct
    ``row`` of doc_id, text and the ``carried`` columns.

    Of equal texts the row with the largest doc_id stays (null ids sort lowest); of repeated rows with that doc_id one
    stays. Null text counts as empty; a very long text is compared whole. An empty table gives no rows; columns that
    aren't carried are ignored, whatever their names.
    """
    narrow_rows = docs.select(key_of().alias("hash")).groupBy("hash").agg(F.count(F.lit(1)).alias("n"))
    hashes = materialise(narrow_rows, "hashes")
    size = hashes.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    capacity = capacity or max(CAPACITY, size[0] // MOST_BUCKETS)
    # a few bits more than an even spread needs, as hashes spread nearly evenly
    bits = min(MOST_BITS, (size[0] // capacity).bit_length() + 2)
    table = materialise(directory(hashes.groupBy(slot_of("hash", bits).alias("slot")).agg(F.count(F.lit(1)).alias("n")), bits, capacity), "directory")

    row = F.struct(*(F.col(f"`{c}`") for c in dict.fromkeys(("doc_id", "text", *carried))))
    rows = docs.select(F.col("doc_id").alias("doc_id"), key_of().alias("hash"), row.alias("row")).withColumn("slot", slot_of("hash", bits))
    often = hashes.filter(F.col("n") > max(least_hot, size[1] // hot)).select("hash")  # fewer than ``hot``
    hot_hashes = [r[0] for r in often.collect()]
    is_hot = F.col("hash").isin(hot_hashes) if hot_hashes else F.lit(False)

    dealt = rows.filter(~is_hot).join(narrow(table, SLOTS_AT_ONCE), "slot").repartition("bucket").withColumn("norm", normalised("row.text"))
    entry = Window.partitionBy("bucket", "hash", "norm")
    chain = Window.partitionBy("bucket", "hash").orderBy("norm")
    told = dealt.select(
        "row", "doc_id", "hash", "bucket", "depth",
        F.sha2("norm", 256).alias("text_sha256"),
        (F.dense_rank().over(chain) - 1).alias("chain"),
        F.max("doc_id").over(entry).alias("keep_id"),
        F.count(F.lit(1)).over(entry).alias("group_size"),
        F.row_number().over(entry.orderBy(F.desc_nulls_last("doc_id"))).alias("nth"),
    )
    told = told.withColumn("kept", F.col("nth") == 1).drop("nth")
    if hot_hashes:
        told = told.unionByName(_hot(rows.filter(is_hot).join(narrow(table, SLOTS_AT_ONCE), "slot").withColumn("norm", normalised("row.text"))))
    return told.select("doc_id", "keep_id", "group_size", "kept", "text_sha256", "bucket", F.col("depth").alias("local_depth"), "chain", "hash", "row")


def _hot(rows: DataFrame) -> DataFrame:
    """What ``exact_dedup`` says of the rows of hot hashes, of which there are few distinct texts."""
    entries = rows.groupBy("bucket", "hash", "norm").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    chain = Window.partitionBy("bucket", "hash").orderBy("norm")
    entries = entries.select("bucket", "hash", F.sha2("norm", 256).alias("text_sha256"), "keep_id", "group_size", (F.dense_rank().over(chain) - 1).alias("chain"))
    entries = materialise(entries, "hot")
    met = rows.withColumn("text_sha256", F.sha2("norm", 256)).join(narrow(entries, SLOTS_AT_ONCE), ["bucket", "hash", "text_sha256"])
    met = met.select("row", "doc_id", "hash", "bucket", "depth", "text_sha256", "chain", "keep_id", "group_size")
    last = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    nth = F.row_number().over(Window.partitionBy("bucket", "hash", "text_sha256").orderBy("doc_id"))
    stays = met.filter(last).withColumn("kept", nth == 1)  # one row, but for repeated ones
    return met.filter(~last).withColumn("kept", F.lit(False)).unionByName(stays)


def keep_rows(docs: DataFrame, capacity: int | None = None) -> DataFrame:
    """The rows of ``docs`` that ``exact_dedup`` keeps, with their own columns, in the owners' one shuffle of the documents.

    Null ids, null and empty texts, repeated rows and empty tables as there; columns of any name are carried along.
    """
    columns = tuple(c for c in docs.columns if c != "doc_id")
    return exact_dedup(docs, capacity, columns).filter("kept").select(*(F.col(f"row.`{c}`").alias(c) for c in docs.columns))
