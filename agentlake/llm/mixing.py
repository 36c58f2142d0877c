"""Mixing sources to target weights in fixed-length blocks (DataFrame functions only).

Each source's words, in (doc_id) order, are packed into blocks of ``block`` words (shorter blocks for sources of few
words, so that rounding to whole blocks stays small). A source gets as many slots of the mix as its target needs, at most
3 for each block. For every output shard the number of slots of each source is drawn (multinomial, given each source's
total, so that sources meet their targets but for rounding): a slot's hash names its shard, and shards count. From these
counts slots are numbered shard by shard. Slot o of a source takes block pi(o mod blocks), pi being the source's own
pseudorandom permutation of block indices (the order of their hashes). Slots and blocks then meet in a join by index.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from agentlake.llm.shared import materialise, narrow, with_prefix

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
#: Slots that one row makes, and about how many one task makes.
SLOTS_AT_ONCE, SLOTS_AT_TASK = 8192, 1 << 17


def word_count(column: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(column), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = 3) -> DataFrame:
    """Add src (rank by code point, null last), weight and target to rows (source, source_size).

    Targets share the sum of all sizes by weight; none exceeds ``most`` times its source's size, and the excess is
    reshared by weight. Closed form: with sources sorted by most * size / weight, the capped ones are a prefix, and
    the rest get the same amount for each unit of weight.
    """
    rank = Window.orderBy(F.col("source").asc_nulls_last())
    by_ratio = Window.orderBy("ratio", "src").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    out = sources.withColumn("src", (F.row_number().over(rank) - 1).cast("long"))
    out = out.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("src") % len(weights) + 1).cast("int")))
    out = out.withColumn("ratio", most * F.col("source_size") / F.col("weight"))
    total, weight = F.sum("source_size").over(everything), F.sum("weight").over(everything)
    capped = F.coalesce(F.sum(most * F.col("source_size")).over(by_ratio), F.lit(0))
    level = (total - capped) / (weight - F.coalesce(F.sum("weight").over(by_ratio), F.lit(0)))
    out = out.withColumn("level", level)
    share = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "src", "level"))).over(everything)["level"]
    return out.withColumn("target", F.least(F.col("ratio"), F.coalesce(share, F.col("ratio"))) * F.col("weight")).drop("ratio", "level")


@dataclass
class Mix:
    """sources: a row each; rows: documents with row_index, start (word offset in the source); spans: the part of each
    document in each block; slots: out_shard, src, slot, block."""

    sources: DataFrame
    rows: DataFrame
    spans: DataFrame
    slots: DataFrame

    def stream(self) -> DataFrame:
        """The mix itself: for every slot the spans (document, first word, words) of its block."""
        return self.slots.hint("merge").join(self.spans.filter("block is not null"), ["src", "block"])

    def taken(self) -> DataFrame:
        """rows with ``taken``: words the mix takes of each document, repeats counted, as its slots and blocks meet."""
        met = self.spans.join(self.slots.select("src", "block", "slot").hint("merge"), ["src", "block"], "left")
        words = F.when(F.col("slot").isNotNull(), F.col("words"))
        return met.groupBy("row_index", "doc_id", "size", "src").agg(F.coalesce(F.sum(words), F.lit(0)).cast("long").alias("taken"))


def permuted(sources: DataFrame, seed: int, tasks: int) -> DataFrame:
    """src, at, block: each source's pseudorandom permutation of its block indices (sources: src, blocks). Blocks in the
    order of their hashes take the places from 0 on; the order is global and dealt by range."""
    chunks = sources.filter("blocks > 0").select("src", "blocks", F.explode(F.expr(f"sequence(0L, (blocks - 1) div {SLOTS_AT_ONCE})")).alias("chunk")).repartition(tasks, "src", "chunk")
    each = F.sequence(F.col("chunk") * SLOTS_AT_ONCE, F.least((F.col("chunk") + 1) * SLOTS_AT_ONCE, F.col("blocks")) - 1)
    hashed = chunks.select("src", F.explode(each).alias("block")).withColumn("hash", F.xxhash64(F.lit(seed), "src", "block"))
    placed = with_prefix(hashed.withColumn("one", F.lit(1)), ["src", "hash", "block"], "one", "permuted").select("src", "row_index", "block")
    before = Window.orderBy("src").rowsBetween(Window.unboundedPreceding, -1)
    first = sources.select("src", F.coalesce(F.sum("blocks").over(before), F.lit(0)).alias("first"))
    return placed.join(narrow(first, 100_000), "src").select("src", (F.col("row_index") - F.col("first")).alias("at"), "block")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = 3, block: int = 64, shard_words: int = 1 << 20, seed: int = 7) -> Mix:
    """Plan a mix of all of ``docs`` (doc_id, text, source). Reruns agree. Documents without words are in no block.

    Null sources form a source of their own; null text has no words; a very long text spans as many blocks as it needs;
    repeated rows are rows of their own; other columns are ignored; an empty table makes an empty mix.
    """
    sized = docs.select("doc_id", "source", word_count().alias("size"))
    sized = materialise(sized, "sized")
    sources = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most)
    length = F.greatest(F.lit(1), F.least(F.lit(block), F.floor(F.col("source_size") / 256))).cast("long")
    sources = sources.withColumn("length", length).withColumn("blocks", F.ceil(F.col("source_size") / F.col("length")).cast("long"))
    n_slots = F.least(most * F.col("blocks"), F.round(F.col("target") * F.col("blocks") / F.col("source_size")).cast("long"))
    sources = sources.withColumn("slots", F.when(F.col("source_size") > 0, n_slots).otherwise(F.lit(0)))
    before = Window.orderBy("src").rowsBetween(Window.unboundedPreceding, -1)
    sources = sources.withColumn("base", F.coalesce(F.sum("source_size").over(before), F.lit(0)))
    sources = materialise(sources, "sources")
    small = narrow(sources.select("src", F.col("source").alias("_agentlake_source"), "base", "length", "blocks", "slots"), 100_000)

    numbered = sized.join(small.select("src", "_agentlake_source"), F.col("source").eqNullSafe(F.col("_agentlake_source"))).drop("source", "_agentlake_source")
    rows = with_prefix(numbered, ["src", "doc_id", "size"], "size", "by_source").join(small.select("src", "base", "length"), "src")
    rows = rows.select("row_index", "doc_id", "src", "size", (F.col("prefix") - F.col("base")).alias("start"), "length")
    first, last = F.floor(F.col("start") / F.col("length")), F.floor((F.col("start") + F.col("size") - 1) / F.col("length"))
    blocks = F.when(F.col("size") > 0, F.sequence(first, last))
    spans = rows.select("*", F.explode_outer(blocks).alias("block"))
    low = F.greatest(F.col("start"), F.col("block") * F.col("length"))
    high = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * F.col("length"))
    spans = spans.select("row_index", "doc_id", "src", "size", "block", (low - F.col("start")).alias("first_word"), (high - low).alias("words"))

    words = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    out_shards = max(1, -(-words // shard_words))
    n_all = sources.agg(F.coalesce(F.sum("slots"), F.lit(0))).first()[0]
    tasks = max(1, -(-n_all // SLOTS_AT_TASK))
    chunks = sources.filter("slots > 0").select("src", "slots", F.explode(F.expr(f"sequence(0L, (slots - 1) div {SLOTS_AT_ONCE})")).alias("chunk")).repartition(tasks, "src", "chunk")
    each = F.sequence(F.col("chunk") * SLOTS_AT_ONCE, F.least((F.col("chunk") + 1) * SLOTS_AT_ONCE, F.col("slots")) - 1)
    drawn = chunks.select("src", F.explode(each).alias("draw")).select("src", F.pmod(F.xxhash64(F.lit(seed), "src", "draw"), F.lit(out_shards)).alias("out_shard"))
    counts = drawn.groupBy("src", "out_shard").agg(F.count(F.lit(1)).alias("n"))
    counts = with_prefix(counts, ["src", "out_shard"], "n", "drawn").withColumnRenamed("prefix", "upto")
    counts = materialise(counts.join(counts.groupBy("src").agg(F.min("upto").alias("low")), "src").select("src", "out_shard", "n", (F.col("upto") - F.col("low")).alias("first")), "counts")
    parts = counts.select("src", "out_shard", "first", "n", F.explode(F.expr(f"sequence(0L, (n - 1) div {SLOTS_AT_ONCE})")).alias("part")).repartition(tasks, "src", "out_shard", "part")
    each = F.sequence(F.col("first") + F.col("part") * SLOTS_AT_ONCE, F.col("first") + F.least((F.col("part") + 1) * SLOTS_AT_ONCE, F.col("n")) - 1)
    slots = parts.select("out_shard", "src", F.explode(each).alias("slot")).join(small.select("src", "blocks"), "src")
    slots = slots.select("out_shard", "src", "slot", (F.col("slot") % F.col("blocks")).alias("at"))
    slots = slots.hint("merge").join(permuted(sources.select("src", "blocks"), seed, tasks), ["src", "at"]).drop("at")
    return Mix(sources, rows, spans, slots)


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """Whole documents of the mix, with the columns of ``docs``: each comes as often as the block with its first word
    is drawn (0 to ``most`` times), so sources keep to their targets on the whole. Documents without words are in no block
    and don't come; null ids and sources match as such; repeated rows share what they draw; other columns stay, whatever
    their names; an empty table stays empty."""
    m = mix(docs, **options)
    times = m.slots.groupBy("src", "block").agg(F.count(F.lit(1)).cast("int").alias("times"))
    first = m.spans.filter("first_word = 0 and block is not null").select("doc_id", "size", "src", "block")
    drawn = first.join(times.hint("merge"), ["src", "block"]).join(m.sources.select("src", F.col("source").alias("_agentlake_source")), "src")
    drawn = drawn.groupBy(F.col("doc_id").alias("_agentlake_id"), "_agentlake_source", F.col("size").alias("_agentlake_size")).agg(F.sum("times").alias("_agentlake_sum"), F.count(F.lit(1)).alias("_agentlake_rows"))
    # repeated rows (same id, source and size) share what they draw
    drawn = drawn.select("_agentlake_id", "_agentlake_source", "_agentlake_size", F.greatest(F.lit(1), F.round(F.col("_agentlake_sum") / F.col("_agentlake_rows"))).cast("int").alias("_agentlake_times"))
    sized = docs.withColumn("_agentlake_words", word_count())
    same = F.col("doc_id").eqNullSafe(F.col("_agentlake_id")) & F.col("source").eqNullSafe(F.col("_agentlake_source")) & (F.col("_agentlake_words") == F.col("_agentlake_size"))
    both = sized.join(materialise(drawn, "drawn_documents").hint("merge"), same)
    return both.withColumn("_agentlake_copy", F.explode(F.sequence(F.lit(1), F.col("_agentlake_times")))).select(*docs.columns)
