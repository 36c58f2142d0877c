"""Near-duplicate documents by SetSketch registers, banded, estimated jointly by likelihood, verified on full sets.

A document's set is that of its distinct 5-word shingles. A register is max(floor(1 - log_base(x))) over the set's
exponentially distributed hashes x, cut to 0..LIMIT: registers of unions are maxima, and equal registers are as
likely as the sets are similar. Documents of equal sets form a class at once; one row per class goes on. Bands of
registers deal classes to buckets. Each bucket links its members to its least one, which is enough for groups of
copies of any size. Members of a bucket that are still in different components after that are compared in pairs, so
no link within a bucket is lost. Before that, shingles that no other open document holds are counted: they bound what
a document can share, and rule out most of a group whose members differ too much to be linked. Small buckets then
emit pairs; large ones are compared block by block where they lie, and emit links only.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agentlake.llm.components import components, merged
from agentlake.llm.shared import hot_join, materialise, narrow
from agentlake.llm.words import U, mixed, shingle_sets, text_blocks, tidy

BASE, RATE, LIMIT = 1.001, 20.0, 65534
#: Ids of candidates are broadcast to the text scan up to this many (counted); beyond, texts are shuffled to them.
IDS_AT_ONCE = 2_000_000
#: Members up to which a bucket emits pairs, and members in a block of a larger one (two blocks bound a task's memory).
SMALL_BUCKET, BLOCK = 64, 256
#: Shingles compared at once by a pair of blocks.
COLUMNS = 4096


@dataclass(frozen=True)
class Settings:
    """``percent``: least 100 * intersection / union. With 20 bands of 5 registers a pair at 85 % shares no bucket with
    probability (1 - 0.85 ** 5) ** 20 < 1e-5. ``slack``: how far under ``percent`` an estimate may be and still be
    verified (over 4 standard errors of 100 registers)."""

    percent: int = 85
    words: int = 5
    bands: int = 20
    rows: int = 5
    slack: float = 0.17


def registers(sets: list[np.ndarray], count: int) -> np.ndarray:
    """(len(sets), count) uint16; an empty set's are 0."""
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    out = np.zeros((len(sets), count), dtype=np.uint16)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    flat = np.concatenate([sets[i] for i in full])
    starts = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
    seeds = mixed(np.arange(1, count + 1, dtype=np.uint64) * U(0x9E3779B97F4A7C15))
    work = np.empty_like(flat)
    low = np.empty((len(full), count))
    with np.errstate(over="ignore"):
        for j in range(count):
            np.bitwise_xor(flat, seeds[j], out=work)
            work *= seeds[j] | U(1)
            work ^= work >> U(32)
            work *= U(0xD6E8FEB86659FD93)
            low[:, j] = np.minimum.reduceat(work, starts)
    x = -np.log1p(-(low + 1) / 2.0**64) / RATE
    out[full] = np.clip(np.floor(1 - np.log(x) / np.log(BASE) - OFFSET), 0, LIMIT).astype(np.uint16)
    return out


#: Registers count from here, so that a 16-bit range covers sets of 1 to 10 ** 20 members.
OFFSET = np.floor(1 - np.log(2.0**6 / RATE) / np.log(BASE))


def likely_similarity(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """Jaccard similarity of most likelihood given how many registers of a are above, below and equal to b's, on a grid."""
    above, below = (a > b).sum(1), (a < b).sum(1)
    equal = a.shape[1] - above - below
    u, v = size_a / (size_a + size_b), size_b / (size_a + size_b)
    best, at = np.full(len(a), -np.inf), np.zeros(len(a))
    chance = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)
    for j in np.linspace(0, 1, 101):
        p, q = chance(u - v * j), chance(v - u * j)
        r = np.maximum(1 - p - q, 1e-12)
        score = above * np.log(np.maximum(p, 1e-12)) + below * np.log(np.maximum(q, 1e-12)) + equal * np.log(r)
        better = (score > best) & (j <= np.minimum(u / v, v / u) + 0.01)
        best, at = np.where(better, score, best), np.where(better, j, at)
    return at


def _features(settings: Settings):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, texts in text_blocks(batch):
                sets = shingle_sets(texts, settings.words)
                regs = registers(sets, settings.bands * settings.rows)
                with np.errstate(over="ignore"):
                    one = [int(s.sum().astype(np.int64)) if len(s) else 0 for s in sets]
                    two = [int(mixed(s).sum().astype(np.int64)) if len(s) else 0 for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array([len(s) for s in sets], pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array([r.tobytes() for r in regs], pa.binary())],
                    ["doc_id", "n", "set_1", "set_2", "regs"],
                )

    return run


def _bands(settings: Settings):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.array(batch.column(0).to_pylist(), dtype=np.int64)
            regs = np.frombuffer(b"".join(batch.column(2).to_pylist()), dtype=np.uint16).reshape(len(ids), settings.bands, settings.rows)
            with np.errstate(over="ignore"):
                key = np.zeros((len(ids), settings.bands), dtype=np.uint64) + np.arange(1, settings.bands + 1, dtype=np.uint64)
                for j in range(settings.rows):
                    key = mixed(key * U(0x9E3779B97F4A7C15) + regs[:, :, j].astype(np.uint64))
            n = np.array(batch.column(1).to_pylist(), dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64).ravel()), pa.array(np.repeat(ids, settings.bands)), pa.array(np.repeat(n, settings.bands))], ["bucket", "id", "n"])

    return run


def _likely(settings: Settings):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = settings.bands * settings.rows
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (np.frombuffer(b"".join(batch.column(k).to_pylist()), dtype=np.uint16).reshape(-1, m) for k in (2, 3))
            na, nb = (np.array(batch.column(k).to_pylist(), dtype=float) for k in (4, 5))
            ok = likely_similarity(a, b, na, nb) >= settings.percent / 100 - settings.slack
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(ok)), batch.column(1).filter(pa.array(ok))], ["a", "b"])

    return run


def _sets(settings: Settings):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, texts in text_blocks(batch):
                sets = shingle_sets(texts, settings.words)
                yield pa.RecordBatch.from_arrays([ids, pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["id", "shingles"])

    return run


def _verified(settings: Settings):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                s, t = (z.values.to_numpy().view(np.uint64) for z in (x, y))
                if len(s) > len(t):
                    s, t = t, s
                at = np.minimum(np.searchsorted(t, s), len(t) - 1)
                both = int((t[at] == s).sum())
                ok.append(100 * both >= settings.percent * (len(s) + len(t) - both))
            ok = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(ok), batch.column(1).filter(ok)], ["a", "b"])

    return run


def shingle_table(ids: DataFrame, docs: DataFrame, settings: Settings) -> DataFrame:
    """(id, shingles) of the documents with these ids, from their whole texts."""
    texts = docs.join(narrow(ids.select(F.col("id").alias("doc_id")), IDS_AT_ONCE), "doc_id", "left_semi").select("doc_id", "text")
    return materialise(texts.mapInArrow(_sets(settings), "id long, shingles array<bigint>"), "sets")


def confirm(pairs: DataFrame, classes: DataFrame, docs: DataFrame, settings: Settings) -> DataFrame:
    """Of candidate ``pairs`` (a, b) those that are links: first by the likelihood of their registers, then on full sets."""
    side = lambda x: classes.select(F.col("id").alias(x), F.col("regs").alias(f"regs_{x}"), F.col("n").alias(f"n_{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "regs_a", "regs_b", "n_a", "n_b")
    likely = materialise(both.mapInArrow(_likely(settings), "a long, b long"), "likely")
    need = materialise(likely.select(F.col("a").alias("id")).union(likely.select("b")).distinct(), "need")
    sets = shingle_table(need, docs, settings)
    side = lambda x: sets.select(F.col("id").alias(x), F.col("shingles").alias(f"set_{x}"))
    found = likely.join(side("a"), "a").join(side("b"), "b").select("a", "b", "set_a", "set_b").mapInArrow(_verified(settings), "a long, b long")
    return found.distinct()


def _compared(settings: Settings):
    def run(table: pa.Table) -> pa.Table:
        """Links of two blocks of a bucket (or within one), one for each pair of components they join."""
        ids, c, n, block = (table[k].to_numpy() for k in ("id", "c", "n", "block"))
        across = table["low"][0].as_py() != table["high"][0].as_py()
        sets = [x.values.to_numpy() for x in table["shingles"].combine_chunks()]
        flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        shared, at, held = np.unique(flat, return_inverse=True, return_counts=True)
        keep = held[at] > 1  # a shingle of one document counts in no intersection
        at, owner = (np.cumsum(held > 1) - 1)[at[keep]], owner[keep]
        order = np.argsort(at, kind="stable")
        at, owner = at[order], owner[order]
        both = np.zeros((len(sets), len(sets)), dtype=np.float32)
        for first in range(0, int((held > 1).sum()), COLUMNS):
            a, b = np.searchsorted(at, [first, first + COLUMNS])
            part = np.zeros((len(sets), COLUMNS), dtype=np.float32)
            part[owner[a:b], at[a:b] - first] = 1
            both += part @ part.T
        linked = 100 * both >= settings.percent * (n[:, None] + n[None, :] - both)
        linked &= (c[:, None] != c[None, :]) & (ids[:, None] > ids[None, :])
        if across:
            linked &= block[:, None] != block[None, :]
        parent: dict = {}

        def root(x):
            while parent.get(x, x) != x:
                x = parent[x]
            return x

        out: list[list] = [[], []]
        for i, j in zip(*np.nonzero(linked), strict=True):
            x, y = root(c[i]), root(c[j])
            if x != y:
                parent[max(x, y)] = min(x, y)
                out[0].append(int(ids[i]))
                out[1].append(int(ids[j]))
        return pa.table({"a": pa.array(out[0], pa.int64()), "b": pa.array(out[1], pa.int64())})

    return run


def open_links(told: DataFrame, classes: DataFrame, docs: DataFrame, settings: Settings) -> DataFrame:
    """Links (a, b) between different components within buckets.

    ``told``: bucket, id, n, c. A document with u shingles that no other open document holds shares at most n - u with
    any of them. Documents whose bound rules out even their bucket's smallest member leave before pairs are made. The
    comparison of a large bucket costs the square of what is left of it, dealt over tasks by pairs of blocks.
    """
    p = settings.percent

    def several(rows: DataFrame) -> DataFrame:
        heads = rows.groupBy("bucket").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.min("n").alias("n_min"), F.count(F.lit(1)).alias("members")).filter("low <> high")
        return rows.join(heads.select("bucket", "n_min", "members"), "bucket")

    open_ = materialise(several(told), "open")
    sets = shingle_table(materialise(open_.select("id").distinct(), "open_ids"), docs, settings)
    once = sets.select("id", F.explode("shingles").alias("shingle")).groupBy("shingle").agg(F.count(F.lit(1)).alias("held"), F.min("id").alias("id")).filter("held = 1")
    own = once.groupBy("id").agg(F.count(F.lit(1)).alias("u"))
    left = open_.join(own, "id", "left").select("bucket", "id", "n", "c", (F.col("n") - F.coalesce("u", F.lit(0))).alias("most"), "n_min")
    fits = lambda most, n, m: 100 * most >= p * (n + m - most)
    left = left.filter(fits(F.col("most"), F.col("n"), F.least(F.col("n_min"), F.col("n")))).drop("n_min")
    left = materialise(several(left).drop("n_min"), "left")

    few = left.filter(F.col("members") <= SMALL_BUCKET).drop("members")
    x, y = few.toDF("bucket", "a", "n_a", "c_a", "most_a"), few.toDF("bucket", "b", "n_b", "c_b", "most_b")
    can = (p * F.greatest("n_a", "n_b") <= 100 * F.least("n_a", "n_b")) & fits(F.least("most_a", "most_b"), F.col("n_a"), F.col("n_b"))
    pairs = x.join(y, "bucket").filter((F.col("a") > F.col("b")) & (F.col("c_a") != F.col("c_b")) & can).select("a", "b").distinct()
    found = confirm(materialise(pairs, "pairs"), classes, docs, settings)

    many = left.filter(F.col("members") > SMALL_BUCKET).withColumn("blocks", F.ceil(F.col("members") / BLOCK).cast("int"))
    many = many.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).join(sets, "id")
    with_each = many.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = with_each.select("bucket", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "id", "c", "n", "shingles")
    compared = dealt.groupBy("bucket", "low", "high").applyInArrow(_compared(settings), "a long, b long")
    return found.unionByName(compared)


def near_dedup(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs`` (doc_id, text).

    Null or blank texts have an empty set and link with nothing. doc_id identifies a row; rows that repeat one doc_id
    with one text come out alike, and rows of a null doc_id are components of their own with a null component_id.
    An empty table gives no rows.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    features = materialise(texts.mapInArrow(_features(settings), "doc_id long, n long, set_1 long, set_2 long, regs binary"), "features")
    same = ["n", "set_1", "set_2"]
    full = features.filter("n > 0 and doc_id is not null")
    least = materialise(full.groupBy(*same).agg(F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("members")), "least")
    regs = full.select(F.col("doc_id").alias("id"), *same, "regs")
    classes = materialise(regs.join(least.drop("members"), [*same, "id"]).dropDuplicates(["id", *same]).select("id", *same, "regs"), "classes")

    banded = materialise(classes.select("id", "n", "regs").mapInArrow(_bands(settings), "bucket long, id long, n long"), "bands")
    heads = banded.groupBy("bucket").agg(F.min("id").alias("head"), F.count(F.lit(1)).alias("members")).filter("members > 1").select("bucket", "head")
    shared = materialise(banded.join(heads, "bucket"), "shared")
    to_head = shared.filter("id <> head").select(F.col("id").alias("a"), F.col("head").alias("b")).distinct()
    links = materialise(confirm(to_head, classes, texts, settings), "links")
    labels = components(links)

    told = shared.join(labels, "id", "left").select("bucket", "id", "n", F.coalesce("component", "id").alias("c"))
    more = materialise(open_links(told, classes, texts, settings), "more")
    if more.limit(1).count():
        labels = merged(labels, more)

    named = least.join(labels, "id", "left").select(*same, "members", F.coalesce("component", "id").alias("component"))
    out = hot_join(features.select("doc_id", *same), named, same, "members")
    out = out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
