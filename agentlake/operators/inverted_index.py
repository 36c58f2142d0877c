"""A kept inverted index for BM25, and a table of results already found.

Each load of documents is one table in the index's folder, bucketed by token. Its tasks cut their documents into segments of
bounded size; a row holds a token's postings in a segment: its documents in order with counts and lengths, and for every
block of documents the greatest count and the least length. Bucket -1 has a row for each segment with its numbers of
documents and words. What depends on the whole corpus (idf, mean length) is left to the search, so a load is only added.

A search reads the buckets of its tokens, deals their rows by segment and solves each segment at once. A block's greatest
count and least length bound what its documents can score for a token; blocks are scored from the greatest bound on, and
scoring stops at the first block whose bound is below the k-th score so far.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from agentlake.operators.order import materialise, narrow
from agentlake.operators.retrieval import K1, MOST_RESULTS, B, top, words

#: Words of a segment (a single longer document is one of its own), documents of a block, buckets of tokens.
SEGMENT_WORDS, BLOCK, BUCKETS = 2_000_000, 128, 64
#: Query tokens that are pushed into the scan; beyond, as many are broadcast to it.
PUSHED, BROADCAST = 1000, 100_000

#: n: postings. docs, tf, len: a posting each. block, at, most_tf, least_len: a block each, ``at`` its first posting.
POSTINGS = "token string, segment string, n int, docs array<long>, tf array<int>, len array<int>, block array<int>, at array<int>, most_tf array<int>, least_len array<int>"
NAMES = [c.split()[0] for c in POSTINGS.split(", ")]


@dataclass(frozen=True)
class Index:
    spark: SparkSession
    path: str

    def rows(self) -> DataFrame:
        return self.spark.read.schema(f"{POSTINGS}, load string, bucket int").parquet(self.path)

    def postings(self) -> DataFrame:
        return self.rows().filter("bucket >= 0")

    def segments(self) -> DataFrame:
        """segment, documents, with_words, n_words."""
        return self.rows().filter("bucket = -1").select("segment", *(F.col("docs")[i].alias(n) for i, n in enumerate(("documents", "with_words", "n_words"))))

    def version(self) -> str:
        """A name of what is loaded."""
        loads = sorted(r["load"] for r in self.rows().filter("bucket = -1").select("load").distinct().collect())  # a row for each load
        return hashlib.sha256(" ".join(loads).encode()).hexdigest()[:16]


def _segment(name: str, ids: np.ndarray, sizes: np.ndarray, tokens: pa.Array, of: int) -> Iterator[pa.RecordBatch]:
    """Postings of a segment's documents (``sizes`` tokens each, ``of`` to a block), in order of doc_id, then its own row."""
    order = np.argsort(ids, kind="stable")
    place = np.empty(len(ids), dtype=np.int64)
    place[order] = np.arange(len(ids))
    ids, counts = ids[order], [len(ids), int((sizes > 0).sum()), int(sizes.sum())]
    coded = tokens.dictionary_encode()
    pair, tf = np.unique(coded.indices.to_numpy().astype(np.int64) * len(ids) + np.repeat(place, sizes), return_counts=True)
    token, doc = np.divmod(pair, len(ids))
    length = sizes[order][doc]
    new = np.diff(token, prepend=-1) != 0
    entry = np.append(np.flatnonzero(new), len(pair))
    first = np.flatnonzero(new | (np.diff(doc // of, prepend=-1) != 0))
    block = np.searchsorted(first, entry)
    most, least = (np.maximum.reduceat(tf, first), np.minimum.reduceat(length, first)) if len(first) else (tf, length)
    at = first - np.repeat(entry[:-1], np.diff(block))
    n = np.diff(entry)
    for a in range(0, len(n), 20_000):
        b = min(a + 20_000, len(n))
        lists = lambda x, edges, kind, a=a, b=b: pa.ListArray.from_arrays(pa.array((edges[a : b + 1] - edges[a]).astype(np.int32)), pa.array(x[edges[a] : edges[b]].astype(kind)))
        each = [lists(ids[doc], entry, np.int64), lists(tf, entry, np.int32), lists(length, entry, np.int32), *(lists(x, block, np.int32) for x in (doc[first] // of, at, most, least))]
        yield pa.RecordBatch.from_arrays([coded.dictionary.take(pa.array(token[entry[a:b]])).cast(pa.string()), pa.array([name] * (b - a)), pa.array(n[a:b].astype(np.int32)), *each], NAMES)
    none = [pa.array([None], pa.list_(pa.int32()))] * 6
    yield pa.RecordBatch.from_arrays([pa.array([None], pa.string()), pa.array([name]), pa.array([0], pa.int32()), pa.array([counts], pa.list_(pa.int64())), *none], NAMES)


def _tokenised(batches: Iterator[pa.RecordBatch], load: str, most: int, block: int) -> Iterator[pa.RecordBatch]:
    """A task's documents (doc_id, part, words), cut into segments. Names follow from the load and the task's place in it,
    so a task that runs again makes the same ones."""
    held: list[pa.RecordBatch] = []
    made = total = 0

    def cut() -> Iterator[pa.RecordBatch]:
        sizes = np.concatenate([np.diff(b.column(2).offsets.to_numpy()) for b in held])
        ids, tokens = np.concatenate([b.column(0).to_numpy() for b in held]), pa.concat_arrays([b.column(2).flatten() for b in held])
        yield from _segment(f"{load}-{held[0].column(1)[0].as_py()}-{made}", ids, sizes, tokens, block)
        held.clear()

    for batch in batches:
        upto = np.cumsum(np.diff(batch.column(2).offsets.to_numpy()))
        a = 0
        while a < batch.num_rows:
            before = int(upto[a - 1]) if a else 0
            b = max(a + 1, int(np.searchsorted(upto, before + most - total, side="right")))
            held.append(batch.slice(a, b - a).take(pa.array(np.arange(b - a))))
            total, a = total + int(upto[b - 1]) - before, b
            if total >= most or b < batch.num_rows:
                yield from cut()
                made, total = made + 1, 0
    if held:
        yield from cut()


def append(spark: SparkSession, path: str, docs: DataFrame, segment_words: int = SEGMENT_WORDS, block: int = BLOCK) -> Index:
    """Add documents (doc_id, text) as a load; the first one makes the index. It counts once its table is committed.

    A null text has no words. A token of very many documents is written by several tasks, by ranges of segments.
    """
    load = uuid.uuid4().hex[:12]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.spark_partition_id().alias("part"), F.coalesce(words(F.col("text")), F.array().cast("array<string>")).alias("w"))
    made = rows.mapInArrow(partial(_tokenised, load=load, most=segment_words, block=block), POSTINGS).withColumn("bucket", F.when(F.col("token").isNull(), -1).otherwise(F.pmod(F.xxhash64("token"), F.lit(BUCKETS)).cast("int")))
    dealt = materialise(made, "postings").repartitionByRange("bucket", "token", "segment")  # kept, as ranges are found by a pass of their own
    dealt.sortWithinPartitions("bucket", "token", "segment").write.partitionBy("bucket").parquet(f"{path}/load={load}")
    return Index(spark, path)


def _scored(asked: pa.Table, postings: pa.Table, k: int, mean: float) -> pa.Table:
    """The k best documents of a segment for each query; asked: query_id, token, idf."""
    weigh = lambda tf, n: tf * (K1 + 1) / (tf + K1 * (1 - B + B * n / mean))
    held = {}
    for row in postings.select(["token", "docs", "tf", "len", "block", "at", "most_tf", "least_len"]).to_batches():
        for i in range(row.num_rows):
            docs, tf, n, block, at, most, least = (row.column(c)[i].values.to_numpy() for c in range(1, 8))
            held[row.column(0)[i].as_py()] = docs, weigh(tf, n), block, np.append(at, len(docs)), weigh(most, least)
    terms: dict[int, list[tuple]] = {}
    for q, t, idf in zip(*(asked[c].to_pylist() for c in ("query_id", "token", "idf")), strict=True):
        if t in held:
            terms.setdefault(q, []).append((idf, *held[t]))
    out: list[list] = [[], [], []]
    for q, parts in terms.items():
        ids, scores = _early(parts, k)
        out[0] += [q] * len(ids)
        out[1] += ids.tolist()
        out[2] += scores.tolist()
    return pa.table({"query_id": pa.array(out[0], pa.int64()), "doc_id": pa.array(out[1], pa.int64()), "score": pa.array(out[2], pa.float64())})


def _early(parts: list[tuple], k: int, step: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """The k best (doc_id, score) of a segment, its blocks taken from the greatest bound on, in growing steps."""
    blocks = np.unique(np.concatenate([p[3] for p in parts]))
    bound = np.zeros(len(blocks))
    for idf, _, _, block, _, most in parts:
        bound[np.searchsorted(blocks, block)] += idf * most
    order = np.argsort(-bound, kind="stable")
    ids, scores, a = np.empty(0, np.int64), np.empty(0), 0
    while a < len(order) and not (len(scores) >= k and bound[order[a]] + 1e-8 < scores[k - 1]):
        some = np.sort(blocks[order[a : a + step]])
        near, gain = [], []
        for idf, docs, weight, block, at, _ in parts:
            mine = np.flatnonzero(np.isin(block, some, assume_unique=True))
            times = at[mine + 1] - at[mine]
            where = np.arange(int(times.sum())) + np.repeat(at[mine] - (np.cumsum(times) - times), times)
            near.append(docs[where])
            gain.append(idf * weight[where])
        found, inverse = np.unique(np.concatenate(near), return_inverse=True)
        ids = np.concatenate([ids, found])
        scores = np.concatenate([scores, np.round(np.bincount(inverse, np.concatenate(gain), minlength=len(found)), 9)])
        best = np.lexsort((ids, -scores))[:k]
        ids, scores, a, step = ids[best], scores[best], a + step, step * 2
    return ids[scores > 0], scores[scores > 0]


def search(index: Index, queries: DataFrame, k: int) -> DataFrame:
    """query_id, rank, doc_id, score: what ``retrieval.bm25`` finds in all documents loaded.

    queries: query_id, query. A doc_id should be loaded once. Each segment meets only the queries that it has tokens of.
    """
    k = min(max(k, 1), MOST_RESULTS)
    asked = materialise(queries.select(F.col("query_id").cast("long").alias("query_id"), F.explode(F.array_distinct(words(F.col("query")))).alias("token")), "tokens")
    tokens = asked.select("token").distinct()
    bucket = F.pmod(F.xxhash64("token"), F.lit(BUCKETS)).cast("int")
    few = tokens.withColumn("bucket", bucket).limit(PUSHED + 1).collect()  # at most PUSHED + 1 rows
    if len(few) <= PUSHED:
        held = index.postings().filter(F.col("bucket").isin(sorted({r["bucket"] for r in few})) & F.col("token").isin(sorted(r["token"] for r in few)))
    else:
        held = index.postings().join(narrow(tokens, BROADCAST), "token", "left_semi")
    sums = index.segments().agg(F.sum("documents").alias("n"), F.sum("with_words").alias("w"), F.sum("n_words").alias("words")).first()
    df = held.groupBy("token").agg(F.sum("n").alias("df"))
    weighed = asked.join(df, "token").select("query_id", "token", F.log1p((F.lit(sums["n"] or 0) - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    met = weighed.join(held.select("token", F.col("segment").alias("part")), "token")
    mean = (sums["words"] or 0) / max(sums["w"] or 0, 1)
    found = met.groupBy("part").cogroup(held.groupBy("segment")).applyInArrow(partial(_scored, k=k, mean=mean), "query_id long, doc_id long, score double")
    return top(found, "query_id", [F.desc("score"), F.col("doc_id")], k).select("query_id", "rank", "doc_id", "score")


def cached(spark: SparkSession, path: str, queries: DataFrame, k: int, mode: str, version: str, run: Callable[[DataFrame, int], DataFrame]) -> DataFrame:
    """Results of queries (query_id, query) by way of a kept table keyed (mode, version, k, query).

    Only distinct queries that the table doesn't hold go to ``run`` (rows query_id, query; k), and their rows are added, a
    row without a document for one that found nothing. A version names what is searched, so a changed index asks anew.
    """
    at = f"{path}/mode={mode}/version={version}/k={k}"
    jvm = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    schema = "query string, rank int, doc_id long, score double"
    there = jvm.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(jvm)
    known = spark.read.schema(schema).parquet(at) if there else spark.createDataFrame([], schema)
    distinct = queries.select("query").filter("query is not null").distinct()
    fresh = materialise(distinct.join(known.select("query").distinct(), "query", "left_anti").withColumn("query_id", F.monotonically_increasing_id()), "misses")
    if fresh.limit(1).count():
        found = fresh.join(run(fresh.select("query_id", "query"), k), "query_id", "left").select("query", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
        found.write.mode("append").parquet(at)
        known = spark.read.schema(schema).parquet(at)
    return queries.join(known.filter("rank is not null").dropDuplicates(["query", "rank"]), "query").select("query_id", "rank", "doc_id", "score")
