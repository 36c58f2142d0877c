"""Retrieval: keyword overlap, BM25, exact vectors, fusion, grep, read, list, highlights."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from agentlake.functions import text as tx
from agentlake.operators.order import narrow

#: Queries, documents and vectors that are searched together (they bound a task's memory).
QUERIES_AT_ONCE, DOCS_AT_ONCE, VECTORS_AT_ONCE = 512, 512, 8192
MOST_RESULTS, MOST_HITS, MOST_LINES, MOST_NAMES, MOST_CHARS = 20, 40, 400, 250, 32_000
K1, B = 1.5, 0.75


def top(df: DataFrame, group: str, order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k of each group with their rank (T-2); the limit is pushed below the shuffle."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(group).orderBy(*order))).filter(F.col(rank) <= min(max(k, 1), MOST_RESULTS))


def terms(c: Column) -> Column:
    """Distinct lower-case terms of 3 characters or more (R2)."""
    return F.filter(F.array_distinct(F.split(tx.collapse(F.lower(c)), " ")), lambda t: F.length(t) >= 3)


def _best(batches: Iterator[pa.RecordBatch], wanted: list[list[int]], patterns: list[str], k: int) -> Iterator[pa.RecordBatch]:
    """The k best documents (doc_id, low) of a part of the corpus for each query, given its terms as numbers of patterns."""
    import ahocorasick

    machine = ahocorasick.Automaton()
    for n, term in enumerate(patterns):
        machine.add_word(term, n)
    machine.make_automaton()
    weights = np.zeros((len(patterns), len(wanted)), dtype=np.float32)
    for q, terms_ in enumerate(wanted):
        weights[terms_, q] = 1
    sizes = np.array([len(x) for x in wanted])
    ids, hits = np.empty((0, len(wanted)), dtype=np.int64), np.empty((0, len(wanted)), dtype=np.int64)
    for batch in batches:
        for first in range(0, batch.num_rows, DOCS_AT_ONCE):
            part = batch.slice(first, DOCS_AT_ONCE)
            held = np.zeros((part.num_rows, len(patterns)), dtype=np.float32)
            for i, text in enumerate(part.column(1).to_pylist()):
                held[i, list({n for _, n in machine.iter(text or "")})] = 1
            new = np.rint(held @ weights).astype(np.int64)
            doc_ids = np.repeat(part.column(0).to_numpy()[:, None], len(wanted), axis=1)
            ids, hits = np.concatenate([ids, doc_ids]), np.concatenate([hits, new])
            order = np.lexsort((ids, -hits), axis=0)[:k]
            ids, hits = np.take_along_axis(ids, order, 0), np.take_along_axis(hits, order, 0)
    at, query = np.nonzero(hits > 0)
    yield pa.RecordBatch.from_arrays([pa.array(query), pa.array(ids[at, query]), pa.array(hits[at, query] / sizes[query])], ["query", "doc_id", "score"])


def keyword_rank(docs: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Share of a query's terms that a document holds as substrings; score > 0, ties in document order (R2, F8, T-2).

    docs: doc_id, text. queries: query_id, query, a stated set, taken in blocks; each distinct query is searched once (R9).
    One pass over a document finds all terms of a block of queries, and each task passes on the k best of each query only.
    """
    k = min(max(k, 1), MOST_RESULTS)
    asked = queries.withColumn("terms", terms(F.col("query"))).filter(F.size("terms") > 0)
    distinct = [(r["query"], r["terms"]) for r in asked.select("query", "terms").dropDuplicates(["query"]).orderBy("query").collect()]
    low = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lower("text").alias("low"))
    spark, found = docs.sparkSession, None
    for first in range(0, max(len(distinct), 1), QUERIES_AT_ONCE):
        block = distinct[first : first + QUERIES_AT_ONCE]
        numbers = {t: n for n, t in enumerate(dict.fromkeys(t for _, ts in block for t in ts))}
        wanted = [[numbers[t] for t in ts] for _, ts in block]
        named = spark.createDataFrame([(n, q) for n, (q, _) in enumerate(block)], "n long, query string")
        hits = low.mapInArrow(partial(_best, wanted=wanted, patterns=list(numbers), k=k), "n long, doc_id long, score double")
        part = hits.join(F.broadcast(named), "n").select("query", "doc_id", "score")
        found = part if found is None else found.unionByName(part)
    best = top(found, "query", [F.desc("score"), F.col("doc_id")], k)
    return best.join(asked.select("query_id", "query"), "query").select("query_id", "rank", "doc_id", "score")


def holding(docs: DataFrame, items: DataFrame, tokens: Callable[[Column], Column], inner: bool) -> DataFrame:
    """Candidates (item_id, doc_id, text, item) for items (item_id, item) that documents (doc_id, text) hold as a part.

    An item's rarest token is its key: it must be among the document's tokens, so only postings of the keys are joined.
    ``inner``: an item may begin and end within a word, so its first and last tokens don't count as keys. Items without
    a key meet every document; they are counted among the stated set.
    """
    parts = F.array_distinct(F.slice(tokens(F.col("item")), 2, F.greatest(F.size(tokens(F.col("item"))) - 2, F.lit(0))) if inner else tokens(F.col("item")))
    asked = items.select("item_id", "item", F.explode_outer(F.when(F.size(parts) > 0, parts)).alias("token"))
    wanted = narrow(asked.select("token").filter("token is not null").distinct(), 1_000_000)
    at = docs.select("doc_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("token")).join(wanted, "token", "left_semi")
    often = at.groupBy("token").agg(F.count(F.lit(1)).alias("held"))
    keys = asked.join(often, "token", "left").groupBy("item_id", "item").agg(F.min(F.struct(F.coalesce("held", F.lit(0)).alias("held"), "token")).alias("key"))
    keys = keys.select("item_id", "item", F.col("key.token").alias("token"))
    met = at.join(narrow(keys.filter("token is not null"), 100_000), "token").select("item_id", "item", "doc_id")
    met = met.join(docs.select("doc_id", "text"), "doc_id")
    rest = keys.filter("token is null").select("item_id", "item")
    if rest.limit(1).count():
        met = met.unionByName(docs.select("doc_id", "text").join(narrow(rest, 1000)).select("doc_id", "item_id", "item", "text"))
    return met.select("item_id", "doc_id", "text", "item")


def words(c: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"[a-z0-9]+"), F.lit(0))


def postings(docs: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """The inverted index: token, doc_id, tf, len; of ``wanted`` tokens (token) only, which then leave the scan alone."""
    at = docs.select("doc_id", words(F.col("text")).alias("w")).select("doc_id", F.size("w").alias("len"), F.explode("w").alias("token"))
    at = at if wanted is None else at.join(wanted, "token", "left_semi")
    return at.groupBy("token", "doc_id", "len").agg(F.count(F.lit(1)).alias("tf"))


def bm25(docs: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """BM25 top-k with score > 0 (R1): idf ln(1 + (N - df + 0.5) / (df + 0.5)), k1 1.5, b 0.75; ties by doc_id.

    The mean length is over documents with words. Only postings of the queries' tokens are grouped and shuffled.
    """
    size = F.size(words(F.col("text")))
    stats = docs.agg(F.count(F.lit(1)).alias("n"), F.avg(F.when(size > 0, size)).alias("mean"))  # a row
    asked = queries.select("query_id", F.explode(F.array_distinct(words(F.col("query")))).alias("token"))
    hits = postings(docs, narrow(asked.select("token").distinct(), 100_000))
    df = hits.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    weighed = hits.join(df, "token").join(F.broadcast(stats))
    idf = F.log1p((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("mean")))
    scores = weighed.withColumn("w", weight).join(asked, "token").groupBy("query_id", "doc_id").agg(F.round(F.sum("w"), 9).alias("score")).filter("score > 0")
    return top(scores, "query_id", [F.desc("score"), F.col("doc_id")], k).select("query_id", "rank", "doc_id", "score")


def _cosines(k: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        """The k best of a slice of vectors for a block of queries."""
        if not (left.num_rows and right.num_rows):
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        q, v = (np.array(t["embedding"].to_pylist(), dtype=float) for t in (left, right))
        ids = right["vec_id"].to_numpy()
        length = np.sqrt((q * q).sum(1))[:, None] * np.sqrt((v * v).sum(1))[None, :]
        with np.errstate(invalid="ignore", divide="ignore"):
            scores = np.round(np.where(length > 0, q @ v.T / length, -np.inf), 6)
        out: list[list] = [[], [], []]
        for i, asked in enumerate(left["vec_id"].to_pylist()):
            order = np.lexsort((ids, -scores[i]))[:k]
            order = order[np.isfinite(scores[i][order])]
            out[0] += [asked] * len(order)
            out[1] += ids[order].tolist()
            out[2] += scores[i][order].tolist()
        return pa.table({"query_id": pa.array(out[0], pa.int64()), "vec_id": pa.array(out[1], pa.int64()), "score": pa.array(out[2], pa.float64())})

    return run


def vector_top(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Exact cosine top-k of a query set (query_id, q) against all vectors (vec_id, embedding) (R6): blocks of queries by
    slices of vectors, whose lists are merged. Vectors of no length score nothing."""
    k = min(max(k, 1), MOST_RESULTS)
    blocks = max(1, -(-queries.count() // QUERIES_AT_ONCE))
    slices = max(1, -(-vectors.count() // VECTORS_AT_ONCE))
    number = lambda key, n, name: F.pmod(F.xxhash64(key), F.lit(n)).cast("int").alias(name)
    each = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    asked = queries.filter("q is not null").select(F.col("query_id").cast("long").alias("vec_id"), F.col("q").cast("array<double>").alias("embedding"), number("query_id", blocks, "block")).select("*", each(slices, "slice"))
    data = vectors.filter("embedding is not null").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), number("vec_id", slices, "slice")).select("*", each(blocks, "block"))
    found = asked.groupBy("block", "slice").cogroup(data.groupBy("block", "slice")).applyInArrow(_cosines(k), "query_id long, vec_id long, score double")
    return top(found, "query_id", [F.desc("score"), F.col("vec_id")], k).select("query_id", "rank", "vec_id", "score")


def fused(a: DataFrame, b: DataFrame, key: str, k: int, c: int = 60) -> DataFrame:
    """Reciprocal rank fusion of two rankings (R7): the sum of 1 / (c + rank)."""
    both = a.select("query_id", key, "rank").unionByName(b.select("query_id", key, "rank"))
    scores = both.groupBy("query_id", key).agg(F.round(F.sum(1.0 / (c + F.col("rank"))), 9).alias("score"))
    return top(scores, "query_id", [F.desc("score"), F.col(key)], k).select("query_id", "rank", key, "score")


def line_table(docs: DataFrame) -> DataFrame:
    """file_name, line_no (from 1), line of texts (file_name, text)."""
    at = docs.select("file_name", F.posexplode(tx.lines("text")).alias("pos", "line"))
    return at.select("file_name", (F.col("pos") + 1).alias("line_no"), "line")


def grep(lines: DataFrame, pattern: str, regex: bool = False, year: str | None = None, limit: int = MOST_HITS) -> DataFrame:
    """The first lines that match, by file and line (R4, F5, F6, T-4); case doesn't count."""
    if year:
        lines = lines.filter(F.contains("file_name", F.lit(f"_{year}_")))
    found = F.col("line").rlike("(?i)" + pattern) if regex else F.contains(F.lower("line"), F.lit(pattern.lower()))
    return lines.filter(found).orderBy("file_name", "line_no").limit(limit)


def bad_pattern(df: DataFrame, pattern: str) -> str | None:
    """What is wrong with a regular expression, as a value."""
    try:
        df.sparkSession.sparkContext._jvm.java.util.regex.Pattern.compile(pattern)
        return None
    except Exception as e:
        return f"Error: invalid regex: {str(e).splitlines()[0][:200]}"


def read_slice(lines: DataFrame, file_name: str, start: int, count: int) -> DataFrame:
    """Lines start .. start + count - 1, counted from 0; at most 400 (R5, T-5)."""
    start, count = max(start, 0), min(max(count, 1), MOST_LINES)
    return lines.filter((F.col("file_name") == file_name) & F.col("line_no").between(start + 1, start + count))


def list_names(docs: DataFrame, contains: str = "", limit: int = MOST_NAMES) -> DataFrame:
    """Distinct names in order (R5, T-6)."""
    return docs.filter(F.contains("file_name", F.lit(contains))).select("file_name").distinct().orderBy("file_name").limit(limit)


def article(passages: DataFrame, title: str) -> DataFrame:
    """Passages of an exact title, case aside, joined by line ends."""
    same = passages.filter(F.lower(tx.strip("title")) == F.lower(tx.strip(F.lit(title))))
    return same.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("id", "text"))), lambda p: p["text"]), "\n").alias("text"))


def search_text(results: DataFrame) -> DataFrame:
    """Result rows (query_id, rank, source, date, score, snippet) as the text a tool returns, clipped."""
    line = F.format_string("[%d] %s (%s)  score=%.2f\n    %s", "rank", "source", "date", "score", "snippet")
    rows = F.sort_array(F.collect_list(F.struct("rank", line.alias("line"))))
    return results.groupBy("query_id").agg(tx.clip(F.array_join(F.transform(rows, lambda r: r["line"]), "\n"), MOST_CHARS).alias("text"))
