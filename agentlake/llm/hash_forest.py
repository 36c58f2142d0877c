"""Approximate nearest neighbours by a forest of hash strings.

A tree hashes a vector to a string: the vector is turned by the tree's random rotation, and the string names its
coordinates with their signs in falling order of magnitude. Vectors that share a long prefix point the same way, whatever
their length; for inner products data get one more component that brings all of them to the greatest norm. Strings are
64-bit keys whose prefixes are nodes of the tree.

A query descends all trees together: at each level its nodes' sizes are counted and summed, for the queries that have
enough company so far. It then ascends from its longest matches, in all trees at once, to the first level at which it has
enough candidates, at the root all rows. What is enough isn't guessed: a sample of queries is compared with all rows, and for
each level the fewest candidates are taken with which those of the sample that have as many find the share ``goal`` of their
true neighbours there, so the index is as good at every size, in dense places as in others. The
candidates of a node are met where its keys lie: nodes are dealt to groups, each group sorts its keys and solves each node
at once. Of equal vectors k + 1 ids are kept (the result can't hold more) and one query asks for all of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from agentlake.llm.shared import materialise, narrow, release_table
from agentlake.llm.words import tidy

#: Bits of a symbol and of a tree's number in a key.
SYMBOL, TREE = 7, 6
#: Vectors that are hashed or compared at once.
ROWS_AT_ONCE = 2048
#: Data and queries of one node that are solved together, data of a group of nodes, and nodes that are broadcast.
DATA_AT_ONCE, QUERIES_AT_ONCE, GROUP, MOST_NODES = 65_536, 4096, 65_536, 200_000
ROUND = 1e-9


@dataclass(frozen=True)
class Settings:
    """trees (at most 64) and the symbols of a string; axes: coordinates of a rotation (at most 64); goal: share of the
    true neighbours that the ``sample`` queries (those with the smallest hashes of their id) must find at a level."""

    trees: int = 56
    depth: int = 6
    axes: int = 64
    goal: float = 0.93
    sample: int = 200
    seed: int = 11


def rows_of(column: pa.Array | pa.ChunkedArray, dims: int, kind: str) -> np.ndarray:
    """Binary vectors as rows of doubles, shorter ones filled up with zeros."""
    each = column.to_pylist()
    size = np.fromiter(map(len, each), dtype=np.int64, count=len(each)) // np.dtype(kind).itemsize
    out = np.zeros((len(each), dims))
    out[np.arange(dims)[None, :] < size[:, None]] = np.frombuffer(b"".join(each), dtype=kind)
    return out


@tidy
def _clean(batches: Iterator[pa.RecordBatch], kind: str) -> Iterator[pa.RecordBatch]:
    """(vec_id, v, norm) of the vectors that take part."""
    for batch in batches:
        ids, vectors, norms = [], [], []
        edges = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(batch.column(1)), 0).to_numpy(zero_copy_only=False))])
        values = pc.fill_null(batch.column(1).flatten(), float("nan")).to_numpy(zero_copy_only=False)
        for vec_id, a, b in zip(batch.column(0).to_pylist(), edges[:-1], edges[1:], strict=True):
            x = values[a:b]
            peak = np.abs(x).max(initial=0.0) if vec_id is not None else 0.0
            if peak > 0 and np.isfinite(peak):
                ids.append(vec_id)
                vectors.append(x.astype(kind).tobytes())
                norms.append(float(peak) * float(np.linalg.norm(x / float(peak))))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(vectors, pa.binary()), pa.array(norms, pa.float64())], ["vec_id", "v", "norm"])


def rotations(dims: int, settings: Settings) -> list[np.ndarray]:
    """Of each tree, (dims + 1) rows and at most ``axes`` columns."""
    r = np.random.default_rng(settings.seed)
    return [np.linalg.qr(r.normal(size=(dims + 1, dims + 1)))[0][:, : settings.axes].copy() for _ in range(settings.trees)]


def strings(x: np.ndarray, turned: list[np.ndarray], depth: int) -> np.ndarray:
    """(rows, trees) keys: a leading bit, the tree's number, then its string's symbols, the first one highest."""
    out = np.empty((len(x), len(turned)), dtype=np.int64)
    for t, r in enumerate(turned):
        y = x @ r
        n = min(depth, y.shape[1])
        order = np.argsort(-np.abs(y), axis=1, kind="stable")[:, :n]
        symbol = 2 * order + (np.take_along_axis(y, order, axis=1) > 0)
        key = np.full(len(x), (1 << TREE) | t, dtype=np.int64)
        for level in range(depth):
            key = (key << SYMBOL) | (symbol[:, level] if level < n else 0)
        out[:, t] = key
    return out


@tidy
def _hashed(batches: Iterator[pa.RecordBatch], dims: int, kind: str, top: float, asked: bool, settings: Settings) -> Iterator[pa.RecordBatch]:
    """(vec_id, v, keys); data are brought to the norm ``top`` first."""
    turned = rotations(dims, settings)
    for batch in batches:
        for a in range(0, batch.num_rows, ROWS_AT_ONCE):
            part = batch.slice(a, ROWS_AT_ONCE)
            x = rows_of(part.column(1), dims, kind) / top
            more = np.zeros(len(x)) if asked else np.sqrt(np.maximum(0, 1 - (x * x).sum(axis=1)))
            keys = strings(np.concatenate([x, more[:, None]], axis=1), turned, settings.depth)
            edges = pa.array(np.arange(len(x) + 1, dtype=np.int32) * keys.shape[1])
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.ListArray.from_arrays(edges, pa.array(keys.ravel()))], ["vec_id", "v", "keys"])


def best(queries: np.ndarray, data: np.ndarray, ids: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query row, data rows, scores) of the k greatest inner products, ties to smaller ids. Scores are summed up in one
    order for every pair of vectors, so that equal vectors tie wherever they stand."""
    for a in range(0, len(queries), 256):
        some = queries[a : a + 256]
        rough = some @ data.T
        size = np.sqrt((some**2).sum(1)) * np.sqrt((data**2).sum(1).max(initial=0))
        for i, (score, slack) in enumerate(zip(rough, ROUND * size, strict=True)):
            at = np.arange(len(score)) if len(score) <= k else np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k] - slack)
            exact = (data[at] * some[i]).sum(axis=1)
            order = np.lexsort((ids[at], -exact))[:k]
            yield a + i, at[order], exact[order]


@tidy
def _compared(batches: Iterator[pa.RecordBatch], sample: tuple[np.ndarray, np.ndarray, np.ndarray], k: int, dims: int, kind: str, depth: int) -> Iterator[pa.RecordBatch]:
    """(query_id, vec_id, score, level): each batch's best for the sample, and the longest prefix that some tree shares."""
    ids, vectors, keys = sample
    for batch in batches:
        for a in range(0, batch.num_rows, ROWS_AT_ONCE):
            part = batch.slice(a, ROWS_AT_ONCE)
            near, held = part.column(0).to_numpy(), part.column(2).flatten().to_numpy().reshape(part.num_rows, -1)
            for i, at, score in best(vectors, rows_of(part.column(1), dims, kind), near, k + 1):
                other = near[at] != ids[i]
                at, score = at[other], score[other]
                level = np.zeros(len(at), dtype=np.int32)
                for n in range(1, depth + 1):
                    level += ((held[at] ^ keys[i]) >> (SYMBOL * (depth - n)) == 0).any(axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), ids[i])), pa.array(near[at]), pa.array(score), pa.array(level)], ["query_id", "vec_id", "score", "level"])


def _solved(left: pa.Table, right: pa.Table, k: int, dims: int, kind: str) -> pa.Table:
    """The k best of each query in each piece of a node of a group (query_id, v, piece) and (vec_id, v, piece)."""
    piece = right["piece"].to_numpy()
    order = np.argsort(piece, kind="stable")
    piece, right = piece[order], right.take(pa.array(order))
    asked = left["piece"].to_numpy()
    order = np.argsort(asked, kind="stable")
    asked, left = asked[order], left.take(pa.array(order))
    query_id, vec_id = left["query_id"].to_numpy(), right["vec_id"].to_numpy()
    out: list[list[np.ndarray]] = [[np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0)]]
    for p in np.unique(asked):
        a, b, c, d = (int(np.searchsorted(x, p, side)) for x in (asked, piece) for side in ("left", "right"))
        queries = rows_of(left["v"][a:b], dims, kind)
        for e in range(c, d, 8192):
            f = min(d, e + 8192)
            for i, at, score in best(queries, rows_of(right["v"][e:f], dims, kind), vec_id[e:f], k):
                for column, values in zip(out, (np.full(len(at), query_id[a + i]), vec_id[e:f][at], score), strict=True):
                    column.append(values)
    return pa.table([pa.array(np.concatenate(x)) for x in out], ["query_id", "vec_id", "score"])


@dataclass
class Forest:
    """data (vec_id, v, keys) and queries (query_id, v, keys), one for each distinct vector."""

    data: DataFrame
    queries: DataFrame
    asked: DataFrame
    dims: int
    kind: str
    settings: Settings

    def node(self, key: Column, level: Column | int) -> Column:
        shift = SYMBOL * (self.settings.depth - level) if isinstance(level, int) else SYMBOL * (F.lit(self.settings.depth) - level)
        return F.call_function("shiftright", key, shift if isinstance(shift, Column) else F.lit(shift))


def grow(vectors: DataFrame, k: int, every: int, settings: Settings) -> Forest | None:
    """The forest of all vectors and the queries among them; None without queries."""
    floats = vectors.schema["embedding"].dataType.elementType.typeName() == "float"
    kind = "<f4" if floats else "<f8"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>" if floats else "array<double>").alias("embedding"))
    plain = materialise(rows.mapInArrow(partial(_clean, kind=kind), "vec_id long, v binary, norm double"), "vectors")
    size = plain.agg(F.max(F.octet_length("v")).alias("bytes"), F.max("norm").alias("top"), F.count(F.when(F.col("vec_id") % every == 0, 1)).alias("asked")).first()
    if not size["asked"]:
        release_table(plain)
        return None
    own = plain
    if plain.groupBy("vec_id").count().filter("count > 1").limit(1).count():
        own = plain.groupBy("vec_id").agg(F.min("v").alias("v"))
    dims = size["bytes"] // np.dtype(kind).itemsize
    alike = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    kept = own.select("vec_id", "v").withColumn("n", alike).filter(F.col("n") <= k + 1).select("vec_id", "v")
    hashed = partial(_hashed, dims=dims, kind=kind, top=size["top"], settings=settings)
    data = materialise(kept.mapInArrow(partial(hashed, asked=False), "vec_id long, v binary, keys array<long>"), "forest")
    asked = materialise(own.filter(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "v"), "asked")
    release_table(plain)
    first = asked.groupBy("v").agg(F.min("query_id").alias("vec_id")).select("vec_id", "v")
    queries = materialise(first.mapInArrow(partial(hashed, asked=True), "vec_id long, v binary, keys array<long>").withColumnRenamed("vec_id", "query_id"), "queries")
    return Forest(data, queries, asked, dims, kind, settings)


def descend(forest: Forest, least: int) -> tuple[DataFrame, DataFrame]:
    """(query_id, level, total) of how many entries share a prefix with each query, and (node, n) of the nodes counted.

    A level at which no tree alone has ``least`` entries counts as empty: what several trees hold may be the same few.
    Only queries that have them are followed to the next level."""
    totals, nodes, alive = [], [], forest.queries.select("query_id", "keys")
    for level in range(1, forest.settings.depth + 1):
        at = alive.select("query_id", F.explode("keys").alias("key")).select("query_id", forest.node(F.col("key"), level).alias("node"))
        entries = forest.data.select(F.explode("keys").alias("key")).select(forest.node(F.col("key"), level).alias("node"))
        if level > 1:
            entries = entries.join(narrow(at.select("node").distinct(), MOST_NODES), "node", "left_semi")
        counted = materialise(entries.groupBy("node").agg(F.count(F.lit(1)).alias("n")), f"nodes{level}")
        total = materialise(at.join(counted, "node").groupBy("query_id").agg(F.lit(level).alias("level"), F.when(F.max("n") >= least, F.sum("n")).otherwise(0).alias("total")), f"totals{level}")
        nodes.append(counted)
        totals.append(total)
        alive = alive.join(total.filter(F.col("total") >= least).select("query_id"), "query_id", "left_semi")
        if not alive.limit(1).count():
            break
    united = lambda x: x[0] if len(x) == 1 else united([x[0].unionByName(x[1]), *x[2:]])
    return united(totals), united(nodes)


def enough(forest: Forest, totals: DataFrame, k: int) -> list[int | None]:
    """For each level from 1 on, with how many candidates a query may stop there; None where nothing in the sample says so."""
    settings = forest.settings
    sample = forest.queries.orderBy(F.xxhash64("query_id"), "query_id").limit(settings.sample).collect()  # ``sample`` rows
    ids = np.array([r["query_id"] for r in sample])
    vectors = rows_of(pa.array([bytes(r["v"]) for r in sample], pa.binary()), forest.dims, forest.kind)
    known = ids, vectors, np.array([r["keys"] for r in sample])
    near = forest.data.mapInArrow(partial(_compared, sample=known, k=k, dims=forest.dims, kind=forest.kind, depth=settings.depth), "query_id long, vec_id long, score double, level int")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    true: dict[int, list[int]] = {}
    for r in near.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "level").collect():  # k rows for each of the sample
        true.setdefault(r["query_id"], []).append(r["level"])
    held: dict[int, dict[int, int]] = {n: {} for n in range(1, settings.depth + 1)}
    for r in totals.filter(F.col("query_id").isin(ids.tolist())).collect():  # a row for each level of the sample
        held[r["level"]][r["query_id"]] = r["total"]
    return [_fewest([(total, true[q], level) for q, total in of.items() if total and q in true], k, settings.goal) for level, of in held.items()]


def _fewest(seen: list[tuple[int, list[int], int]], k: int, goal: float) -> int | None:
    """The least of k + 1, 2 (k + 1), 4 (k + 1) ... at which queries (total, levels of the true neighbours, level) with as many find ``goal``."""
    least = k + 1
    while some := [x for x in seen if x[0] >= least]:
        found = [at >= level for _, levels, level in some for at in levels]
        if sum(found) >= goal * len(found):
            return least
        least *= 2
    return None


def neighbours(vectors: DataFrame, k: int = 20, every: int = 20, settings: Settings = Settings()) -> DataFrame:  # noqa: B008
    """query_id, rank, vec_id, score: for each row whose vec_id is divisible by ``every`` the ``k`` nearest found.

    Nearness is the inner product in double precision; ties go to the smaller vec_id. Vectors (vec_id, embedding) that are
    null, zero, hold nulls or non-finite numbers or have a null id take no part; shorter ones count as filled up with zeros,
    very long ones count whole. Rows that repeat an id count as one (of different vectors the least in bytes), and a query
    never finds its own id. With fewer other vectors all are returned, without any the query has no row; an empty table
    gives no rows. Other columns are ignored, whatever their names.
    """
    spark = vectors.sparkSession
    forest = grow(vectors, k, every, settings)
    if forest is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    totals, nodes = descend(forest, k + 1)
    totals = materialise(totals, "totals")
    least = F.element_at(F.array(*(F.lit(n).cast("long") for n in enough(forest, totals, k))), F.col("level"))
    reached = totals.filter(F.col("total") >= least).groupBy("query_id").agg(F.max("level").alias("level"))
    at = forest.queries.join(reached, "query_id", "left").withColumn("level", F.coalesce("level", F.lit(0)))
    keys = F.when(F.col("level") == 0, F.slice("keys", 1, 1)).otherwise(F.col("keys"))  # the root is the first tree's
    at = materialise(at.select("query_id", "v", "level", F.explode(keys).alias("key")).select("query_id", "v", "level", forest.node(F.col("key"), F.col("level")).alias("node")), "stops")
    rows = spark.createDataFrame([(1 << TREE, forest.data.count())], "node long, n long")
    met = at.groupBy("node").agg(F.count(F.lit(1)).alias("asks"), F.first("level").alias("level")).join(nodes.unionByName(rows), "node")
    parts = lambda c, most: F.ceil(F.col(c) / most).cast("long")
    met = materialise(met.select("node", "level", "n", parts("n", DATA_AT_ONCE).alias("slices"), parts("asks", QUERIES_AT_ONCE).alias("blocks")), "met")
    told = met.agg(F.sum(F.col("n") * F.col("blocks")), F.collect_set("level")).first()
    groups = max(1, -(-(told[0] or 0) // GROUP))
    met = narrow(met.select("node", "slices", "blocks"), MOST_NODES)
    piece = F.xxhash64("node", "slice", "block")
    group = F.pmod("piece", F.lit(groups)).alias("g")
    each = F.array(*(forest.node(F.col("key"), int(n)) for n in sorted(told[1])))
    data = forest.data.select("vec_id", "v", F.explode("keys").alias("key")).select("vec_id", "v", F.explode(each).alias("node")).join(met, "node")
    data = data.withColumn("slice", F.pmod(F.xxhash64("vec_id"), "slices")).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    asks = at.join(met, "node").withColumn("block", F.pmod(F.xxhash64("query_id"), "blocks")).withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1)))
    data, asks = (x.withColumn("piece", piece).select(i, "v", "piece", group) for x, i in ((data, "vec_id"), (asks, "query_id")))
    solved = asks.groupBy("g").cogroup(data.groupBy("g")).applyInArrow(partial(_solved, k=k + 1, dims=forest.dims, kind=forest.kind), "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    top = solved.distinct().withColumn("n", rank).filter(F.col("n") <= k + 1)
    lists = top.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("less"), "vec_id"))).alias("found"))
    known = forest.queries.select("query_id", "v").join(lists, "query_id").select("v", "found")
    other = F.slice(F.filter("found", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    out = forest.asked.join(known, "v").select("query_id", F.posexplode(other).alias("rank", "x"))
    return out.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.less")).alias("score"))
