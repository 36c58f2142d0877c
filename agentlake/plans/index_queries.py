"""Queries that search kept indexes and join by tolerance, over the driver's whole tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agentlake.functions import tokens
from agentlake.functions.register import register
from agentlake.operators import episodes, inverted_index, retrieval, tolerance, vector_index
from agentlake.operators.order import shared_dir
from agentlake.plans.queries import _BM25, _LINES, _NUM, _benchmark_queries, _files, query
from agentlake.sources import sinks
from agentlake.streaming import protocol


def _folder(df: DataFrame, name: str) -> str:
    return f"{shared_dir(df.sparkSession)}/agentlake/{uuid.uuid4().hex}/{name}"


@query(f"WITH {_BM25} SELECT query_id, rank, doc_id, round(score, 6) AS score FROM r WHERE rank <= 5")
def bm25_indexed(table):
    """The index of half of the documents, extended by the others, searched twice: the second time from kept results."""
    docs = table("documents")
    path = _folder(docs, "index")
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2))
    inverted_index.append(docs.sparkSession, path, docs.filter(half == 0))
    index = inverted_index.append(docs.sparkSession, path, docs.filter(half == 1))
    run = lambda queries, k: inverted_index.search(index, queries, k)
    asked, version = _benchmark_queries(table), index.version()
    kept = _folder(docs, "results")
    inverted_index.cached(docs.sparkSession, kept, asked, 5, "bm25", version, run)
    return inverted_index.cached(docs.sparkSession, kept, asked, 5, "bm25", version, run).withColumn("score", F.round("score", 6))


@query()
def vector_ann(table):
    """Cosine top 5 from an inverted file of cells; probes are fitted to find 95 % of a sample's neighbours."""
    vectors = table("embeddings")
    index = vector_index.build(vectors, _folder(vectors, "cells"))
    asked = vectors.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    return vector_index.search(index, asked, 5, vector_index.probes_for(index, asked, 5))


@query(f"""
WITH t AS (SELECT doc_id, generate_subscripts(ts, 1)::INT AS nth, unnest(ts) AS token FROM (SELECT doc_id, list_filter(regexp_extract_all(text, '{_NUM}'), lambda t:
      NOT (regexp_matches(t, '^\\d{{4}}$') AND t BETWEEN '1900' AND '2099') AND (regexp_matches(t, '[,.$]') OR regexp_matches(t, '^\\d{{3}}'))) AS ts FROM documents)),
c AS (SELECT doc_id, nth, translate(token, '$,', '')::DOUBLE AS value FROM t), d AS (SELECT DISTINCT value FROM c),
p AS (SELECT number, count(*) AS n FROM (SELECT translate(unnest(regexp_extract_all(html, '{_NUM}')), '$,', '')::DOUBLE AS number FROM pages) GROUP BY 1),
m AS (SELECT value, count(*) AS n_values, sum(n)::BIGINT AS n_mentions FROM d JOIN p ON len(list_filter([1.0::DOUBLE, 1e3, 1e-3, 1e6, 1e-6, 1e9, 1e-9], lambda s: number = value * s OR (value <> 0 AND abs(number - value * s) <= abs(value * s) * 1e-6))) > 0 GROUP BY 1)
SELECT doc_id, nth, value, coalesce(n_values, 0) AS n_values, coalesce(n_mentions, 0) AS n_mentions FROM c LEFT JOIN m USING (value)""")
def claims_supported(table):
    """Each number that a document claims, and how many numbers of pages it agrees with under seven scales, and how often those stand there."""
    claims = table("documents").select("doc_id", F.posexplode(episodes.claimed_numbers(F.col("text"))).alias("at", "value"))
    said = table("pages").select(F.explode(episodes.numbers(F.col("html"))).alias("number"))
    pairs = tolerance.near_pairs(claims, said, scales=episodes.SCALES).join(said.groupBy("number").agg(F.count(F.lit(1)).alias("n")), "number")
    found = pairs.groupBy("value").agg(F.count(F.lit(1)).alias("n_values"), F.sum("n").alias("n_mentions"))
    return claims.join(found, "value", "left").select("doc_id", (F.col("at") + 1).alias("nth"), "value", F.coalesce("n_values", F.lit(0)).alias("n_values"), F.coalesce("n_mentions", F.lit(0)).alias("n_mentions"))


_SUMMED = """
SELECT '{0}' AS name, count(*) AS rows, sha256(concat_ws(',', count(*), sum(('0x' || substr(h, 1, 16))::UBIGINT::HUGEINT), sum(('0x' || substr(h, 17, 16))::UBIGINT::HUGEINT), sum(('0x' || substr(h, 33, 16))::UBIGINT::HUGEINT), sum(('0x' || substr(h, 49, 16))::UBIGINT::HUGEINT))) AS sha256
FROM (SELECT sha256({1}::VARCHAR || chr(31) || coalesce({2}, '')) AS h FROM {0})"""


@query(" UNION ALL ".join(_SUMMED.format(*x) for x in (("documents", "doc_id", "text"), ("pages", "page_id", "html"))))
def tables_recorded(table):
    """Tables written with the record that their writing jobs observed."""
    out = []
    for name, key, text in (("documents", "doc_id", "text"), ("pages", "page_id", "html")):
        df = table(name)
        row = F.sha2(F.concat_ws("\x1f", F.col(key).cast("string"), F.coalesce(text, F.lit(""))), 256)
        record = sinks.write_recorded(df, _folder(df, name), name, row)
        out.append((record["name"], record["rows"], record["sha256"]))
    return df.sparkSession.createDataFrame(out, "name string, rows long, sha256 string")


@query("""
WITH e AS (SELECT *, max(turn) OVER (PARTITION BY conv_id) AS last, min(CASE WHEN role = 'assistant' THEN turn + 1 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS seen,
    coalesce(max(CASE WHEN role = 'assistant' THEN turn + 1 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS made,
    sum((role <> 'assistant')::INT) OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations),
o AS (SELECT conv_id, n::INT AS nth, made::INT AS made, seen::INT AS seen, text, 300 - length('[observation obs_' || n::INT || ']' || chr(10)) AS room FROM e WHERE role <> 'assistant')
SELECT conv_id::VARCHAR AS episode_id, nth, 'obs_' || nth AS observation_id, made AS generated_by_request, seen AS delivered_to_request,
  md5(CASE WHEN seen IS NULL THEN NULL WHEN length(text) > room THEN substr(text, 1, room - 14) || '...(truncated)' ELSE text END) AS delivered,
  EXISTS (SELECT 1 FROM conversations c WHERE c.conv_id = o.conv_id AND role = 'assistant') AS terminal_seen FROM o""")
def episodes_recorded(table):
    """Conversations replayed by the episode protocol: every observation and when it was delivered."""
    found = protocol.records(protocol.conversation_events(table("conversations")), 300)
    at = found.select("episode_id", "terminal_seen", F.explode("observations").alias("o"))
    return at.select("episode_id", F.col("o.order").alias("nth"), "o.observation_id", "o.generated_by_request", "o.delivered_to_request", F.md5("o.delivered_text").alias("delivered"), "terminal_seen")


def _by_sql(df: DataFrame, sql: str) -> DataFrame:
    """``sql`` over the view ``given`` with this engine's functions."""
    register(df.sparkSession)
    return df.sparkSession.sql(sql, given=df)


@query(f"WITH {_LINES} SELECT * FROM f WHERE contains(lower(line), 'licensed under') ORDER BY file_name, line_no LIMIT 40")
def grep_by_sql(table):
    lines = retrieval.line_table(_files(table))
    return _by_sql(lines, "SELECT * FROM grep_lines(TABLE(SELECT * FROM {given}), 'Licensed under') ORDER BY file_name, line_no LIMIT 40")


@query(f"WITH {_LINES} SELECT * FROM f WHERE file_name = 'doc_000000.txt' AND line_no BETWEEN 3 AND 12")
def read_by_sql(table):
    lines = retrieval.line_table(_files(table))
    return _by_sql(lines, "SELECT * FROM read_lines(TABLE(SELECT * FROM {given}), 'doc_000000.txt', 2, 10)")


@query("SELECT printf('doc_%06d.txt', doc_id) AS file_name FROM documents ORDER BY 1 LIMIT 250")
def list_by_sql(table):
    return _by_sql(_files(table), "SELECT * FROM list_names(TABLE(SELECT * FROM {given}), '.txt') ORDER BY file_name LIMIT 250")


@query("""
SELECT doc_id, round(len(list_filter(['licensed', 'version', 'for'], lambda t: contains(lower(coalesce(text, '')), t))) / 3::DOUBLE, 9) AS score
FROM documents WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 20""")
def search_by_sql(table):
    found = _by_sql(table("documents"), "SELECT * FROM search_docs(TABLE(SELECT * FROM {given}), 'Licensed version of for', 20) ORDER BY score DESC, doc_id LIMIT 20")
    return found.withColumn("score", F.round("score", 9))


@query()
def texts_cut_to_tokens(table):
    """Documents within 400 tokens, head and tail kept; a tokenizer is beyond SQL, the test encodes every result again."""
    cut = table("documents").select("doc_id", tokens.head_tail_tokens("text", "byte_bpe_50k.json", 400).alias("cut"))
    return cut.select("doc_id", "cut.text", "cut.omitted")
