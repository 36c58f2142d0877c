"""The queries of this subpackage, one for each operator, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from agentlake.llm import clustering, exact_dedup, hash_forest, html_text, line_dedup, mixing, near_dedup, packing, runs, sharding, topk, toxicity, url_filter


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_by_bytes(_table(spark, sf_dir, "documents"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_table(spark, sf_dir, "documents"))
    sources = mixed.sources.select("src", "source_size", "target")
    return mixed.taken().join(sources, "src").select("doc_id", "size", "source_size", "target", "taken")


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_table(spark, sf_dir, "pages"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.document_lines(_table(spark, sf_dir, "documents"))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_dedup(_table(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, _table(spark, sf_dir, "labels")))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(_table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts whose id's checksum ends in 0 are made periodic from a word on that the checksum names."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)
    n = F.when(h % 10 == 0, F.nullif(F.expr(r"regexp_count(text, '[^\\x20\\x09-\\x0D]+')"), F.lit(0)))
    from_word = g % n
    found = runs.word_runs(_table(spark, sf_dir, "documents"), repeat=(from_word, 1 + F.floor((n - from_word) / (3 + g % 8))))
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("least"), r["start"].alias("start"), r["period"].alias("period"))))
    length = -F.col("best.least")
    listed = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), length.alias("length"), F.col("best.period").alias("period"),
        F.floor(1000 * length / F.col("best.period")).alias("exponent_milli"), F.sha2(listed.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def op12_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = clustering.cluster(_table(spark, sf_dir, "embeddings"))
    named = F.sha2(F.array_join("centroid", ",").cast("binary"), 256).alias("centroid_sha256")
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", named)


def op13_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hash_forest.neighbours(_table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_topk": op2_topk,
    "op3_sharding": op3_sharding,
    "op4_mixing": op4_mixing,
    "op5_html_text": op5_html_text,
    "op6_line_dedup": op6_line_dedup,
    "op7_near_dedup": op7_near_dedup,
    "op8_packing": op8_packing,
    "op9_toxicity": op9_toxicity,
    "op10_url_filter": op10_url_filter,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_clustering": op12_clustering,
    "op13_neighbours": op13_neighbours,
}


def _lloyd_sql(k: int = 40, rounds: int = 5) -> str:
    """k-means round by round: a row for each component, all vectors compared with all centroids."""
    assign = """a{r} AS MATERIALIZED (SELECT vec_id, arg_min(c, [d, c]) AS c, min(d) AS d FROM
        (SELECT e.vec_id, m.c, sum((e.x - m.x) * (e.x - m.x))::BIGINT AS d FROM e JOIN m{r} m USING (dim) GROUP BY 1, 2) GROUP BY 1)"""
    move = """m{n} AS MATERIALIZED (SELECT m.c, m.dim, coalesce((s.x - ((s.x % s.n) + s.n) % s.n) // s.n, m.x)::BIGINT AS x FROM m{r} m LEFT JOIN
        (SELECT c, dim, sum(x)::BIGINT AS x, count(*) AS n FROM a{r} JOIN e USING (vec_id) GROUP BY 1, 2) s USING (c, dim))"""
    steps = [assign.format(r=0)]
    for r in range(rounds):
        steps += [move.format(r=r, n=r + 1), assign.format(r=r + 1)]
    return f"""
        WITH v AS (SELECT vec_id, embedding FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        e AS MATERIALIZED (SELECT vec_id, unnest(range(64)) AS dim, floor(256 * unnest(embedding)::DOUBLE)::BIGINT AS x FROM v),
        s AS (SELECT vec_id, row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS c FROM v),
        m0 AS MATERIALIZED (SELECT c::INT AS c, dim, x FROM s JOIN e USING (vec_id) WHERE c < {k}),
        {", ".join(steps)},
        h AS (SELECT c, sha256(string_agg(x::VARCHAR, ',' ORDER BY dim)) AS named FROM m{rounds} GROUP BY c)
        SELECT vec_id, c::INT AS cluster, d AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, named AS centroid_sha256
        FROM a{rounds} JOIN h USING (c)"""


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

ORACLE_SQL: dict[str, str] = {
    "op1_exact_dedup": f"""
        WITH n AS (SELECT doc_id, translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}') AS norm FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
        FROM n WINDOW w AS (PARTITION BY norm)""",
    "op2_topk": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
                   WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.vec_id AS query_id, d.vec_id, list_sum(list_transform(list_zip(q.v, d.v), lambda p: p[1] * p[2]))::BIGINT AS score
              FROM v q JOIN v d ON q.vec_id % 50 = 0 AND d.vec_id <> q.vec_id),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
    "op7_near_dedup": f"""
        WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
        s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
              ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS held FROM w),
        n AS (SELECT doc_id, len(held) AS n FROM s), e AS (SELECT doc_id, unnest(held) AS shingle FROM s),
        p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS m FROM e x JOIN e y ON x.shingle = y.shingle AND x.doc_id < y.doc_id GROUP BY 1, 2),
        l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * m >= 85 * (x.n + y.n - m)),
        links AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
        reached(id, other) AS (SELECT doc_id, doc_id FROM n UNION SELECT id, b FROM reached JOIN links ON a = other)
        SELECT doc_id, n AS n_shingles, min(other) AS component_id, doc_id = min(other) AS kept FROM n JOIN reached ON id = doc_id GROUP BY doc_id, n""",
    "op12_clustering": _lloyd_sql(),
    "op10_url_filter": f"""
        WITH rest AS (SELECT page_id, regexp_extract(coalesce(url, ''), '(?s)^.*?://(.*)$', 1) AS rest FROM pages),
        parts AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{_UPPER}', '{_LOWER}') AS host,
                         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
        rules(action, rhost, rpath) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'),
            ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
        best AS (SELECT page_id, arg_max(action, length(rhost || rpath)) AS action, arg_max(rhost || rpath, length(rhost || rpath)) AS rule
                 FROM parts, rules WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY page_id)
        SELECT p.page_id, host, path, rule, coalesce(action, CASE WHEN regexp_matches(host || path,
            '(?i)(?:^|[^\\p{{L}}\\p{{N}}])(cheap[^\\p{{L}}\\p{{N}}]pills|adult|free[^\\p{{L}}\\p{{N}}]bets|casino|porn|xxx|viagra|payday[^\\p{{L}}\\p{{N}}]loans)(?:[^\\p{{L}}\\p{{N}}]|$)')
            THEN 'block' ELSE 'allow' END) AS verdict
        FROM parts p LEFT JOIN best USING (page_id)""",
}
