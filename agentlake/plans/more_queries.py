"""Queries of the operators that ``queries`` doesn't call, over the driver's whole tables, with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from agentlake.functions import numbers
from agentlake.functions import text as tx
from agentlake.operators import corpus, evals, paired, prep, retrieval, traces
from agentlake.plans.queries import _WS, _collapse, _normal, query

_STRIP = lambda x: f"regexp_replace(regexp_replace({x}, '^{_WS}+', ''), '{_WS}+$', '')"

# --- text ---


@query(f"""
WITH t AS (SELECT conv_id, turn, '<answer>' || role || '</answer> x <ANSWER>' || chr(10) || text || ' </Answer> <tool_call><tool_call>' AS s FROM conversations)
SELECT conv_id, turn, md5({_STRIP("list_extract(regexp_extract_all(s, '(?is)<answer>(.*?)</answer>', 1), -1)")}) AS answer, (length(s) - length(replace(s, '<tool_call>', ''))) // 11 AS calls FROM t""")
def last_answer_block(table):
    s = F.concat(F.lit("<answer>"), "role", F.lit("</answer> x <ANSWER>\n"), "text", F.lit(" </Answer> <tool_call><tool_call>"))
    rows = table("conversations").select("conv_id", "turn", s.alias("s"))
    return rows.select("conv_id", "turn", F.md5(tx.last_answer("s")).alias("answer"), F.regexp_count("s", F.lit("<tool_call>")).cast("long").alias("calls"))


@query(f"""
WITH a AS (SELECT conv_id, turn, role = 'assistant' AS has, {_normal("regexp_extract(text, '^[^,.]*', 0)")} AS p, {_normal("regexp_extract(text, '^[^.]*', 0)")} AS g, {_normal("text")} AS hay FROM conversations),
b AS (SELECT *, p = g AS em, g <> '' AND contains(p, g) AS cover, g <> '' AND contains(' ' || hay || ' ', ' ' || g || ' ') AS surfaced FROM a)
SELECT conv_id, turn, round(CASE WHEN has AND em THEN 1.0 WHEN has THEN 0.1 + (CASE WHEN surfaced THEN 0.2 ELSE 0 END) ELSE (CASE WHEN surfaced THEN 0.2 ELSE 0 END) END, 9)::DOUBLE AS score,
  (has AND em)::INT::DOUBLE AS em, (has AND cover)::INT::DOUBLE AS cover_em, has::INT::DOUBLE AS has_answer, surfaced::INT::DOUBLE AS gold_retrieved, 1.0::DOUBLE AS num_gold, 1.0::DOUBLE AS n_tool_calls FROM b""")
def segment_scores(table):
    said = F.when(F.col("role") == "assistant", F.concat(F.lit("<tool_call> <answer>"), F.regexp_extract("text", "^[^,.]*", 0), F.lit("</answer>"))).otherwise("<tool_call> none")
    s = tx.score_segments(said, F.array("text"), F.array(F.regexp_extract("text", "^[^.]*", 0)), 0.1, 0.2)
    out = table("conversations").select("conv_id", "turn", s.alias("s")).select("conv_id", "turn", "s.*")
    return out.withColumn("score", F.round("score", 9)).select("conv_id", "turn", "score", "em", "cover_em", "has_answer", "gold_retrieved", "num_gold", "n_tool_calls")


@query("""
SELECT doc_id, md5(CASE WHEN length(text) > 100 THEN substr(text, 1, 100) || chr(10) || '... [truncated]' ELSE text END) AS clipped, md5(CASE WHEN length(text) > 600 THEN substr(text, 1, 600) || '...' ELSE text END) AS snippet,
  md5(CASE WHEN length(text) > 100 THEN substr(text, 1, 30) || chr(10) || '... [' || (length(text) - 100)::VARCHAR || ' characters omitted] ...' || chr(10) || right(text, 70) ELSE text END) AS cut FROM documents""")
def clipped_texts(table):
    return table("documents").select("doc_id", F.md5(tx.clip("text", 100)).alias("clipped"), F.md5(tx.snippet("text")).alias("snippet"), F.md5(tx.head_tail("text", 100)).alias("cut"))


@query("""
WITH n AS (SELECT doc_id, source, lang, source || '_' || (1990 + doc_id % 40)::VARCHAR || '_' || lpad((1 + doc_id % 12)::VARCHAR, 2, '0') AS stem, text FROM documents)
SELECT doc_id, stem || '.txt' AS name, CASE WHEN doc_id % 3 = 0 THEN '' ELSE (1990 + doc_id % 40)::VARCHAR || '-' || lpad((1 + doc_id % 12)::VARCHAR, 2, '0') END AS month, regexp_replace(stem || '/' || lang || ' é', '[^A-Za-z0-9\\-_.]', '_', 'g') AS safe,
  md5('Document: ' || stem || chr(10) || (CASE WHEN doc_id % 2 = 0 THEN 'Section: ' || lang || chr(10) ELSE '' END) || chr(10) || text) AS chunk FROM n""")
def file_names(table):
    stem = F.concat("source", F.lit("_"), (1990 + F.col("doc_id") % 40).cast("string"), F.lit("_"), F.lpad((1 + F.col("doc_id") % 12).cast("string"), 2, "0"))
    rows = table("documents").withColumn("stem", stem)
    return rows.select(
        "doc_id", tx.text_name(F.concat(F.lit(" /a/b/"), "stem", F.when(F.col("doc_id") % 2 == 0, ".txt").otherwise(""))).alias("name"), tx.file_month(F.when(F.col("doc_id") % 3 != 0, F.col("stem")).otherwise("x")).alias("month"),
        tx.safe_name(F.concat("stem", F.lit("/"), "lang", F.lit(" é"))).alias("safe"), F.md5(tx.with_context(F.col("text"), F.col("stem"), F.lit(""), F.when(F.col("doc_id") % 2 == 0, F.col("lang")))).alias("chunk"),
    )


@query("""
WITH e AS (SELECT event_id, event_type, CASE event_id % 8 WHEN 0 THEN NULL WHEN 1 THEN 408 WHEN 2 THEN 429 WHEN 3 THEN 500 WHEN 4 THEN 404 WHEN 5 THEN 504 WHEN 6 THEN 425 ELSE 503 END AS status FROM events)
SELECT event_id, CASE event_type WHEN 'error' THEN 'error' WHEN 'view' THEN 'empty' WHEN 'click' THEN 'empty' ELSE 'ok' END AS outcome,
  CASE WHEN status IS NULL THEN 'connection' WHEN status IN (408, 504) THEN 'timeout' WHEN status = 429 THEN 'rate_limit' WHEN status >= 500 THEN 'server' ELSE 'request' END AS kind, status IS NULL OR status IN (408, 409, 425, 429) OR status >= 500 AS retryable,
  CASE event_id % 4 WHEN 0 THEN 'UNKNOWN' WHEN 1 THEN 'QWEN_XML' WHEN 2 THEN 'HERMES_JSON' ELSE 'OTHER' END AS format,
  CASE WHEN event_id % 3 = 0 THEN event_id::INT ELSE -7 END AS number FROM e""")
def tool_calls_read(table):
    n = F.col("event_id")
    said = F.when(F.col("event_type") == "error", " Error: no").when(F.col("event_type") == "view", "No matching documents found").when(F.col("event_type") == "click", " \n\t").otherwise("Now found")
    picks = [None, 408, 429, 500, 404, 504, 425, 503]
    status = F.element_at(F.array(*(F.lit(x).cast("int") for x in picks)), (n % 8 + 1).cast("int"))
    call = F.when(n % 4 == 0, " \n").when(n % 4 == 1, "a <function=read>").when(n % 4 == 2, '<tool_call>\n{"name": 1}').otherwise("read(1)")
    number = F.when(n % 3 == 0, F.concat(F.lit(" "), n.cast("string"), F.lit("\n"))).when(n % 3 == 1, "x1").otherwise("99999999999")
    return table("events").select("event_id", tx.tool_outcome(said).alias("outcome"), tx.http_class(status).alias("h"), tx.tool_format(call).alias("format"), tx.coerce_int(number, -7).alias("number")).select(
        "event_id", "outcome", "h.kind", "h.retryable", "format", "number"
    )


@query("""
WITH l AS (SELECT o_custkey, o_orderkey, o_orderpriority || ' ' || o_orderkey::VARCHAR AS title, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders)
SELECT o_custkey, count(*) AS n, md5(string_agg(title, '|' ORDER BY o_orderkey)) AS titles, count(*) FILTER (r % 2 = 1) AS kept FROM l GROUP BY 1""")
def titles_read(table):
    """Titles out of result lists, and results that aren't errors."""
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    title = F.concat_ws(" ", "o_orderpriority", "o_orderkey")
    rows = table("orders").withColumn("r", F.row_number().over(w)).withColumn("line", F.concat(F.lit("["), "r", F.lit("] "), title, F.when(F.col("r") % 2 == 1, "  score=0.5").otherwise("")))
    each = F.struct("r", "line", F.struct(F.lit("read").alias("name"), F.when(F.col("r") % 2 == 1, "fine").otherwise("Error: x").alias("result")).alias("call"))
    listed = rows.groupBy("o_custkey").agg(F.sort_array(F.collect_list(each)).alias("x"))
    titles = tx.surfaced_titles(F.array_join(F.transform("x", lambda x: F.concat(x["line"], F.lit("\nbody"))), "\n"))
    return listed.select("o_custkey", F.size(titles).cast("long").alias("n"), F.md5(F.array_join(titles, "|")).alias("titles"), F.size(tx.tool_outputs(F.transform("x", lambda x: x["call"]))).cast("long").alias("kept"))


@query("""
WITH d AS (SELECT doc_id, lang, source FROM documents)
SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN lang || '|' || source WHEN 1 THEN source WHEN 2 THEN lang WHEN 3 THEN source ELSE '' END AS golds, CASE WHEN doc_id % 2 = 0 THEN lang ELSE source END AS present,
  CASE doc_id % 3 WHEN 0 THEN 'image,text,image' WHEN 1 THEN 'text' ELSE 'text,image,text' END AS parts FROM d""")
def shapes_read(table):
    """Gold answers of any JSON shape, the first column that says something, prompts with images."""
    n, q = F.col("doc_id"), lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    gold = F.when(n % 5 == 0, F.concat(F.lit("["), q("lang"), F.lit(', " ", '), q("source"), F.lit("]"))).when(n % 5 == 1, F.concat(F.lit('{"target": '), q("source"), F.lit("}"))).when(n % 5 == 2, F.concat(F.lit('{"answers": ["", '), q("lang"), F.lit("]}")))
    gold = gold.when(n % 5 == 3, q("source")).otherwise("{}")
    prompt = F.when(n % 3 == 0, "<image>what<image>").when(n % 3 == 1, F.col("lang")).otherwise("see <image>this")
    return table("documents").select(
        "doc_id", F.array_join(tx.gold_list(F.parse_json(gold)), "|").alias("golds"), tx.first_present([F.when(n % 2 == 0, F.lit("")), F.when(n % 2 == 0, F.col("lang")), F.col("source")]).alias("present"),
        F.array_join(F.transform(tx.image_parts(prompt), lambda p: p["type"]), ",").alias("parts"),
    )


# --- question sets ---


@query(f"""
WITH l AS (SELECT doc_id, quality, toxic, regexp_extract(text, '^[^ ]*', 0) AS w, lang FROM labels JOIN documents USING (doc_id)),
g AS (SELECT doc_id, quality, toxic, lang, list_filter([{_STRIP("w")}, {_STRIP("lower(w)")}], lambda x: x <> '') AS ws FROM l)
SELECT doc_id AS id, CASE WHEN toxic = 1 THEN 'unanswerable' WHEN quality = 0 AND doc_id % 2 = 0 THEN 'no question' WHEN len(ws) = 0 THEN 'no answer' ELSE 'kept' END AS reason, CASE WHEN doc_id % 3 = 0 THEN '' ELSE (doc_id % 3)::VARCHAR || 'hop' END AS hop_type,
  len(CASE WHEN len(ws) = 2 AND lower(ws[1]) = lower(ws[2]) THEN ws[1:1] ELSE ws END)::INT AS n_answers FROM g""")
def multi_hop_questions(table):
    rows = table("labels").join(table("documents").select("doc_id", "text", "lang"), "doc_id").withColumn("w", F.regexp_extract("text", "^[^ ]*", 0))
    asked = F.when((F.col("quality") == 0) & (F.col("doc_id") % 2 == 0), F.lit(" \n")).otherwise(F.col("lang"))
    hops = F.slice(F.array(F.lit("a"), F.lit("b")), 1, (F.col("doc_id") % 3).cast("int"))
    rows = rows.select(F.col("doc_id").alias("id"), asked.alias("question"), F.col("w").alias("answer"), F.array(F.lower("w")).alias("answer_aliases"), F.when(F.col("toxic") == 1, F.lit(False)).when(F.col("quality") == 1, F.lit(True)).alias("answerable"), hops.alias("question_decomposition"))
    return prep.multi_hop_rows(rows).select("id", F.coalesce("drop_reason", F.lit("kept")).alias("reason"), "hop_type", F.size("answers").alias("n_answers"))


@query("""
SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN p_size::VARCHAR WHEN 2 THEN replace((p_size * 1000)::VARCHAR, ',', '') ELSE 'x^{' || p_size::VARCHAR || '}' END AS gold,
  p_size::INT AS level_number, p_partkey % 4 <> 0 AND p_size BETWEEN 10 AND 30 AS keep FROM part""")
def math_questions(table):
    n, size = F.col("p_partkey"), F.col("p_size").cast("string")
    solution = F.when(n % 4 == 0, F.concat(F.lit("it is "), size)).when(n % 4 == 1, F.concat(F.lit("#### 5 so \\boxed{1} or \\boxed {"), size, F.lit("}."))).when(n % 4 == 2, F.concat(F.lit("sum\n#### "), size, F.lit(",000"))).otherwise(F.concat(F.lit("\\fbox{x^{"), size, F.lit("}}")))
    rows = table("part").select("p_partkey", F.concat(F.lit("Level "), size).alias("level"), solution.alias("solution"))
    return prep.math_rows(rows, range(10, 31)).select("p_partkey", "gold", "level_number", "keep")


@query("""
WITH u AS (SELECT 0 AS source_order, c_custkey AS id, c_name AS name FROM customer UNION ALL SELECT 1, s_suppkey, s_name FROM supplier)
SELECT row_number() OVER (ORDER BY source_order, id) - 1 AS index, source_order::INT AS source_order, id, name, CASE source_order WHEN 0 THEN 'c' ELSE 's' END || ':' || id::VARCHAR AS key FROM u""")
def sources_united(table):
    a = table("customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.lit("c").alias("source"))
    b = table("supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.lit("s").alias("source"))
    return prep.reindexed([a, b], "id").select("index", "source_order", "id", "name", prep.stable_key(F.col("source"), F.col("id")).alias("key"))


@query("""
SELECT doc_id::VARCHAR || '#' || sample::VARCHAR AS uid, doc_id::VARCHAR AS "group", sample::INT AS sample FROM labels, (SELECT unnest(range(4)) AS sample)""")
def samples_replicated(table):
    return prep.replicated(table("labels").select(F.col("doc_id").cast("string").alias("uid")), 4).select("uid", "group", "sample")


@query("""
WITH ids AS (SELECT doc_id * 2 AS id, row_number() OVER (ORDER BY doc_id DESC) - 1 AS pos FROM labels)
SELECT id, pos, lang, lang IS NOT NULL AS found FROM ids LEFT JOIN documents ON doc_id = id""")
def rows_by_id_list(table):
    from agentlake.operators.order import global_index

    ids = global_index(table("labels").select((F.col("doc_id") * 2).alias("id"), (-F.col("doc_id")).alias("down")), ["down"], "pos").select("id", "pos")
    return prep.by_id_list(table("documents").select("doc_id", "lang"), ids, "doc_id").select("id", "pos", "lang", "found")


@query("SELECT text_md5, n, min(doc_id) AS first FROM (SELECT md5(text) AS text_md5, doc_id, count(*) OVER (PARTITION BY md5(text)) AS n FROM documents) WHERE n > 1 GROUP BY ALL")
def repeated_texts(table):
    rows = table("documents").select(F.md5("text").alias("text_md5"), "doc_id")
    found = prep.repeated(rows, "text_md5").withColumnRenamed("count", "n")
    return rows.join(found, "text_md5").groupBy("text_md5", "n").agg(F.min("doc_id").alias("first"))


@query("""
SELECT coalesce(c_custkey, l_suppkey) AS id, CASE WHEN l_suppkey IS NULL THEN 'a' ELSE 'b' END AS side FROM customer
FULL JOIN (SELECT DISTINCT l_suppkey FROM lineitem) b ON c_custkey = l_suppkey WHERE c_custkey IS NULL OR l_suppkey IS NULL""")
def ids_on_one_side(table):
    return prep.unequal_ids(table("customer").select(F.col("c_custkey").alias("id")), table("lineitem").select(F.col("l_suppkey").alias("id")), "id")


@query("""
WITH c AS (SELECT quality, toxic, count(*) AS n FROM labels GROUP BY 1, 2), w AS (SELECT * FROM (VALUES (0, 0, 113), (1, 0, 133), (1, 2, 5), (0, 1, 0)) t(quality, toxic, wanted))
SELECT quality, toxic, coalesce(n, 0) AS n, coalesce(wanted, 0)::BIGINT AS wanted FROM c FULL JOIN w USING (quality, toxic) WHERE coalesce(n, 0) <> coalesce(wanted, 0)""")
def class_counts(table):
    labels = table("labels").select("quality", "toxic")
    wanted = labels.sparkSession.createDataFrame([(0, 0, 113), (1, 0, 133), (1, 2, 5), (0, 1, 0)], "quality int, toxic int, wanted int")
    return prep.unexpected_counts(labels.select(F.col("quality").cast("int").alias("quality"), F.col("toxic").cast("int").alias("toxic")), wanted, ["quality", "toxic"])


@query("SELECT n_name FROM (SELECT n_name, row_number() OVER (ORDER BY length(n_name), n_name) AS r FROM nation) WHERE r <= 10")
def shortest_first(table):
    return table("nation").orderBy(*prep.length_order("n_name")).limit(10).select("n_name")


@query("""
SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_orderpriority || '/global_step_' || (o_orderkey % 7)::VARCHAR WHEN o_orderstatus = 'O' THEN o_clerk ELSE o_orderpriority END AS label FROM
(SELECT o_orderkey, o_orderstatus, o_orderpriority, 'c' || o_custkey::VARCHAR AS o_clerk FROM orders)""")
def model_labels(table):
    o = table("orders").withColumn("clerk", F.concat(F.lit("c"), F.col("o_custkey").cast("string")))
    run, step = F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority")), F.col("o_orderkey") % 7
    return o.select("o_orderkey", prep.model_label(run, step, F.when(F.col("o_orderstatus") == "O", F.col("clerk")), F.lit(""), F.col("o_orderpriority")).alias("label"))


@query("""
SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'a,k,samples_per_question' ELSE 'k,samples_per_question' END AS names, CASE WHEN c_custkey % 3 = 0 THEN '1' ELSE '4' END AS samples,
  CASE WHEN c_custkey % 3 = 0 THEN 'a,samples_per_question' ELSE '' END AS differ, 'k,samples_per_question' AS public FROM customer""")
def policies(table):
    k = F.col("c_custkey")
    given = F.when(k % 3 == 0, F.create_map(F.lit("k"), F.lit("x"), F.lit("a"), F.lit("y"))).otherwise(F.create_map(F.lit("k"), F.lit("x"), F.lit("samples_per_question"), F.lit("4")))
    rows = table("customer").select("c_custkey", prep.filled_policy(given).alias("p"))
    fixed = F.create_map(F.lit("k"), F.lit("x"), F.lit("samples_per_question"), F.lit("4"))
    public = prep.without_credentials(F.map_concat(fixed, F.create_map(F.lit("hf_token"), F.lit("s"), F.lit("API_KEY"), F.lit("t"))))
    return rows.select("c_custkey", F.array_join(F.array_sort(F.map_keys("p")), ",").alias("names"), F.col("p")["samples_per_question"].alias("samples"), F.array_join(prep.map_difference(F.col("p"), fixed), ",").alias("differ"), F.array_join(F.array_sort(F.map_keys(public)), ",").alias("public"))


@query("""
SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN '' ELSE 'missing' END AS missing, CASE WHEN p_size % 3 = 0 THEN 'x' ELSE '' END AS unknown,
  CASE WHEN p_size % 4 = 0 THEN '' ELSE 'p_size % four' END AS indivisible, p_size % 2 = 0 AS safe FROM part""")
def arguments_checked(table):
    size = F.col("p_size")
    args = F.map_concat(F.create_map(F.lit("query"), F.lit("q")), F.when(size % 2 == 0, F.create_map(F.lit("k"), F.lit("1"))).otherwise(F.create_map().cast("map<string,string>")), F.when(size % 3 == 0, F.create_map(F.lit("x"), F.lit("1"))).otherwise(F.create_map().cast("map<string,string>")))
    rows = prep.indivisible(table("part").withColumn("four", F.lit(4)), [("p_size", "four")]).withColumn("a", prep.argument_problems(args, ["query", "k"], ["query", "k"]))
    name = F.when(size % 2 == 0, "cat.sch_1.tab").otherwise("1cat.tab; drop")
    return rows.select("p_partkey", F.when(F.size("a.missing") > 0, "missing").otherwise("").alias("missing"), F.array_join("a.unknown", ",").alias("unknown"), F.array_join("indivisible", ",").alias("indivisible"), prep.safe_identifier(name).alias("safe"))


@query("""
WITH k AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'rows' WHEN 1 THEN 'rate' WHEN 2 THEN 'mode' ELSE 'other' END AS name, p_size FROM part)
SELECT 'p' || p_partkey::VARCHAR AS id, CASE WHEN name = 'other' THEN 'unknown' WHEN name = 'rows' AND p_size NOT BETWEEN 5 AND 40 THEN 'out of bounds' WHEN name = 'rate' AND p_size > 25 THEN 'out of bounds' ELSE 'not a choice' END AS problem
FROM k WHERE name = 'other' OR (name = 'rows' AND p_size NOT BETWEEN 5 AND 40) OR (name = 'rate' AND p_size > 25) OR (name = 'mode' AND p_size % 2 = 1)""")
def knobs_checked(table):
    n = F.col("p_partkey")
    rules = [("int", 5.0, 40.0, None), ("float", 0.0, 25.0, None), ("enum", None, None, ["even"])]
    names = table("part").select(F.concat(F.lit("p"), n.cast("string")).alias("name"), n, F.when(n % 4 == 2, F.when(F.col("p_size") % 2 == 0, "even").otherwise("odd")).otherwise(F.col("p_size").cast("string")).alias("value"))
    spark = names.sparkSession
    kinds = spark.createDataFrame([(i, *r) for i, r in enumerate(rules)], "kind_id int, kind string, low double, high double, choices array<string>")
    ruled = names.select("name", (n % 4).cast("int").alias("kind_id")).join(F.broadcast(kinds), "kind_id").drop("kind_id")
    return prep.knob_problems(names.select("name", "value"), ruled).select(F.col("name").alias("id"), "problem")


@query("""
WITH n AS (SELECT n_nationkey AS a, n_regionkey AS r FROM nation)
SELECT x.a AS src, y.a AS dst FROM n x JOIN n y ON x.a <> y.a AND NOT (x.r = y.r AND (x.a + y.a) % 3 <> 0)""")
def pairs_unreached(table):
    nodes = table("nation").select(F.col("n_nationkey").alias("node"))
    ends = lambda k, r: table("nation").select(F.col("n_nationkey").alias(k), F.col("n_regionkey").alias(r))
    probes = ends("src", "r").join(ends("dst", "r"), "r").select("src", "dst", ((F.col("src") + F.col("dst")) % 3 != 0).alias("ok"))
    return prep.unreached(nodes, probes)


@query("SELECT n_name AS name FROM nation WHERE n_regionkey = 1 AND n_name <> (SELECT min(n_name) FROM nation WHERE n_regionkey = 1)")
def owned_tables(table):
    names = table("nation").select(F.col("n_name").alias("name"))
    said = table("nation").select(F.col("n_name").alias("name"), F.lit("owner").alias("key"), F.col("n_regionkey").cast("string").alias("value"))
    first = table("nation").filter("n_regionkey = 1").agg(F.min("n_name")).first()[0]
    return prep.owned(names, said, "1", [first])


@query("""
WITH k AS (SELECT min(n_name) AS a, max(n_name) AS b, max(n_nationkey) FILTER (n_regionkey <> 1) AS last FROM nation)
SELECT n_name AS name, n_nationkey AS step, n_name IN (a, b) OR n_nationkey = last AS keep FROM nation, k""")
def checkpoints_kept(table):
    rows = table("nation").select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("step"), (F.col("n_regionkey") != 1).alias("complete"))
    named = rows.agg(F.min("name"), F.max("name")).first()
    return prep.retention(rows, list(named)).select("name", "step", "keep")


@query("SELECT source, count(*) AS \"rows\", round(avg(length(text)), 6) AS mean_chars FROM documents WHERE source = (SELECT min(source) FROM documents) GROUP BY 1 UNION ALL SELECT 'all', count(*), round(avg(length(text)), 6) FROM documents")
def text_lengths(table):
    docs = table("documents")
    first = docs.agg(F.min("source")).first()[0]
    one = corpus.text_stats(docs.filter(F.col("source") == first)).withColumn("source", F.lit(first))
    return one.unionByName(corpus.text_stats(docs).withColumn("source", F.lit("all"))).withColumn("mean_chars", F.round("mean_chars", 6))


# --- evaluation ---


@query("""
SELECT event_type, count(*) AS n, round(avg((value > 34)::INT), 9) AS em, round(avg((value > 20)::INT), 9) AS cover, round(avg(value / 100), 9) AS f1, count(*) FILTER (user_id % 3 > 0) AS answered, count(*) FILTER (user_id % 3 = 0) AS no_answer,
  count(*) FILTER (event_id % 4 > 0) AS used_tool, round(avg(event_id % 4), 9) AS mean_tools, sum(user_id % 2)::BIGINT AS errors FROM events WHERE event_id % 5 > 0 GROUP BY 1""")
def scored_means(table):
    v, e, u = F.col("value"), F.col("event_id"), F.col("user_id")
    rows = table("events").select("event_type", F.when(e % 5 > 0, "scored").otherwise("timeout").alias("status"), (v > 34).cast("int").alias("em"), (v > 20).cast("int").alias("cover"), (v / 100).alias("f1"), (u % 3).alias("has_answer"), (e % 4).alias("n_tools"), (u % 2).alias("errors"))
    out = evals.scored_means(rows, "event_type")
    return out.select("event_type", "n", *(F.round(c, 9).alias(c) for c in ("em", "cover", "f1")), "answered", "no_answer", "used_tool", F.round("mean_tools", 9).alias("mean_tools"), "errors")


@query("""
SELECT event_type, count(*) AS n, round(sum((user_id % 3 > 0)::INT) / count(*)::DOUBLE, 9) AS submission_rate, round(sum((user_id % 3 > 0 AND value > 34)::INT) / sum((user_id % 3 > 0)::INT)::DOUBLE, 9) AS answer_accuracy, round(avg(value), 6) AS mean_delivered FROM events GROUP BY 1""")
def delivery_rates(table):
    rows = table("events").select("event_type", (F.col("user_id") % 3 > 0).cast("int").alias("submitted"), (F.col("value") > 34).cast("int").alias("correct"), F.col("value").alias("delivered"))
    out = evals.delivery(rows, "event_type")
    return out.select("event_type", "n", F.round("submission_rate", 9).alias("submission_rate"), F.round("answer_accuracy", 9).alias("answer_accuracy"), F.round("mean_delivered", 6).alias("mean_delivered"))


_RUNS = """b AS (SELECT lang AS split, source AS uid, avg(quality) AS b FROM labels JOIN documents USING (doc_id) GROUP BY 1, 2), f AS (SELECT lang AS split, source AS uid, avg(1 - toxic) AS f FROM labels JOIN documents USING (doc_id) GROUP BY 1, 2),
d AS (SELECT split, uid, b, f, f - b AS d FROM b JOIN f USING (split, uid))"""


def _runs(table):
    rows = table("labels").join(table("documents").select("doc_id", "lang", "source"), "doc_id").select(F.col("lang").alias("split"), F.col("source").alias("uid"), "quality", (1 - F.col("toxic")).alias("clean"))
    return rows.select("split", "uid", F.col("quality").alias("m")), rows.select("split", "uid", F.col("clean").alias("m"))


@query(f"""
WITH {_RUNS} SELECT split, count(*) AS questions, round(avg(b), 9) AS baseline, round(avg(f), 9) AS final, round(avg(d), 9) AS delta, count(*) FILTER (d > 0) AS improved, count(*) FILTER (d < 0) AS regressed, count(*) FILTER (d = 0) AS unchanged FROM d GROUP BY 1""")
def runs_compared(table):
    out = paired.compare(*_runs(table), "m")
    return out.select("split", "questions", *(F.round(c, 9).alias(c) for c in ("baseline", "final", "delta")), "improved", "regressed", "unchanged")


@query(f"""
WITH {_RUNS}, q AS (SELECT row_number() OVER (ORDER BY split, uid) - 1 AS i, d, count(*) OVER () AS n FROM d), s AS (SELECT max(n) AS n FROM q),
p AS (SELECT k // n AS b, ('0x' || substr(md5('b:' || k::VARCHAR), 1, 15))::BIGINT % n AS i, n FROM s, LATERAL (SELECT unnest(range(200 * n)) AS k)), m AS (SELECT b, sum(d) / any_value(p.n)::DOUBLE AS m FROM p JOIN q USING (i) GROUP BY b)
SELECT round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high FROM m""")
def runs_interval(table):
    return paired.compare_interval(*_runs(table), "m", 200).select(F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


@query("SELECT DISTINCT c_custkey AS uid FROM customer JOIN supplier ON c_custkey = s_suppkey WHERE c_nationkey IS DISTINCT FROM s_nationkey")
def question_conflicts(table):
    a = table("customer").select(F.col("c_custkey").alias("uid"), F.col("c_nationkey").alias("question"))
    return paired.question_conflicts(a, table("supplier").select(F.col("s_suppkey").alias("uid"), F.col("s_nationkey").alias("question")))


@query("""
WITH c AS (SELECT l_linenumber AS checkpoint, count(*) FILTER (l_returnflag = 'R') AS gained, count(*) FILTER (l_returnflag = 'A') AS lost FROM lineitem GROUP BY 1)
SELECT checkpoint FROM c ORDER BY gained - lost DESC, checkpoint LIMIT 1""")
def best_checkpoint(table):
    counts = table("lineitem").groupBy(F.col("l_linenumber").alias("checkpoint")).agg(F.count_if(F.col("l_returnflag") == "R").alias("gained"), F.count_if(F.col("l_returnflag") == "A").alias("lost"))
    return paired.best_checkpoint(counts)


@query("""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderkey) AS r FROM orders) SELECT o_orderkey, o_custkey, o_orderstatus FROM r WHERE r = 1 ORDER BY o_orderkey LIMIT 50""")
def representatives(table):
    return paired.first_per_key(table("orders").select("o_orderkey", "o_custkey", "o_orderstatus"), ["o_custkey", "o_orderstatus"], ["o_orderkey"], 50)


@query("""
SELECT l_returnflag AS policy, l_linenumber AS checkpoint, coalesce(hops, 'all') AS hops, count(*) AS n, sum((l_quantity > 25)::INT)::BIGINT AS correct FROM (SELECT *, (1 + l_orderkey % 3)::VARCHAR || 'hop' AS hops FROM lineitem)
GROUP BY GROUPING SETS ((l_returnflag, l_linenumber), (l_returnflag, l_linenumber, hops))""")
def heldout_package(table):
    rows = table("lineitem").select(F.col("l_returnflag").alias("policy"), F.col("l_linenumber").alias("checkpoint"), F.concat((1 + F.col("l_orderkey") % 3).cast("string"), F.lit("hop_x")).alias("hop_type"), (F.col("l_quantity") > 25).cast("int").alias("correct"))
    return evals.heldout_package(rows).select("policy", "checkpoint", F.coalesce("hops", F.lit("all")).alias("hops"), "n", "correct")


@query("SELECT round(sum(ps * mins / 60.0 * (1 + re)), 6) AS gpu_hours FROM (SELECT p_size AS ps, p_partkey % 90 AS mins, p_partkey % 3 AS re FROM part)")
def gpu_hours(table):
    jobs = table("part").select(F.col("p_size").alias("gpus"), (F.col("p_partkey") % 90).alias("minutes"), (F.col("p_partkey") % 3).alias("retries"))
    return evals.gpu_hours(jobs).select(F.round("gpu_hours", 6).alias("gpu_hours"))


_JUDGED = "j AS (SELECT doc_id, quality::DOUBLE AS r, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE ((doc_id % 10) / 10.0)::DOUBLE END AS j FROM labels)"


def _judged(table):
    n = F.col("doc_id")
    return table("labels").select("doc_id", F.col("quality").cast("double").alias("rule"), F.when(n % 4 != 0, (n % 10) / 10).alias("judge"))


@query(f"""WITH {_JUDGED} SELECT doc_id, round(CASE WHEN j IS NULL THEN r ELSE 0.3 * j + 0.7 * r END, 9) AS score, (CASE WHEN j IS NULL THEN 0 ELSE ((j >= 0.5) = (r >= 0.5))::INT END)::DOUBLE AS agreement, (j IS NOT NULL)::INT::DOUBLE AS judge_valid FROM j""")
def blended_scores(table):
    return _judged(table).select("doc_id", evals.blended(alpha=0.3).alias("b")).select("doc_id", F.round("b.score", 9).alias("score"), "b.agreement", "b.judge_valid")


@query(f"""WITH {_JUDGED} SELECT round(avg(coalesce(j, 0)) / avg((j IS NOT NULL)::INT), 9) AS judge_score, round(avg((CASE WHEN j IS NULL THEN 0 ELSE ((j >= 0.5) = (r >= 0.5))::INT END)) / avg((j IS NOT NULL)::INT), 9) AS agreement FROM j""")
def judged_ratio(table):
    rows = _judged(table).select(F.coalesce("judge", F.lit(0.0)).alias("judge_score"), evals.blended(alpha=1.0).alias("b")).select("judge_score", "b.agreement", "b.judge_valid")
    out = evals.judged_ratio(rows)
    return out.select(*(F.round(c, 9).alias(c) for c in out.columns))


@query("SELECT count(*) AS n, count(*) FILTER (quality + toxic = 1) AS passed, count(*) FILTER (quality + toxic = 1) >= 0.8 * count(*) AS calibrated FROM labels")
def calibration_gate(table):
    return evals.calibration(table("labels").select((F.col("quality") + F.col("toxic") == 1).alias("ok")), 0.8)


@query("""
WITH g AS (SELECT o_custkey AS uid, count(*) AS n, min((o_orderstatus = 'F')::INT) AS low, max((o_orderstatus = 'F')::INT) AS high FROM orders GROUP BY 1)
SELECT uid FROM g WHERE low < high AND uid IN (SELECT c_custkey FROM customer WHERE c_nationkey < 12) AND n = 10""")
def mixed_groups(table):
    """Groups of just 10 samples; others would be refused as incomplete."""
    o = table("orders")
    full = o.groupBy("o_custkey").count().filter("count = 10").select("o_custkey")
    rows = o.join(full, "o_custkey", "left_semi").select(F.col("o_custkey").alias("uid"), (F.col("o_orderstatus") == "F").cast("double").alias("reward"), F.lit("scored").alias("status"))
    return evals.mixed_uids(rows, 10, table("customer").filter("c_nationkey < 12").select(F.col("c_custkey").alias("uid")))


# --- traces, retrieval ---


@query(f"""
WITH t AS (SELECT conv_id, turn, role, {_normal('text')} AS hay, {_normal("regexp_extract(text, '^[^.,]*', 0)")} AS g, turn % 3 = 0 AS em, role = 'assistant' AS answered, (turn % 10) / 10.0 AS f1 FROM conversations)
SELECT conv_id, turn, CASE WHEN em THEN 'CORRECT' WHEN NOT answered THEN 'FORMAT' WHEN f1 >= 0.5 THEN 'PARTIAL' WHEN g <> '' AND contains(' ' || hay || ' ', ' ' || g || ' ') THEN 'SURFACED_MISSED' ELSE 'NOT_SURFACED' END AS bucket FROM t""")
def traces_diagnosed(table):
    t = F.col("turn")
    rows = table("conversations").select(
        "conv_id", "turn", F.when(F.col("role") == "assistant", "x").otherwise("").alias("pred"), (t % 3 == 0).cast("int").alias("em"), ((t % 10) / 10).alias("f1"), F.array(F.regexp_extract("text", "^[^.,]*", 0)).alias("gt"), F.array("text").alias("tool_texts")
    )
    return traces.diagnosed(rows).select("conv_id", "turn", "bucket")


@query("""
WITH s AS (SELECT o_custkey, list_distinct(list(o_orderpriority)) AS wanted, list_distinct(list(o_orderpriority) FILTER (o_orderstatus = 'F')) AS got, o_custkey % 2 AS em FROM orders GROUP BY o_custkey),
r AS (SELECT em, len(list_intersect(wanted, coalesce(got, []))) / len(wanted)::DOUBLE AS r FROM s)
SELECT count(*) AS n, round(avg(r), 9) AS mean_recall, round(avg((r = 1)::INT), 9) AS all_surfaced, round(avg(em) FILTER (r = 1), 9) AS em_given_all FROM r""")
def supporting_recall(table):
    rows = table("orders").groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias("wanted"), F.collect_set(F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority"))).alias("surfaced")).withColumn("em", F.col("o_custkey") % 2)
    out = traces.supporting_recall(rows)
    return out.select("n", *(F.round(c, 9).alias(c) for c in out.columns[1:]))


@query("""
WITH t AS (SELECT n_nationkey::VARCHAR AS key, n_name AS titles FROM nation)
SELECT c_custkey, coalesce(q.titles, u.titles) AS titles FROM (SELECT c_custkey, (c_nationkey + 20)::VARCHAR AS question, c_nationkey::VARCHAR AS uid FROM customer) c LEFT JOIN t q ON q.key = question LEFT JOIN t u ON u.key = uid""")
def supporting_titles(table):
    titles = table("nation").select(F.col("n_nationkey").cast("string").alias("key"), F.array("n_name").alias("titles"))
    rows = table("customer").select("c_custkey", (F.col("c_nationkey") + 20).cast("string").alias("question"), F.col("c_nationkey").cast("string").alias("uid"))
    return traces.with_supporting(rows, titles).select("c_custkey", F.element_at("supporting_titles", 1).alias("titles"))


@query("""
SELECT quality, doc_id, row_number() OVER (PARTITION BY quality ORDER BY doc_id)::INT AS rank FROM labels QUALIFY rank <= 3""")
def bucket_examples(table):
    return traces.examples(table("labels").select("quality", "doc_id"), "quality", "doc_id").select("quality", "doc_id", "rank")


@query("""
WITH t AS (SELECT doc_id, source || ':' || lang || ':' || n_chars::VARCHAR AS title, text FROM documents)
SELECT md5(string_agg(text, chr(10) ORDER BY doc_id, text)) AS text_md5 FROM t WHERE lower(title) = lower((SELECT min(title) FROM t))""")
def article_read(table):
    docs = table("documents").select(F.col("doc_id").alias("id"), F.concat_ws(":", "source", "lang", F.col("n_chars").cast("string")).alias("title"), "text")
    first = docs.agg(F.min("title")).first()[0]
    return retrieval.article(docs, f" {first.upper()} ").select(F.md5("text").alias("text_md5"))


@query("""
WITH r AS (SELECT o_custkey AS query_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey)::INT AS rank, o_orderkey, o_orderdate, o_totalprice, o_orderpriority FROM orders)
SELECT query_id, md5(string_agg(printf('[%d] %s (%s)  score=%.2f', rank, 'o' || o_orderkey::VARCHAR, strftime(o_orderdate, '%Y-%m'), (o_orderkey % 100) / 4.0) || chr(10) || '    ' || o_orderpriority, chr(10) ORDER BY rank)) AS text_md5 FROM r GROUP BY 1""")
def search_results_text(table):
    from pyspark.sql import Window

    o = table("orders").withColumn("rank", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")))
    rows = o.select(F.col("o_custkey").alias("query_id"), "rank", F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("source"), F.date_format("o_orderdate", "yyyy-MM").alias("date"), ((F.col("o_orderkey") % 100) / 4).alias("score"), F.col("o_orderpriority").alias("snippet"))
    return retrieval.search_text(rows).select("query_id", F.md5("text").alias("text_md5"))


# --- rewards ---


@query("""
SELECT p_partkey, round(0.9 * (p_partkey % 3 <> 1)::INT + 0.1 * (p_partkey % 2 = 0)::INT, 9)::DOUBLE AS score, (p_partkey % 3 <> 1)::INT::DOUBLE AS accuracy, (p_partkey % 2 = 0)::INT::DOUBLE AS format FROM part""")
def geometry_rewards(table):
    n, size = F.col("p_partkey"), F.col("p_size").cast("string")
    box = F.concat(F.lit("\\boxed{"), F.when(n % 3 == 1, F.concat(size, F.lit("1"))).when(n % 3 == 2, F.concat(size, F.lit(".0"))).otherwise(size), F.lit("}"))
    reply = F.concat(F.when(n % 2 == 0, "<think>so\n</think> ").otherwise("so "), box, F.lit(" cm"))
    r = numbers.geometry_reward(reply, size)
    return table("part").select("p_partkey", r.alias("r")).select("p_partkey", F.round("r.score", 9).alias("score"), "r.accuracy", "r.format")


@query("""
SELECT p_partkey, p_partkey % 3 = 0 AS correct, CASE p_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'EXTRA' ELSE 'WRONG' END AS reason, p_partkey % 3 <> 2 AS fuzzy FROM part""")
def answers_checked(table):
    """Answers stated as they should be, with one figure too many, and in another unit."""
    n, size = F.col("p_partkey"), F.col("p_size").cast("string")
    gold = F.concat(size, F.lit(" million"))
    answer = F.when(n % 3 == 0, F.concat(F.lit("$"), size, F.lit(",000,000 (in all)"))).when(n % 3 == 1, F.concat(F.lit("7777 and "), size, F.lit(" million"))).otherwise(F.concat(F.lit("0."), size, F.lit("1 billion")))
    rows = table("part").select("p_partkey", numbers.answer_check(answer, gold).alias("c"), numbers.answers_match(size, F.when(n % 3 == 2, "none 0.5").otherwise(F.concat(size, F.lit(" in all")))).alias("fuzzy"))
    return rows.select("p_partkey", "c.correct", "c.reason", "fuzzy")
