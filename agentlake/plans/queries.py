"""The queries over the driver's tables. Each runs over whole tables; SQL beside it gives the same rows in DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from agentlake.functions import numbers, stats
from agentlake.functions import text as tx
from agentlake.operators import chunking, corpus, episodes, evals, paired, prep, retrieval, traces
from agentlake.operators.order import global_index, materialise
from agentlake.streaming import streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: White space in DuckDB's regular expressions.
_WS = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_PUNCT = "!\"#$%&''()*+,-./:;<=>?@[\\]^_`{|}~"


def _collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, '{_WS}+', ' ', 'g'))"


def _normal(x: str) -> str:
    """normalise_answer in SQL: articles go as tokens."""
    return f"array_to_string(list_filter(string_split({_collapse(f"translate(lower({x}), '{_PUNCT}', '')")}, ' '), lambda t: t NOT IN ('a', 'an', 'the', '')), ' ')"


def query(sql: str | None = None):
    def add(f: Callable[[Callable[[str], DataFrame]], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))

        QUERIES[f.__name__] = run
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# --- corpora and question sets ---


@query(f"""
WITH t AS (SELECT doc_id, source || ':' || lang AS title, {_collapse('text')} AS text FROM documents),
p AS (SELECT *, 'p_' || substr(md5(lower(title) || chr(10) || text), 1, 20) AS id FROM t WHERE title <> '' AND length(text) >= 20)
SELECT id, min(doc_id) AS doc_id, arg_min(title, doc_id) AS title, arg_min(length(text), doc_id)::INT AS n_chars FROM p GROUP BY id""")
def passages_dedup(table):
    docs = table("documents").select("doc_id", F.concat_ws(":", "source", "lang").alias("title"), "text")
    kept = corpus.passages(docs).select("id", "doc_id", "title", F.length("text").alias("n_chars"))
    return corpus.first_of_each(kept, "id", ["doc_id"])


@query("""
WITH r AS (SELECT source, lang AS split, n_chars % 97 AS question, coalesce(quality = 1, false) AS supporting, length(text) >= 500 AS kept
           FROM documents LEFT JOIN labels USING (doc_id)),
q AS (SELECT source, split, question, count(*) AS paragraphs, count(*) FILTER (supporting) AS supporting,
             count(*) FILTER (supporting AND kept) AS supporting_kept FROM r GROUP BY ALL)
SELECT source, split, count(*) AS questions, sum(paragraphs)::BIGINT AS paragraphs, sum(supporting)::BIGINT AS supporting,
       sum(supporting_kept)::BIGINT AS supporting_kept, count(*) FILTER (supporting > 0 AND supporting = supporting_kept) AS questions_fully_supported
FROM q GROUP BY source, split""")
def corpus_audit(table):
    rows = table("documents").select("doc_id", "source", F.col("lang").alias("split"), (F.col("n_chars") % 97).alias("question"), (F.length("text") >= 500).alias("kept"))
    rows = rows.join(table("labels").select("doc_id", "quality"), "doc_id", "left").withColumn("supporting", F.coalesce(F.col("quality") == 1, F.lit(False)))
    return corpus.audit(rows)


@query("""
WITH h AS (SELECT sha256(item_id::VARCHAR || chr(31) || text) AS h FROM benchmark)
SELECT sha256(string_agg(h, '' ORDER BY h)) AS digest, count(*) AS n FROM h""")
def content_digest(table):
    return corpus.content_digest(table("benchmark"), F.sha2(F.concat_ws("\x1f", F.col("item_id").cast("string"), "text"), 256))


@query("""
WITH h AS (SELECT sha256(doc_id::VARCHAR || chr(31) || coalesce(text, '')) AS h FROM documents),
l AS (SELECT substr(h, 1, 4) AS p, sha256(string_agg(h, '' ORDER BY h)) AS h, count(*) AS n FROM h GROUP BY 1)
SELECT sha256(string_agg(h, '' ORDER BY p)) AS digest, sum(n)::BIGINT AS n FROM l""")
def corpus_digest(table):
    return corpus.tree_digest(table("documents"), F.sha2(F.concat_ws("\x1f", F.col("doc_id").cast("string"), F.coalesce("text", F.lit(""))), 256))


@query("SELECT sha256(string_agg(item_id::VARCHAR, chr(10) ORDER BY item_id)) AS digest, count(*) AS n FROM benchmark")
def ids_digest(table):
    return corpus.ordered_digest(table("benchmark"), F.col("item_id").cast("string"), [F.col("item_id")])


@query("""
WITH n AS (SELECT lpad(item_id::VARCHAR, 12, '0') || '.txt' AS name, sha256(text) AS sha FROM benchmark)
SELECT sha256(string_agg(name || chr(0) || sha || chr(10), '' ORDER BY name)) AS identity FROM n""")
def archive_identity(table):
    files = table("benchmark").select(F.concat(F.lit("x/"), F.lpad(F.col("item_id").cast("string"), 12, "0"), F.lit(".txt")).alias("path"), "text")
    return corpus.archive_identity(files)


@query("SELECT DISTINCT md5(text) AS text_md5 FROM documents WHERE text IN (SELECT text FROM benchmark)")
def split_overlap(table):
    return prep.overlap(table("documents"), table("benchmark"), ["text"]).select(F.md5("text").alias("text_md5"))


@query("SELECT item_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)")
def contained_benchmark(table):
    items = table("benchmark").select("item_id", F.col("text").alias("item"))  # the stated query set
    met = retrieval.holding(table("documents"), items, lambda c: F.filter(F.split(c, r"[ \t\n\x0b\f\r]+"), lambda t: t != ""), inner=True)
    return met.filter(F.contains("text", "item")).select("item_id", "doc_id")


@query("""
SELECT doc_id, quality FROM (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY sha256(doc_id::VARCHAR), doc_id) AS r FROM labels) WHERE r <= 90""")
def hash_split(table):
    return prep.hash_pick(table("labels").select("doc_id", "quality"), "quality", "doc_id", 90)


@query("""
WITH c AS (SELECT lang AS stratum, count(*) AS size FROM documents GROUP BY 1),
e AS (SELECT *, 200.0::DOUBLE * size / sum(size) OVER () AS x FROM c),
a AS (SELECT stratum, floor(x) + (row_number() OVER (ORDER BY x - floor(x) DESC, stratum) <= 200 - sum(floor(x)) OVER ())::INT AS want FROM e),
r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY sha256('s' || doc_id::VARCHAR), doc_id) AS r FROM documents)
SELECT lang, doc_id FROM r JOIN a ON stratum = lang WHERE r <= want""")
def stratified_alloc(table):
    docs = table("documents").select("lang", "doc_id")
    want = prep.allocation(docs.groupBy(F.col("lang").alias("stratum")).agg(F.count(F.lit(1)).alias("size")), 200)
    return prep.hash_pick(docs, "lang", "doc_id", want, "s")


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 100")
def prefix_limit(table):
    return prep.prefix(table("orders"), ["o_orderdate", "o_orderkey"], 100).select("o_orderkey", "o_custkey", "o_totalprice")


@query("SELECT p_size::INT AS level, count(*) AS n FROM part WHERE p_size IN (3, 4, 5) GROUP BY 1")
def level_histogram(table):
    level = tx.level_number(F.concat(F.lit("Level "), F.col("p_size").cast("string"))).alias("level")
    return table("part").select(level).filter(F.col("level").isin(3, 4, 5)).groupBy("level").agg(F.count(F.lit(1)).alias("n"))


@query(f"""
SELECT CASE WHEN {_collapse("coalesce(text, '')")} = '' THEN 'blank' WHEN length(text) < 200 THEN 'short' WHEN lang <> 'en' THEN 'other language' ELSE 'kept' END AS reason,
       count(*) AS n FROM documents GROUP BY 1""")
def drop_reasons(table):
    text = F.coalesce("text", F.lit(""))
    reason = F.when(tx.collapse(text) == "", "blank").when(F.length(text) < 200, "short").when(F.col("lang") != "en", "other language")
    return prep.conversion_stats(table("documents").select(reason.alias("drop_reason")))


@query(f"""
WITH l AS (SELECT conv_id, turn, list_filter(list_transform(regexp_split_to_array(text, '[.\\n]'), lambda a: regexp_replace(regexp_replace(a, '^{_WS}+', ''), '{_WS}+$', '')), lambda a: a <> '') AS l FROM conversations),
d AS (SELECT conv_id, turn, list_filter(l, lambda a, i: list_position(list_transform(l, lambda b: lower(b)), lower(a)) = i) AS d FROM l)
SELECT conv_id, turn, len(d)::INT AS n, array_to_string(d, '|') AS answers FROM d""")
def answers_clean(table):
    clean = table("conversations").select("conv_id", "turn", tx.clean_answers(F.split("text", r"[.\n]")).alias("d"))
    return clean.select("conv_id", "turn", F.size("d").alias("n"), F.array_join("d", "|").alias("answers"))


@query("""
WITH p AS (SELECT conv_id, turn, role, text, lead(role) OVER w AS next_role, lead(text) OVER w AS next_text FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT row_number() OVER (ORDER BY conv_id, turn) - 1 AS index, conv_id, md5(text) AS question, 1::INT AS n_answers, md5(next_text) AS answer, 'rule' AS style, 2::INT AS n_messages
FROM p WHERE role = 'user' AND next_role = 'assistant'""")
def train_rows(table):
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn")
    pairs = table("conversations").withColumn("next_role", F.lead("role").over(w)).withColumn("answer", F.lead("text").over(w))
    pairs = global_index(pairs.filter("role = 'user' and next_role = 'assistant'"), ["conv_id", "turn"], "index")
    row = prep.train_row(F.lit("conversations"), F.col("text"), F.array("answer"), "Answer.", {"index": F.col("index"), "source_id": F.col("conv_id")})
    return pairs.select(row.alias("r")).select(
        "r.extra_info.index", F.col("r.extra_info.source_id").alias("conv_id"), F.md5(F.element_at("r.prompt", 2)["content"]).alias("question"), F.size("r.reward_model.ground_truth").alias("n_answers"),
        F.md5(F.element_at("r.reward_model.ground_truth", 1)).alias("answer"), "r.reward_model.style", F.size("r.prompt").alias("n_messages"),
    )


# --- scoring ---


@query(f"""
WITH a AS (SELECT conv_id, turn, {_normal("text")} AS p, {_normal("regexp_extract(text, '^[^.]*', 0)")} AS g1, {_normal("regexp_extract(text, '[^.]*.?$', 0)")} AS g2 FROM conversations WHERE role = 'assistant'),
t AS (SELECT *, list_filter(string_split(p, ' '), lambda x: x <> '') AS pt, [list_filter(string_split(g1, ' '), lambda x: x <> ''), list_filter(string_split(g2, ' '), lambda x: x <> '')] AS gs FROM a),
f AS (SELECT *, list_max(list_transform(gs, lambda g: CASE WHEN len(pt) = 0 OR len(g) = 0 THEN (len(pt) = len(g))::INT::DOUBLE ELSE
      2.0 * coalesce(list_sum(list_transform(list_distinct(pt), lambda x: least(len(list_filter(pt, lambda y: y = x)), len(list_filter(g, lambda y: y = x))))), 0) / (len(pt) + len(g)) END)) AS f1 FROM t)
SELECT conv_id, turn, (p = g1 OR p = g2) AS em, ((g1 <> '' AND contains(p, g1)) OR (g2 <> '' AND contains(p, g2))) AS cover, round(f1, 9) AS f1 FROM f""")
def squad_metrics(table):
    rows = table("conversations").filter("role = 'assistant'")
    golds = F.array(F.regexp_extract("text", r"^[^.]*", 0), F.regexp_extract("text", r"[^.]*.?$", 0))
    return rows.select("conv_id", "turn", tx.exact_match(F.col("text"), golds).alias("em"), tx.cover_match(F.col("text"), golds).alias("cover"), F.round(tx.token_f1(F.col("text"), golds), 9).alias("f1"))


@query(f"""
WITH d AS (SELECT ' ' || {_normal('text')} || ' ' AS t FROM documents), i AS (SELECT item_id, {_normal("text")} AS g FROM benchmark)
SELECT item_id, count(*) FILTER (g <> '' AND contains(t, ' ' || g || ' ')) AS n_docs FROM i, d GROUP BY item_id""")
def gold_surfaced(table):
    items = table("benchmark").select("item_id", tx.normalise_answer("text").alias("item"))
    docs = table("documents").select("doc_id", tx.normalise_answer("text").alias("text"))
    met = retrieval.holding(materialise(docs, "normal"), items.filter("item <> ''"), lambda c: F.split(c, " "), inner=False)
    spaced = lambda c: F.concat(F.lit(" "), c, F.lit(" "))
    found = met.filter(F.contains(spaced("text"), spaced("item"))).groupBy("item_id").agg(F.count(F.lit(1)).alias("n"))
    return items.join(found, "item_id", "left").select("item_id", F.coalesce("n", F.lit(0)).alias("n_docs"))


@query("SELECT conv_id, arg_max(text, turn) AS answer, max(turn) AS turn FROM conversations WHERE role = 'assistant' GROUP BY conv_id")
def last_answer_turn(table):
    return paired.last_answers(table("conversations"), "conv_id", F.when(F.col("role") == "assistant", F.col("text")))


@query("""
WITH c AS (SELECT conv_id, turn, role, length(text) AS len, role <> lag(role, 1, '') OVER (PARTITION BY conv_id ORDER BY turn) AS new FROM conversations WHERE length(text) > 0),
r AS (SELECT *, sum(new::INT) OVER w AS run, sum(len) OVER w AS upto FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, any_value(role) AS role, min(upto - len)::BIGINT AS start, max(upto)::BIGINT AS "end" FROM r GROUP BY conv_id, run""")
def role_spans(table):
    return traces.role_runs(table("conversations"), "conv_id", "turn", F.col("role"))


_NUM = r"\$?\d{1,3}(?:,\d{3})+(?:\.\d+)?|\$?\d+\.\d+|\$?\d+"


@query(f"""
WITH n AS (SELECT doc_id, regexp_extract_all(text, '{_NUM}') AS ts FROM documents)
SELECT doc_id, len(ts)::INT AS n_numbers, len(list_filter(ts, lambda t: NOT (regexp_matches(t, '^\\d{{4}}$') AND t BETWEEN '1900' AND '2099') AND (regexp_matches(t, '[,.$]') OR regexp_matches(t, '^\\d{{3}}'))))::INT AS n_claims FROM n""")
def number_values(table):
    return table("documents").select("doc_id", F.size(episodes.numbers(F.col("text"))).alias("n_numbers"), F.size(episodes.claimed_numbers(F.col("text"))).alias("n_claims"))


@query()
def answer_values(table):
    """Values with sign and unit (N8): needs lookbehind, which the SQL dialect lacks."""
    return table("documents").select("doc_id", F.size(numbers.number_values("text")).alias("n_values"))


@query()
def calculator(table):
    one = table("region").limit(1)
    expressions = ["2+3*4", "2**100", "factorial(20)", "sqrt(2)", "1/0", "10**10**10", "__import__('os')", "round(2.5)", "max(1, 2, 3) % 2", "gcd(84, 36)"]
    return one.select(F.explode(F.array(*map(F.lit, expressions))).alias("expression")).select("expression", numbers.calculator("expression").alias("value"))


@query()
def boxed_grading(table):
    cases = [(r"so \boxed{\frac{3}{4}}", "0.75"), (r"\boxed{2\sqrt{2}}", r"\sqrt{8}"), ("#### 1,234", "1234"), (r"\boxed{x^2+1}", "1+x^2"), (r"\boxed{50}", "0.5")]
    rows = table("region").limit(1).select(F.explode(F.array(*(F.struct(F.lit(a).alias("text"), F.lit(b).alias("gold")) for a, b in cases))).alias("c")).select("c.*")
    return rows.withColumn("pred", numbers.boxed_answer("text")).select("gold", "pred", numbers.graded("pred", "gold").alias("correct"))


# --- evaluation statistics ---


@query("""
SELECT count(*) AS n, count(*) FILTER (event_type <> 'error') AS n_scored, 0::BIGINT AS model_error, count(*) FILTER (event_type = 'error') AS tool_error, 0::BIGINT AS judge_error,
       0::BIGINT AS timeout, 0::BIGINT AS other_error, CASE WHEN count(*) FILTER (event_type = 'error') > 0 THEN 'infrastructure errors' ELSE '' END AS reasons, count(*) FILTER (event_type = 'error') = 0 AS valid FROM events""")
def verdict_counts(table):
    status = F.when(F.col("event_type") == "error", "tool_error").otherwise("scored").alias("status")
    return evals.verdict(table("events").select(status)).withColumn("reasons", F.array_join("reasons", ";"))


@query("""
WITH g AS (SELECT user_id, min((value > 34)::INT) AS low, max((value > 34)::INT) AS high, stddev_pop((value > 34)::INT::DOUBLE) AS std, bool_or(event_type = 'error' AND value > 90) AS infra FROM events GROUP BY 1),
c AS (SELECT *, max(high) OVER () AS top FROM g WHERE NOT infra),
s AS (SELECT count(*) AS groups, count(*) FILTER (low = high) AS e, count(*) FILTER (low = high AND high = 0) AS w, count(*) FILTER (low = high AND low = top AND top > 0) AS r, count(*) FILTER (low <> high) AS m, avg(std) AS std FROM c),
z AS (SELECT *, 1.959963984540054 AS z, m / groups::DOUBLE AS p FROM s)
SELECT groups, round(coalesce(e / groups::DOUBLE, 0), 9) AS all_equal_share, round(coalesce(w / groups::DOUBLE, 0), 9) AS all_wrong_share, round(coalesce(r / groups::DOUBLE, 0), 9) AS all_right_share, round(coalesce(p, 0), 9) AS mixed_share,
       CASE WHEN groups = 0 THEN 0.0 ELSE round(greatest(0, (p + z*z/(2*groups) - z*sqrt(p*(1-p)/groups + z*z/(4.0*groups*groups))) / (1 + z*z/groups)), 9) END AS mixed_low,
       CASE WHEN groups = 0 THEN 1.0 ELSE round(least(1, (p + z*z/(2*groups) + z*sqrt(p*(1-p)/groups + z*z/(4.0*groups*groups))) / (1 + z*z/groups)), 9) END AS mixed_high, round(std, 9) AS mean_std FROM z""")
def group_variance(table):
    status = F.when((F.col("event_type") == "error") & (F.col("value") > 90), "tool_error").otherwise("scored")
    rows = table("events").select(F.col("user_id").alias("group"), (F.col("value") > 34).cast("double").alias("reward"), status.alias("status"))
    out = evals.group_variance(evals.group_spread(rows))
    return out.select("groups", *(F.round(c, 9).alias(c) for c in out.columns[1:]))


@query("""
WITH s AS (SELECT o_orderpriority AS priority, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS c, 1.959963984540054 AS z FROM orders GROUP BY 1), p AS (SELECT *, c / n::DOUBLE AS p FROM s)
SELECT priority, n, c, round((p + z*z/(2*n) - z*sqrt(p*(1-p)/n + z*z/(4.0*n*n))) / (1 + z*z/n), 9) AS low, round((p + z*z/(2*n) + z*sqrt(p*(1-p)/n + z*z/(4.0*n*n))) / (1 + z*z/n), 9) AS high FROM p""")
def wilson_by_key(table):
    out = table("orders").groupBy(F.col("o_orderpriority").alias("priority")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("c"))
    ci = stats.wilson(F.col("c"), F.col("n"))
    return out.select("priority", "n", "c", F.round(ci["low"], 9).alias("low"), F.round(ci["high"], 9).alias("high"))


@query("""
WITH g AS (SELECT doc_id, 4 AS n, quality + (1 - toxic) + (doc_id % 3 = 0)::INT + (n_chars > 700)::INT AS c FROM labels JOIN documents USING (doc_id))
SELECT count(*) AS questions, count(*) AS fully_scored, coalesce(sum(c), 0)::BIGINT AS successes, round(avg(c / 4.0), 9) AS pass_1,
       round(avg(CASE WHEN 4 - c < 3 THEN 1.0 ELSE 1 - ((4-c)*(3-c)*(2-c)) / (4*3*2.0) END), 9) AS pass_3, count(*) FILTER (c > 0 AND c < 4) AS mixed, count(*) FILTER (c = 0) AS zero, count(*) FILTER (c = 4) AS "all" FROM g""")
def pass_at_k(table):
    """Four samples of each labelled document."""
    rows = table("labels").join(table("documents").select("doc_id", "n_chars"), "doc_id")
    samples = F.array(F.col("quality") == 1, F.col("toxic") == 0, F.col("doc_id") % 3 == 0, F.col("n_chars") > 700)
    rows = rows.select(F.col("doc_id").alias("uid"), F.explode(samples).alias("ok"))
    rows = rows.select("uid", F.col("ok").cast("double").alias("reward"), F.lit("scored").alias("status"))
    return evals.summary(rows, 4).withColumn("pass_1", F.round("pass_1", 9)).withColumn("pass_3", F.round("pass_3", 9))


@query("""
WITH s AS (SELECT count(*) AS n, count(*) FILTER (quality = 0 AND toxic = 0) AS gained, count(*) FILTER (quality = 1 AND toxic = 1) AS lost FROM labels)
SELECT n, gained, lost, round((gained - lost) / n::DOUBLE, 9) AS delta, round(CASE WHEN gained + lost = 0 THEN 1.0 ELSE least(1.0, 2 * list_sum(list_transform(range(least(gained, lost) + 1),
       lambda i: exp(lgamma(gained + lost + 1) - lgamma(i + 1) - lgamma(gained + lost - i + 1) - (gained + lost) * ln(2))))) END, 6) AS p FROM s""")
def mcnemar_pairs(table):
    labels = table("labels")
    base, final = labels.select("doc_id", F.col("quality").alias("correct")), labels.select("doc_id", (1 - F.col("toxic")).alias("correct"))
    pairs = paired.aligned(base, final, "doc_id").filter("in_base and in_final")
    return paired.paired_counts(pairs).select("n", "gained", "lost", F.round("delta", 9).alias("delta"), F.round("p", 6).alias("p"))


@query("""
WITH a AS (SELECT c_custkey AS uid, (c_acctbal > 0)::INT AS ok FROM customer), b AS (SELECT o_custkey + 5 AS uid, max((o_orderstatus = 'F')::INT) AS ok FROM orders GROUP BY 1)
SELECT coalesce(a.ok::VARCHAR, 'none') AS before, coalesce(b.ok::VARCHAR, 'none') AS after, count(*) AS n, min(coalesce(a.uid, b.uid)) AS first FROM a FULL JOIN b ON a.uid = b.uid GROUP BY 1, 2""")
def paired_transitions(table):
    """Two runs that each miss some of the other's questions."""
    a = table("customer").select(F.col("c_custkey").alias("uid"), (F.col("c_acctbal") > 0).cast("int").alias("correct"))
    b = table("orders").groupBy((F.col("o_custkey") + 5).alias("uid")).agg(F.max((F.col("o_orderstatus") == "F").cast("int")).alias("correct"))
    pairs = paired.aligned(a, b, "uid")
    pairs = pairs.select("uid", F.coalesce(F.col("base").cast("string"), F.lit("none")).alias("before"), F.coalesce(F.col("final").cast("string"), F.lit("none")).alias("after"))
    return paired.transitions(pairs, "before", "after", "uid")


@query("""
WITH q AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS i, 1 - toxic - quality AS d, count(*) OVER () AS n FROM labels),
s AS (SELECT max(n) AS n FROM q), p AS (SELECT k // n AS b, ('0x' || substr(md5('b:' || k::VARCHAR), 1, 15))::BIGINT % n AS i, n FROM s, LATERAL (SELECT unnest(range(200 * n)) AS k)),
m AS (SELECT b, sum(d) / any_value(p.n)::DOUBLE AS m FROM p JOIN q USING (i) GROUP BY b)
SELECT round(quantile_cont(m, 0.025), 9) AS low, round(quantile_cont(m, 0.975), 9) AS high FROM m""")
def bootstrap_ci(table):
    rows = global_index(table("labels").select("doc_id", (1 - F.col("toxic") - F.col("quality")).alias("d")), ["doc_id"], "i")
    out = paired.bootstrap(rows, rows.count(), 200)
    return out.select(F.round("low", 9).alias("low"), F.round("high", 9).alias("high"))


@query("""
WITH d AS (SELECT doc_id, c, CASE c WHEN 0 THEN 1 - toxic - quality WHEN 1 THEN toxic - quality ELSE (quality + toxic) % 2 * (1 - 2 * (doc_id % 2)) END AS d FROM labels, (VALUES (0), (1), (2)) t(c)),
k AS (SELECT * FROM d WHERE d <> 0), o AS (SELECT max(abs(s)) AS o FROM (SELECT sum(d) AS s FROM k GROUP BY c)),
s AS (SELECT p, c, sum(CASE WHEN ('0x' || substr(md5('p:' || doc_id::VARCHAR || ':' || p::VARCHAR), 1, 15))::BIGINT % 2 = 0 THEN d ELSE -d END) AS s FROM k, (SELECT unnest(range(200)) AS p) GROUP BY p, c),
t AS (SELECT p, max(abs(s)) AS t FROM s GROUP BY p)
SELECT round((count(*) FILTER (t >= o) + 1) / 201.0, 9) AS p FROM t, o""")
def permutation_p(table):
    flags = F.array((1 - F.col("toxic") - F.col("quality")).cast("long"), (F.col("toxic") - F.col("quality")).cast("long"), ((F.col("quality") + F.col("toxic")) % 2 * (1 - 2 * (F.col("doc_id") % 2))).cast("long"))
    deltas = table("labels").select(F.col("doc_id").alias("uid"), F.posexplode(flags).alias("checkpoint", "d"))
    return paired.max_stat_p(deltas, 200).select(F.round("p", 9).alias("p"))


@query("""
SELECT coalesce(source, 'all') AS source, coalesce(lang, 'all') AS lang, GROUPING(source, lang)::BIGINT AS grain, count(*) AS n, sum(quality)::BIGINT AS correct, sum(1 - toxic)::BIGINT AS answered,
       round(sum(quality) / count(*)::DOUBLE, 9) AS accuracy, round(coalesce(sum(quality) / nullif(sum(1 - toxic), 0)::DOUBLE, 0), 9) AS among_answered
FROM labels JOIN documents USING (doc_id) GROUP BY GROUPING SETS ((), (source), (lang))""")
def accuracy_rollup(table):
    rows = table("labels").join(table("documents").select("doc_id", "source", "lang"), "doc_id")
    out = evals.answer_rollup(rows.select("source", "lang", F.col("quality").alias("correct"), (1 - F.col("toxic")).alias("answered")), "source", "lang")
    out = out.withColumn("source", F.coalesce("source", F.lit("all"))).withColumn("lang", F.coalesce("lang", F.lit("all")))
    return out.withColumn("accuracy", F.round("accuracy", 9)).withColumn("among_answered", F.round("among_answered", 9))


@query("SELECT 'k' AS key, sum((props->>'k')::BIGINT)::BIGINT AS total FROM events")
def map_sum(table):
    return evals.map_totals(table("events").select(F.from_json("props", "map<string,bigint>").alias("m")), "m")


@query("""
SELECT event_type, count(value) AS n, round(quantile_cont(value, 0.5), 9) AS median, list_sort(list(value) FILTER (value IS NOT NULL))[least(count(value) - 1, floor(0.95 * count(value)))::INT + 1] AS p95
FROM events GROUP BY 1""")
def latency_nearest_rank(table):
    return evals.latency(table("events"), "value", "event_type").withColumn("median", F.round("median", 9))


@query("""
SELECT CASE WHEN quality = 1 THEN 'CORRECT' WHEN n_chars <= 300 THEN 'FORMAT' WHEN n_chars % 100 >= 50 THEN 'PARTIAL' WHEN toxic = 0 THEN 'SURFACED_MISSED' ELSE 'NOT_SURFACED' END AS bucket,
       count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY 1""")
def bucket_trace(table):
    rows = table("labels").join(table("documents").select("doc_id", "n_chars"), "doc_id")
    bucket = tx.trace_bucket(F.col("quality") == 1, F.col("n_chars") > 300, (F.col("n_chars") % 100) / 100, F.col("toxic") == 0)
    return rows.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query("""
WITH r AS (SELECT lang, toxic = 0 AS s, quality = 1 AS c FROM labels JOIN documents USING (doc_id))
SELECT lang, count(*) AS n, round(avg(s::INT), 9) AS p_surfaced, round(avg(c::INT) FILTER (s), 9) AS right_given_surfaced, round(avg(c::INT) FILTER (NOT s), 9) AS right_given_not, round(avg(c::INT), 9) AS em FROM r GROUP BY lang""")
def em_decomposition(table):
    rows = table("labels").join(table("documents").select("doc_id", "lang"), "doc_id").select("lang", (F.col("toxic") == 0).alias("surfaced"), (F.col("quality") == 1).alias("correct"))
    out = traces.decomposition(rows, "lang")
    return out.select("lang", "n", *(F.round(c, 9).alias(c) for c in out.columns[2:]))


@query("""
SELECT coalesce(user_id::VARCHAR, 'all') AS worker, coalesce(event_type, 'all') AS kind, GROUPING(user_id, event_type)::BIGINT AS grain, count(*) AS trajectories, count(*) FILTER (value > 34) AS successes FROM events
GROUP BY GROUPING SETS ((), (user_id), (event_type))""")
def version_rollup(table):
    rows = table("events").select(F.col("event_type").alias("category"), F.col("user_id").alias("version"), F.when(F.col("value") > 34, 1.0).otherwise(0.0).alias("reward"), F.col("event_id").alias("uid"))
    out = evals.training_rollup(rows)
    # category is the first grouping column here, worker the second
    grain = F.when(F.col("grain") == 1, 2).when(F.col("grain") == 2, 1).otherwise(F.col("grain")).cast("long")
    return out.select(F.coalesce(F.col("version").cast("string"), F.lit("all")).alias("worker"), F.coalesce("category", F.lit("all")).alias("kind"), grain.alias("grain"), "trajectories", "successes")


@query("""
WITH g AS (SELECT source, avg(quality) AS rate FROM labels JOIN documents USING (doc_id) GROUP BY 1),
s AS (SELECT count(*) AS groups, count(*) FILTER (rate > 0 AND rate < 1) AS effective, count(*) FILTER (rate > 0.5) AS saturated, count(*) FILTER (rate = 0) AS floored FROM g)
SELECT *, round(effective / groups::DOUBLE, 9) AS share, CASE WHEN effective / groups::DOUBLE >= 0.4 THEN 'proceed' WHEN effective / groups::DOUBLE >= 0.2 THEN 'marginal' ELSE 'stop' END AS verdict FROM s""")
def baseline_gate(table):
    rates = table("labels").join(table("documents").select("doc_id", "source"), "doc_id").groupBy("source").agg(F.avg("quality").alias("rate"))
    return evals.baseline_gate(rates).withColumn("share", F.round("share", 9))


@query("""
WITH r AS (SELECT doc_id AS id, CASE WHEN toxic = 1 THEN 'tool_error' ELSE 'scored' END AS status, CASE WHEN quality = 1 OR toxic = 1 THEN 1.0 END AS score FROM labels),
p AS (SELECT coalesce(r.id, d.doc_id) AS id, r.id IS NULL AS missing, d.doc_id IS NULL AS unexpected, status, score FROM r FULL JOIN (SELECT doc_id FROM documents WHERE lang = 'en') d ON d.doc_id = r.id)
SELECT id, problem FROM p, LATERAL (SELECT unnest([CASE WHEN missing THEN 'missing' END, CASE WHEN unexpected THEN 'unexpected' END, CASE WHEN status = 'scored' AND score IS NULL THEN 'scored without a score' END,
     CASE WHEN status <> 'scored' AND score IS NOT NULL THEN 'a score though not scored' END]) AS problem) WHERE problem IS NOT NULL""")
def result_integrity(table):
    results = table("labels").select(F.col("doc_id").alias("id"), F.when(F.col("toxic") == 1, "tool_error").otherwise("scored").alias("status"), F.when((F.col("quality") == 1) | (F.col("toxic") == 1), 1.0).alias("score"))
    return evals.integrity_problems(results, table("documents").filter("lang = 'en'").select(F.col("doc_id").alias("id")))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def missing_ids(table):
    return prep.missing(table("documents"), table("labels"), ["doc_id"])


@query("""
WITH a AS (SELECT conv_id, turn, CASE WHEN role = 'assistant' THEN 'ok' ELSE 'unknown' END AS status FROM conversations),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY status <> 'ok', CASE WHEN status = 'ok' THEN turn ELSE -turn END) AS r FROM a)
SELECT conv_id AS request, turn AS attempt, status FROM r WHERE r = 1""")
def first_resolved(table):
    rows = table("conversations").select(F.col("conv_id").alias("request"), F.col("turn").alias("attempt"), F.when(F.col("role") == "assistant", "ok").otherwise("unknown").alias("status"))
    return evals.first_resolved(rows)


# --- retrieval ---

_TERMS = f"list_filter(list_distinct(string_split({_collapse('lower(text)')}, ' ')), lambda t: length(t) >= 3)"
_KEYWORD = f"""
q AS (SELECT item_id AS query_id, {_TERMS} AS ts FROM benchmark), d AS (SELECT doc_id, lower(text) AS low FROM documents),
s AS (SELECT query_id, doc_id, len(list_filter(ts, lambda t: contains(low, t))) / len(ts)::DOUBLE AS score FROM q, d WHERE len(ts) > 0),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INT AS rank FROM s WHERE score > 0)"""
_BM25 = """
w AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS ws FROM documents),
x AS (SELECT doc_id, len(ws) AS len, unnest(ws) AS token FROM w), i AS (SELECT token, doc_id, len, count(*) AS tf FROM x GROUP BY ALL),
st AS (SELECT (SELECT count(*) FROM documents) AS n, (SELECT avg(len(ws)) FROM w WHERE len(ws) > 0) AS mean),
qt AS (SELECT DISTINCT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS token FROM benchmark),
f AS (SELECT token, count(*) AS df FROM i GROUP BY token),
b AS (SELECT query_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / mean))), 9) AS score FROM qt JOIN i USING (token) JOIN f USING (token), st GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INT AS rank FROM b WHERE score > 0)"""


def _benchmark_queries(table):
    return table("benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


@query(f"WITH {_KEYWORD} SELECT query_id, rank, doc_id, round(score, 9) AS score FROM k WHERE rank <= 5")
def keyword_rank(table):
    return retrieval.keyword_rank(table("documents"), _benchmark_queries(table), 5).withColumn("score", F.round("score", 9))


@query(f"WITH {_BM25} SELECT query_id, rank, doc_id, round(score, 6) AS score FROM r WHERE rank <= 5")
def bm25_topk(table):
    return retrieval.bm25(table("documents"), _benchmark_queries(table), 5).withColumn("score", F.round("score", 6))


@query(f"""
WITH {_KEYWORD}, {_BM25}, u AS (SELECT query_id, doc_id, rank FROM k WHERE rank <= 20 UNION ALL SELECT query_id, doc_id, rank FROM r WHERE rank <= 20),
z AS (SELECT query_id, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM u GROUP BY 1, 2), y AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INT AS rank FROM z)
SELECT query_id, rank, doc_id, score FROM y WHERE rank <= 10""")
def hybrid_rrf(table):
    asked = _benchmark_queries(table)
    return retrieval.fused(retrieval.keyword_rank(table("documents"), asked, 20), retrieval.bm25(table("documents"), asked, 20), "doc_id", 10)


@query("""
WITH s AS (SELECT q.vec_id AS query_id, d.vec_id, round(list_dot_product(q.embedding::DOUBLE[], d.embedding::DOUBLE[]) / (sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])) * sqrt(list_dot_product(d.embedding::DOUBLE[], d.embedding::DOUBLE[]))), 6) AS score
           FROM embeddings q, embeddings d WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""")
def vector_topk(table):
    asked = table("embeddings").filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    return retrieval.vector_top(table("embeddings"), asked, 5)


def _files(table):
    return table("documents").select(F.format_string("doc_%06d.txt", "doc_id").alias("file_name"), "text")


_LINES = """l AS (SELECT printf('doc_%06d.txt', doc_id) AS file_name, regexp_split_to_array(text, '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x{85}\\x{2028}\\x{2029}]') AS ls FROM documents),
e AS (SELECT file_name, unnest(range(1, len(ls) + 1))::INT AS line_no, unnest(ls) AS line, len(ls) AS n FROM l), f AS (SELECT file_name, line_no, line FROM e WHERE NOT (line_no = n AND line = ''))"""


@query(f"WITH {_LINES} SELECT * FROM f WHERE contains(lower(line), 'licensed under') ORDER BY file_name, line_no LIMIT 40")
def grep_lines(table):
    return retrieval.grep(retrieval.line_table(_files(table)), "Licensed under")


@query(f"WITH {_LINES} SELECT * FROM f WHERE file_name = 'doc_000000.txt' AND line_no BETWEEN 3 AND 12")
def read_slice(table):
    return retrieval.read_slice(retrieval.line_table(_files(table)), "doc_000000.txt", 2, 10)


@query("SELECT printf('doc_%06d.txt', doc_id) AS file_name FROM documents ORDER BY 1 LIMIT 250")
def list_docs(table):
    return retrieval.list_names(_files(table))


@query("""
WITH t AS (SELECT doc_id, text, list_min(list_filter(list_transform(['licensed', 'version', 'for'], lambda t: instr(lower(text), t)), lambda p: p > 0)) AS pos FROM documents),
w AS (SELECT doc_id, text, greatest(coalesce(pos, 1) - 1 - 166, 0) AS s, least(coalesce(pos, 1) - 1 + 333, length(text)) AS e FROM t)
SELECT doc_id, (CASE WHEN s > 0 THEN '...' ELSE '' END) || substr(text, s + 1, e - s) || (CASE WHEN e < length(text) THEN '...' ELSE '' END) AS snippet FROM w""")
def highlight(table):
    return table("documents").select("doc_id", tx.highlight(F.col("text"), F.lit("Licensed version for")).alias("snippet"))


# --- documents ---


@query()
def html_tables(table):
    return table("pages").select("page_id", F.size(chunking.html_tables("html")).alias("n_parts"))


@query()
def chunk_text(table):
    return chunking.chunk_documents(_files(table)).select("chunk_id", "file_name", "chunk_type", "char_count")


# --- streams in batch form ---


@query("""
WITH c AS (SELECT user_id, event_type = 'error' AS bad, row_number() OVER w AS n, count(*) OVER (w ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS seen, sum((event_type = 'error')::INT) OVER (w ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS k
           FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id AS worker, max(n) AS calls, arg_max(k, n)::BIGINT AS failures, coalesce(min(n) FILTER (seen >= 10 AND k > 0.25 * seen), -1) AS tripped_at FROM c GROUP BY 1""")
def failure_window(table):
    rows = table("events").select(F.col("user_id").alias("worker"), "ts", "event_id", (F.col("event_type") == "error").alias("failed"))
    return streams.failure_windows(rows, "worker", ["ts", "event_id"], "failed", 20, 10, 0.25).withColumn("tripped_at", F.coalesce("tripped_at", F.lit(-1)))


@query("""
WITH g AS (SELECT user_id, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS last, ts FROM events)
SELECT user_id, last, ts, round((epoch_us(ts) - epoch_us(last)) / 1e6, 6) AS gap_s FROM g WHERE (epoch_us(ts) - epoch_us(last)) / 1e6 > 86400""")
def heartbeat_gaps(table):
    return streams.heartbeat_gaps(table("events"), "user_id", "ts", 86400).withColumn("gap_s", F.round("gap_s", 6))


# --- episodes ---


def sample_episodes(spark: SparkSession) -> DataFrame:
    """Episodes that show each way a report can come out."""
    seen = [("obs_1", 1, "read", {}, "ok", 1, 2, "Receipts were $1,234 million."), ("obs_2", 2, "run_code", {}, "ok", 2, 3, "617"), ("obs_3", 3, "read", {}, "ok", 2, None, None)]
    step = lambda i, o, c, d="[]": f'{{"id":"{i}","observation":"{o}","claim":"{c}","depends_on":{d}}}'
    made = lambda answer, *path: f'{{"answer":"{answer}","path":[{",".join(path)}]}}'
    texts = {
        "good": made("617", step("s1", "obs_1", "receipts 1,234"), step("s2", "obs_2", "half is 617", '["s1"]')),
        "declined": '{"answer":"data not available","path":[]}',
        "prose": "I think it is 617.",
        "unknown": made("617", step("s1", "obs_9", "receipts 1,234")),
        "unseen": made("617", step("s1", "obs_3", "receipts 1,234")),
        "made up": made("617", step("s1", "obs_1", "receipts 9,876")),
        "forward": made("617", step("s1", "obs_1", "receipts 1,234", '["s2"]')),
        "fenced": "```json\n" + made("617", step("s1", "obs_1", "receipts 1,234")) + "\n```",
    }
    schema = f"episode_id string, terminal_text string, terminal_seen boolean, observations array<struct<{', '.join(f.strip().replace(' ', ':', 1) for f in episodes.OBSERVATION.replace('map<string,string>', 'MAP').split(','))}>>".replace("MAP", "map<string,string>")
    return spark.createDataFrame([(name, text, True, seen) for name, text in texts.items()], schema)


@query()
def report_checks(table):
    spark = table("region").sparkSession
    reports, seen = episodes.parsed(sample_episodes(spark)), episodes.ledger(sample_episodes(spark))
    verdicts = reports.select("episode_id", F.lit(True).alias("answer_correct"), F.lit(False).alias("over_budget"), F.lit("supported").alias("path_status"))
    return episodes.rewarded(reports, seen, verdicts)
