import pytest
from pyspark.sql import functions as F

from agentlake.functions.register import register, reward, tool
from agentlake.operators import corpus, episodes, evals, prep
from agentlake.plans import pipelines


def test_register(spark):
    register(spark)
    r = spark.sql("SELECT calculate('2+3') AS a, math_answer('\\\\\\\\boxed{4}') AS b, grade_answer('1/2', '0.5') AS c, judge_status('x') AS d").first()
    assert tuple(r) == ("5", "4", True, "unknown")
    rows = spark.sql("SELECT l.* FROM VALUES ('a\\nb') AS t(x), LATERAL lines_of(x) AS l").collect()
    assert [tuple(x) for x in rows] == [(1, "a"), (2, "b")]


def test_rewards_keep_their_keys(spark):
    def score(solution, truth):
        if solution == "boom":
            raise ValueError
        return {"score": float(solution == truth)} if solution else {}

    f = reward(score, ("score", "format"))
    df = spark.createDataFrame([("a", "a"), ("b", "a"), ("", "a"), ("boom", "a")], "s string, t string")
    got = [tuple(r["r"]) for r in df.select(f(solution=F.col("s"), truth=F.col("t")).alias("r")).collect()]
    assert got == [(1.0, 0.0, 0.0), (0.0, 0.0, 0.0), (0.0, 0.0, 0.0), (0.0, 0.0, 1.0)]
    with pytest.raises(ValueError, match="missing q, unknown z"):
        tool(lambda **k: None, ("q",), ("q",))(z=1)


def test_policies_and_checks(spark):
    r = spark.range(1).select(
        prep.model_label(F.lit("run"), F.lit(7), F.lit("hub"), F.lit(""), F.lit("dir")).alias("a"), prep.model_label(F.lit(""), F.lit(7), F.lit(""), F.lit("given"), F.lit("dir")).alias("b"),
        prep.filled_policy(F.create_map(F.lit("k"), F.lit("v"))).alias("c"), prep.safe_identifier(F.lit("a.b_1")).alias("d"), prep.safe_identifier(F.lit("a;b")).alias("e"), corpus.dotted(F.lit('{"a": {"b": 3}}'), "a.b").alias("f"), corpus.dotted(F.lit("no"), "a", "z").alias("g"),
    ).first()
    assert (r.a, r.b, r.c, r.d, r.e, r.f, r.g) == ("run/global_step_7", "given", {"k": "v", "samples_per_question": "1"}, True, False, "3", "z")
    rules = spark.createDataFrame([("lr", "float", 0.0, 1.0, None), ("n", "int", 1.0, 8.0, None), ("mode", "enum", None, None, ["a", "b"]), ("on", "bool", None, None, None)], "name string, kind string, low double, high double, choices array<string>")
    knobs = spark.createDataFrame([("lr", "2"), ("n", "1.5"), ("mode", "c"), ("on", "yes"), ("zz", "1")], "name string, value string")
    assert dict(prep.knob_problems(knobs, rules).collect()) == {"lr": "out of bounds", "n": "not an integer", "mode": "not a choice", "on": "not a boolean", "zz": "unknown"}
    assert prep.indivisible(spark.createDataFrame([(8, 3)], "a int, b int"), [("a", "b")]).first()["indivisible"] == ["a % b"]
    nodes = spark.createDataFrame([("x",), ("y",)], "node string")
    assert [tuple(p) for p in prep.unreached(nodes, spark.createDataFrame([("x", "y", True)], "src string, dst string, ok boolean")).collect()] == [("y", "x")]
    assert prep.owned(nodes.withColumnRenamed("node", "name"), spark.createDataFrame([("x", "owner", "me"), ("y", "owner", "me")], "name string, key string, value string"), "me", ["y"]).count() == 1
    held = evals.heldout_package(spark.createDataFrame([("p", 1, "2hop", 1), ("p", 1, "3hop1", 0)], "policy string, checkpoint int, hop_type string, correct int"))
    assert sorted((h["all_hops"], h["hops"] or "", h["n"], h["correct"]) for h in held.collect()) == [(0, "2hop", 1, 1), (0, "3hop", 1, 0), (1, "", 2, 1)]
    assert evals.gpu_hours(spark.createDataFrame([(8, 30, 1)], "gpus int, minutes int, retries int")).first()[0] == 8.0
    assert evals.judged_ratio(spark.createDataFrame([(0.5, 1.0, 1.0), (0.0, 0.0, 0.0)], "judge_score double, judge_valid double, agreement double")).first()[0] == 0.5


def test_preview(spark):
    v = lambda status, path, score: F.struct(F.lit(status).alias("status"), F.lit(path).alias("path_status"), F.lit(score).cast("double").alias("score"))
    ok, T, N = v("ok", "supported", 0.8), F.lit(True), F.lit(None).cast("boolean")
    cases = {
        "ABSTENTION": ("abstention", F.lit(False), T, ok, N), "ZERO": ("valid", F.lit(False), T, ok, T), "UNKNOWN": ("valid", T, T, v("unknown", None, None), T), "ZERO2": ("valid", T, T, v("ok", "unsupported", 0.0), T),
        "UNKNOWN2": ("valid", T, T, ok, N), "ZERO3": ("valid", T, T, ok, F.lit(False)), "SCORED": ("valid", T, T, ok, T), "ZERO4": ("valid", T, F.lit(False), ok, T),
    }
    r = spark.range(1).select(*(episodes.preview(F.lit(k), a, b, c, d).alias(n) for n, (k, a, b, c, d) in cases.items())).first()
    assert all(r[n]["status"] == n.rstrip("1234") for n in cases) and r["SCORED"]["score"] == 0.8 and r["UNKNOWN"]["score"] is None and r["ZERO"]["score"] == 0.0


def test_pipelines(spark, tmp_path):
    rows = [("q1", 0, "T", "a text that is long enough", True), ("q1", 1, "T", "short", False), ("q2", 0, "T", "a text  that is long enough", True)]
    df = spark.createDataFrame(rows, "id string, pos int, title string, text string, supporting boolean").withColumn("source", F.lit("s")).withColumn("split", F.lit("train"))
    m = pipelines.build_corpus(spark, f"{tmp_path}/c", {"s": lambda: df})
    assert {o["name"]: o["rows"] for o in m["outputs"]} == {"passages": 1, "audit": 1, "origins": 1}
    a = spark.read.parquet(f"{tmp_path}/c/audit.parquet").first()
    assert (a.questions, a.paragraphs, a.supporting, a.supporting_kept, a.questions_fully_supported) == (2, 3, 2, 2, 2)
    q = spark.range(100).select(F.format_string("q%03d", "id").alias("source_id"), F.when(F.col("id") % 4 == 0, "2hop").otherwise("3hop").alias("hop_type"), F.col("id").alias("pos"))
    one, two = (pipelines.make_splits(spark, f"{tmp_path}/s{i}", q.repartition(i + 1), 20, 40, "7") for i in range(2))
    assert one["test_n"] == 40 and one["test_ids_sha256"] == two["test_ids_sha256"]


def test_tables_and_aggregates_in_sql(spark):
    """Table functions over a table argument equal the DataFrame operators; a missing column is named."""
    from agentlake.operators import retrieval

    register(spark)
    docs = spark.createDataFrame([(i, f"f{i % 4}.txt", f"alpha {'beta' if i % 2 else 'BETA gamma'}\nline {i}") for i in range(40)], "doc_id long, file_name string, text string").repartition(3)
    docs.createOrReplaceTempView("t_docs")
    retrieval.line_table(docs).createOrReplaceTempView("t_lines")
    rows = lambda df: sorted(map(tuple, df.collect()))
    lines = spark.table("t_lines")
    assert rows(spark.sql("SELECT * FROM grep_lines(TABLE(t_lines), 'Beta G')")) == rows(retrieval.grep(lines, "beta g", limit=100))
    assert rows(spark.sql("SELECT * FROM read_lines(TABLE(t_lines), 'f1.txt', 1, 900)")) == rows(retrieval.read_slice(lines, "f1.txt", 1, 900))
    assert rows(spark.sql("SELECT * FROM list_names(TABLE(t_docs), 'f')")) == rows(retrieval.list_names(docs, "f"))
    asked = spark.createDataFrame([(1, "gamma alpha delta")], "query_id long, query string")
    got = spark.sql("SELECT doc_id, score FROM search_docs(TABLE(t_docs), 'gamma alpha delta', 7) ORDER BY score DESC, doc_id LIMIT 7").collect()
    assert [tuple(r) for r in got] == [(r["doc_id"], r["score"]) for r in retrieval.keyword_rank(docs, asked, 7).orderBy("rank").collect()]
    with pytest.raises(Exception, match="line_no"):
        spark.sql("SELECT * FROM grep_lines(TABLE(t_docs), 'x')").collect()
    p = spark.sql("SELECT g, sign_flip_p(d) AS p FROM VALUES ('up', 1), ('up', 1), ('up', 1), ('up', 1), ('up', 1), ('up', 1), ('up', 1), ('up', 1), ('even', 1), ('even', -1), ('even', NULL), ('none', 0) AS t(g, d) GROUP BY g").collect()
    p = dict(map(tuple, p))
    assert p["even"] == p["none"] == 1.0 and 0.002 < p["up"] < 0.02
