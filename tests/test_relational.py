"""Preparation, corpora, retrieval, evaluation, pairs, traces, episodes."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from agentlake.functions import structured as js
from agentlake.operators import corpus, episodes, evals, paired, prep, retrieval, traces
from agentlake.operators.order import global_index
from agentlake.plans.queries import sample_episodes


def values(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_global_index_and_prefix(spark):
    df = spark.range(1000).select(((F.col("id") * 7919) % 1000).alias("k")).repartition(7)
    assert all(r["k"] == r["row_index"] for r in global_index(df, ["k"]).collect())
    assert global_index(df.limit(0), ["k"]).count() == 0


def test_allocation_and_hash_pick(spark):
    counts = spark.createDataFrame([("2hop", 752), ("3hop", 760), ("4hop", 405)], "stratum string, size long")
    assert values(prep.allocation(counts, 500), "stratum", "want") == [("2hop", 196), ("3hop", 198), ("4hop", 106)]
    df = spark.range(100).select((F.col("id") % 2).cast("string").alias("s"), F.col("id").alias("k"))
    want = sorted(((str(k % 2), k) for k in range(100)), key=lambda x: hashlib.sha256(str(x[1]).encode()).hexdigest())
    expected = sorted(x for s in "01" for x in [w for w in want if w[0] == s][:5])
    assert values(prep.hash_pick(df, "s", "k", 5), "s", "k") == expected == values(prep.hash_pick(df.repartition(5).orderBy(F.rand()), "s", "k", 5), "s", "k")


def test_rows_and_reasons(spark):
    schema = "id string, question string, answer string, answer_aliases array<string>, answerable boolean, question_decomposition array<struct<id:int>>"
    df = spark.createDataFrame([("a", " q? ", "Rome", ["rome", "Roma"], None, [(1,), (2,)]), ("b", "q", "x", [], False, []), ("c", " ", "x", None, True, None), ("d", "q", " ", None, True, None)], schema)
    rows = {r["id"]: r for r in prep.multi_hop_rows(df).collect()}
    assert rows["a"]["answers"] == ["Rome", "Roma"] and rows["a"]["hop_type"] == "2hop" and rows["a"]["drop_reason"] is None and rows["a"]["question"] == "q?"
    assert [rows[k]["drop_reason"] for k in "bcd"] == ["unanswerable", "no question", "no answer"]
    assert values(prep.conversion_stats(prep.multi_hop_rows(df)), "reason", "n") == [("kept", 1), ("no answer", 1), ("no question", 1), ("unanswerable", 1)]
    math = spark.createDataFrame([("p", "so \\boxed{2}", "Level 3"), ("p", "no box", "Level 3"), ("p", "\\boxed{1}", "Level 1")], "problem string, solution string, level string")
    assert [r["keep"] for r in prep.math_rows(math, [3, 4, 5]).collect()] == [True, False, False]


def test_sets(spark):
    a, b = (spark.createDataFrame([(x,) for x in xs], "id string") for xs in ("abc", "bcd"))
    assert values(prep.overlap(a, b, ["id"]), "id") == [("b",), ("c",)] and values(prep.missing(a, b, ["id"]), "id") == [("a",)]
    assert values(prep.unequal_ids(a, b, "id"), "id", "side") == [("a", "a"), ("d", "b")] and prep.repeated(a.union(b), "id").count() == 2
    cks = spark.createDataFrame([("s1", 1, True), ("s2", 2, True), ("s3", 3, False)], "name string, step int, complete boolean")
    assert values(prep.retention(cks, ["s1"]).filter("keep"), "name") == [("s1",), ("s2",)]
    with pytest.raises(ValueError):
        prep.retention(cks, ["zz"])
    r = spark.range(1).select(
        prep.map_difference(F.create_map(F.lit("a"), F.lit(1), F.lit("b"), F.lit(2)), F.create_map(F.lit("a"), F.lit(1), F.lit("c"), F.lit(2))).alias("d"),
        prep.without_credentials(F.create_map(F.lit("HF_TOKEN"), F.lit("x"), F.lit("LR"), F.lit("y"))).alias("m"), prep.argument_problems(F.create_map(F.lit("q"), F.lit("x"), F.lit("z"), F.lit("y")), ["q", "k"], ["q", "k"]).alias("p"),
    ).first()
    assert r.d == ["b", "c"] and r.m == {"LR": "y"} and r.p["missing"] == ["k"] and r.p["unknown"] == ["z"]
    x = prep.replicated(spark.createDataFrame([("u",)], "uid string"), 2)
    assert values(x, "uid", "group") == [("u#0", "u"), ("u#1", "u")]
    u = prep.reindexed([a.withColumn("pos", F.lit(0)), b.withColumn("pos", F.lit(1))], "id")
    assert [r["id"] for r in u.orderBy("index").collect()] == list("abcbcd")


def test_corpus(spark):
    schema = "id string, paragraphs array<struct<idx:int,title:string,paragraph_text:string,is_supporting:boolean>>"
    nested = corpus.paragraphs(spark.createDataFrame([("q1", [(0, " T ", "a  text that is long enough", True), (1, "T", "short", False)])], schema))
    schema = "id string, supporting_facts struct<title:array<string>,sent_id:array<int>>, context struct<title:array<string>,sentences:array<array<string>>>"
    flat = corpus.parallel_contexts(spark.createDataFrame([("q2", (["T"], [0]), (["T", "U"], [["a text that", " is long enough "], [" ", "other text that is long"]]))], schema))
    union, state = corpus.all_sources({"n": lambda: nested, "f": lambda: flat})
    kept = corpus.passages(union)
    firsts = corpus.first_of_each(kept, "id", ["source_order", "id", "pos"])
    assert state["complete"] and kept.count() == 3 and firsts.count() == 2 and values(firsts, "title", "source_order") == [("T", 0), ("U", 1)]

    def broken():
        raise OSError("gone")

    assert corpus.all_sources({"n": lambda: nested, "x": broken}, allow_partial=True)[1]["failed"]
    with pytest.raises(OSError):
        corpus.all_sources({"x": broken})
    rows = [("b", "é"), ("a", "x")]
    df = spark.createDataFrame(rows, "a string, b string")
    golden = hashlib.sha256("".join(sorted(hashlib.sha256(json.dumps(list(r)).encode()).hexdigest() for r in rows)).encode()).hexdigest()
    digest = corpus.json_row_digest([F.col("a"), F.col("b")])
    assert corpus.content_digest(df, digest).first()["digest"] == golden == corpus.content_digest(df.repartition(2).orderBy("a"), digest).first()["digest"]
    files = spark.createDataFrame([("z/b.txt", "B"), ("a.txt", "A")], "path string, text string")
    want = hashlib.sha256("".join(f"{n}\0{hashlib.sha256(t.encode()).hexdigest()}\n" for n, t in (("a.txt", "A"), ("b.txt", "B"))).encode()).hexdigest()
    assert corpus.archive_identity(files).first()[0] == want
    with pytest.raises(Exception, match="repeated basenames"):
        corpus.archive_identity(files.union(spark.createDataFrame([("q/a.txt", "C")], files.schema))).collect()


def test_retrieval(spark):
    docs = spark.createDataFrame([(1, "the party of kings", "d_1941_01.txt"), (2, "art and law\nLAW again", "d_1942_01.txt"), (3, "nothing here", "x.txt")], "doc_id int, text string, file_name string")
    q = spark.createDataFrame([("a", "art law zz"), ("b", "art law zz"), ("c", "x")], "query_id string, query string")
    assert values(retrieval.keyword_rank(docs, q, 5), "query_id", "doc_id", "rank") == [("a", 1, 2), ("a", 2, 1), ("b", 1, 2), ("b", 2, 1)]
    assert values(retrieval.bm25(docs, q, 5), "query_id", "doc_id") == [("a", 2), ("b", 2)]
    lines = retrieval.line_table(docs)
    assert values(retrieval.grep(lines, "law"), "file_name", "line_no") == [("d_1942_01.txt", 1), ("d_1942_01.txt", 2)] and retrieval.grep(lines, "a", year="1941").count() == 1 and retrieval.grep(lines, "^L.W", regex=True).count() == 1
    assert retrieval.bad_pattern(docs, "(").startswith("Error") and retrieval.bad_pattern(docs, "a+") is None
    assert values(retrieval.read_slice(lines, "d_1942_01.txt", 1, 1000), "line") == [("LAW again",)] and retrieval.list_names(docs, limit=2).count() == 2
    p = spark.createDataFrame([("1", "Rome", "b"), ("0", " rome ", "a"), ("2", "Rome x", "c")], "id string, title string, text string")
    assert retrieval.article(p, "ROME").first()[0] == "a\nb"
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 1.0]), (3, [0.0, 1.0])], "vec_id int, embedding array<float>")
    top = retrieval.vector_top(v, v.filter("vec_id = 1").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")), 2)
    assert values(top, "rank", "vec_id") == [(1, 1), (2, 2)]
    f = retrieval.fused(top.withColumnRenamed("vec_id", "k"), top.withColumnRenamed("vec_id", "k"), "k", 1)
    assert values(f, "k") == [(1,)]
    res = spark.createDataFrame([("q", 1, "s", "1941-01", 0.5, "snip")], "query_id string, rank int, source string, date string, score double, snippet string")
    assert retrieval.search_text(res).first()["text"] == "[1] s (1941-01)  score=0.50\n    snip"


def test_evaluation(spark):
    rows = [(g, i, r, "scored") for g, rs in {"right": [1, 1], "wrong": [0, 0], "mixed": [0, 1]}.items() for i, r in enumerate(rs)] + [("bad", 0, 1, "timeout"), ("bad", 1, 0, "scored")]
    df = spark.createDataFrame([(g, i, float(r), s) for g, i, r, s in rows], "uid string, sample int, reward double, status string")
    v = evals.group_variance(evals.group_spread(df, "uid")).first()
    assert v.groups == 3 and all(abs(x - 1 / 3) < 1e-12 for x in (v.all_wrong_share, v.all_right_share, v.mixed_share)) and abs(v.mean_std - 0.5 / 3) < 1e-12
    s = evals.summary(df, 2).first()
    assert (s.questions, s.fully_scored, s.successes, s.pass_1, s.pass_3, s.mixed, s.zero, s["all"]) == (4, 3, 3, 0.5, None, 1, 1, 1)
    ver = evals.verdict(df, 8).first()
    assert ver.timeout == 1 and not ver.valid and ver.reasons == ["infrastructure errors"] and evals.verdict(df.limit(0)).first().reasons == ["no results"]
    assert values(evals.mixed_uids(df.filter("uid <> 'bad'"), 2), "uid") == [("mixed",)]
    with pytest.raises(Exception, match="incomplete"):
        evals.mixed_uids(df, 2).collect()
    lat = spark.createDataFrame([(float(x),) for x in [5, 1, 2, 2, 9]], "v double")
    assert tuple(evals.latency(lat, "v").first()) == (5, 2.0, 9.0)
    att = spark.createDataFrame([("r", 1, "unknown"), ("r", 2, "ok"), ("r", 3, "ok"), ("s", 1, "unknown"), ("s", 2, "unknown")], "request string, attempt int, status string")
    assert values(evals.first_resolved(att), "request", "attempt") == [("r", 2), ("s", 2)]
    b = spark.createDataFrame([(1.0, 0.6), (1.0, None)], "rule double, judge double").select(evals.blended().alias("x")).collect()
    assert b[0].x["score"] == 0.8 and b[1].x["score"] == 1.0 and b[1].x["judge_valid"] == 0
    ok = spark.createDataFrame([(True,), (True,), (False,)], "ok boolean")
    assert evals.calibration(ok, 0.6).first()["calibrated"] and not evals.calibration(ok, 0.7).first()["calibrated"]


def test_pairs(spark):
    base = spark.createDataFrame([(str(i), int(i < 2)) for i in range(20)], "uid string, correct int")
    final = spark.createDataFrame([(str(i), int(2 <= i < 9)) for i in range(20)], "uid string, correct int")
    c = paired.paired_counts(paired.aligned(base, final)).first()
    assert (c.gained, c.lost, c.delta) == (7, 2, 0.25)
    swap = spark.createDataFrame([(0, 1), (1, -1)], "i int, d int")
    ci = paired.bootstrap(swap, 2, 400).first()
    assert (ci.low, ci.high) == (-1.0, 1.0)
    ranks = paired.bootstrap(swap, 2, 400, exact=False).first()
    assert (ranks.low, ranks.high) == (-1.0, 1.0)
    # ten checkpoints of unrelated 13 / 4 gains: the best alone is p 0.049, all ten make it common
    rows = [(k * 100 + i, k, 1 if i < 13 else -1) for k in range(10) for i in range(17)]
    p = paired.max_stat_p(spark.createDataFrame(rows, "uid int, checkpoint int, d int"), 1000).first()["p"]
    assert 0.2 < p < 0.5
    assert paired.best_checkpoint(spark.createDataFrame([(1, 5, 2), (2, 4, 1), (3, 1, 0)], "checkpoint int, gained int, lost int")).first()[0] == 1
    before = spark.createDataFrame([("a", "u", 0.0), ("a", "u", 1.0), ("a", "v", 1.0)], "split string, uid string, x double")
    assert tuple(paired.compare(before, before.withColumn("x", F.lit(1.0)), "x").first())[1:] == (2, 0.75, 1.0, 0.25, 1, 0, 1)
    turns = spark.createDataFrame([("c", 1, "x"), ("c", 2, None)], "c string, turn int, a string")
    assert paired.last_answers(turns, "c", F.col("a")).first()["answer"] == "x"
    assert paired.first_per_key(turns, ["c"], ["turn"], 3).count() == 1


def test_traces(spark):
    df = spark.createDataFrame([(True, True)] * 3 + [(True, False)] + [(False, True), (False, False)], "surfaced boolean, correct boolean")
    d = traces.decomposition(df).first()
    assert abs(d.p_surfaced * d.right_given_surfaced - 3 / 6) < 1e-12 and abs((1 - d.p_surfaced) * d.right_given_not - 1 / 6) < 1e-12 and traces.decomposition(df.filter("surfaced")).first().right_given_not is None
    rec = spark.createDataFrame([(["a", "b"], ["a", "b"], 1.0), (["a", "b"], ["a"], 0.0)], "wanted array<string>, surfaced array<string>, em double")
    assert tuple(traces.supporting_recall(rec).first()) == (2, 0.75, 0.5, 1.0)
    t = spark.createDataFrame([("q1", "u1"), ("q2", "u2")], "question string, uid string")
    side = spark.createDataFrame([("q1", ["byq"]), ("u1", ["byu"]), ("u2", ["byu"])], "key string, titles array<string>")
    assert values(traces.with_supporting(t, side), "uid", "supporting_titles") == [("u1", ["byq"]), ("u2", ["byu"])]
    turns = spark.createDataFrame([("c", 0, "a", "ab"), ("c", 1, "a", "c"), ("c", 2, "t", ""), ("c", 3, "t", "de")], "c string, turn int, role string, text string")
    assert values(traces.role_runs(turns, "c", "turn", F.col("role")), "role", "start", "end") == [("a", 0, 3), ("t", 3, 5)]
    sp = lambda *s: F.array(*(F.struct(F.lit(r).alias("role"), F.lit(a).alias("start"), F.lit(b).alias("end")) for r, a, b in s))
    r = spark.range(1).select(traces.split_spans(F.lit("abcde"), sp(("a", 0, 3), ("t", 3, 5))).alias("x"), traces.split_spans(F.lit("abcde"), sp(("a", 0, 3), ("t", 4, 5))).alias("gap"), traces.split_spans(F.lit("abcde"), sp(("a", 0, 3))).alias("short")).first()
    assert [p["text"] for p in r.x] == ["abc", "de"] and r.gap is None and r.short is None
    tr = spark.createDataFrame([("u", "2hop", "rome", 0.0, 0.0, 0.0, ["Rome"], ["in Rome"])], "uid string, hop_type string, pred string, em double, cover_em double, f1 double, gt array<string>, tool_texts array<string>")
    assert traces.diagnosed(tr).first()["bucket"] == "SURFACED_MISSED" and traces.examples(traces.diagnosed(tr), "bucket", "uid").count() == 1


def test_reports_and_rewards(spark):
    eps = sample_episodes(spark)
    reports, seen = episodes.parsed(eps), episodes.ledger(eps)
    verdicts = eps.select("episode_id", F.lit(True).alias("answer_correct"), F.lit(False).alias("over_budget"), F.lit("supported").alias("path_status"))
    got = dict(values(episodes.rewarded(reports, seen, verdicts), "episode_id", "category"))
    assert got == {"good": "correct", "declined": "abstention", "prose": "malformed", "unknown": "invalid_path", "unseen": "invalid_path", "made up": "fabricated", "forward": "malformed", "fenced": "correct"}
    assert dict(values(episodes.rewarded(reports, seen, verdicts.withColumn("path_status", F.lit(None).cast("string"))), "episode_id", "category"))["good"] == "infrastructure"
    twice = eps.withColumn("observations", F.concat("observations", "observations"))
    with pytest.raises(Exception, match="repeated observation"):
        episodes.ledger(twice).collect()
    req = spark.createDataFrame([("good", 1), ("good", 2), ("good", 3)], "episode_id string, request int")
    assert ("good", "obs_1", 2) in values(episodes.delivered_at(seen.filter("episode_id = 'good'"), req), "episode_id", "observation_id", "delivered_to_request")
    long = spark.range(1).select(episodes.recorded(F.lit("x" * 200), F.lit("obs_1"), 100).alias("r"), episodes.recorded(F.lit("x"), F.lit("obs_1"), 100).alias("s")).first()
    assert len(long.r["text"]) == 100 and long.r["text"].endswith("...(truncated)") and long.s["text"] == "[observation obs_1]\nx"
    hist = spark.createDataFrame([("e", 1, "aaa"), ("e", 2, "éé"), ("e", 3, "z")], "episode_id string, `order` int, text string")
    assert [r["text"] for r in episodes.bounded_history(hist, 6).orderBy("order").collect()] == ["aaa", "é"]
    ev = spark.createDataFrame([("e", 1, True, 5), ("e", 2, False, 6), ("e", 3, False, 3), ("f", 1, True, 50)], "episode_id string, `order` int, cited boolean, tokens int")
    assert values(episodes.evidence(ev, 10), "episode_id", "over_budget", "uncited_kept", "tokens") == [("e", False, [3], 8), ("f", True, [], 50)]


def test_json_rules():
    assert js.parse_report('{"answer":"x","answer":"y","path":[]}')["kind"] == "malformed"
    assert js.object_blocks('a {"x": "}"} b {y}') == ['{"x": "}"}', "{y}"]
    two = '{"answer":"1","path":[]} {"answer":"2","path":[]}'
    assert js.parse_report(two)["errors"] == ["2 candidate objects"] and js.parse_report("x" * 30_000)["kind"] == "malformed"
    ok = '{"path_status":"supported","path_score":0.9,"issues":[]}'
    assert js.support_verdict("I say " + ok)["status"] == "ok" and js.strict_support_verdict(ok, "stop")["score"] == 0.9
    for bad in ("", "no", '{"path_status":"supported"}', '{"path_status":"supported","path_score":"0.9"}', '{"path_status":"supported","path_score":true}', '{"path_status":"supported","path_score":0}', '{"path_status":"unsupported","path_score":0.5}', '{"path_status":"unknown"}'):
        assert js.support_verdict(bad)["status"] == "unknown"
    for bad, fin in ((ok, "length"), (ok + " ", None), ("x " + ok, "stop"), ('{"path_status":"supported","path_score":NaN,"issues":[]}', "stop"), ('{"path_status":"supported","path_score":0.9,"issues":[1]}', "stop"), ('{"path_status":"supported","path_score":0.9}', "stop")):
        assert js.strict_support_verdict(bad, fin)["status"] == "unknown"
    assert js.graded_verdict('{"correct": true, "score": 0.7}') == {"score": 0.7, "error": None} and js.graded_verdict('{"correct": "true", "score": 1}')["error"] == "correct" and js.graded_verdict('{"correct": true, "score": 0.2}')["error"] == "contradiction"
