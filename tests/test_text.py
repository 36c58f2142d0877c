from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from agentlake.functions import stats
from agentlake.functions import text as tx


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(k) for k, c in columns.items())).first()


def L(x):
    return F.lit(x)


def A(*xs):
    return F.array(*map(F.lit, xs)).cast("array<string>")


def test_answers(spark):
    r = one(
        spark,
        n1=tx.normalise_answer(L("The old; mill.")), n2=tx.normalise_answer(L("  a  CAT ")), last=tx.last_answer(L("<answer>Oslo</answer> then <ANSWER>\n Lyon </ANSWER>")), none=tx.last_answer(L("x")),
        em=tx.exact_match(L("an A.B.C!"), A("the abc")), em0=tx.exact_match(L("It flows through Lyon, I think"), A("Lyon")), cover=tx.cover_match(L("It flows through Lyon, I think"), A("Lyon")),
        empty_em=tx.exact_match(L(""), A("the")), empty_cover=tx.cover_match(L(""), A("the")), f1=tx.token_f1(L("red red fox"), A("red fox den", "x")), f10=tx.token_f1(L(""), A("")), f1n=tx.token_f1(L("a"), A()),
        t1=tx.holds_tokens(L("a thousand ships"), L("sand")), t2=tx.holds_tokens(L("Up the Green River Valley"), L("green river")), t3=tx.holds_tokens(L("River so green"), L("green river")), t4=tx.holds_tokens(L("x"), L("the")),
        s=tx.gold_surfaced(A("the boat went", "up Green River"), A("green river")), clean=tx.clean_answers(A(" Lyon ", "lyon", "", "Oslo", "OSLO")),
        pid=tx.passage_id(L("London to Brighton (disambiguation)"), L("London to Brighton is a 2006 film by Paul Andrew Williams.")),
    )
    assert (r.n1, r.n2, r.last, r.none) == ("old mill", "cat", "Lyon", None)
    assert (r.em, r.em0, r.cover, r.empty_em, r.empty_cover) == (True, False, True, True, False)
    assert abs(r.f1 - 2 * 2 / 6) < 1e-12 and r.f10 == 1.0 and r.f1n == 0.0
    assert (r.t1, r.t2, r.t3, r.t4, r.s) == (False, True, False, False, True)
    assert r.clean == ["Lyon", "Oslo"] and r.pid == "p_001d85ff5b6ee6720bd8"


def test_scores_need_an_answer_outside_tools(spark):
    score = lambda text, tools: one(spark, s=tx.score_segments(L(text), tools, A("Lyon"), 0.1, 0.2)).s
    assert score("<tool_call>x <answer>Lyon</answer>", A())["score"] == 1.0 and score("<tool_call>", A())["n_tool_calls"] == 1
    assert abs(score("<answer>Oslo</answer>", A("by Lyon"))["score"] - 0.3) < 1e-12
    assert score("no answer", A("(Lyon)"))["score"] == 0.2 and score("no answer", A())["has_answer"] == 0


def test_small_functions(spark):
    r = one(
        spark,
        clip=tx.clip(L("abcdef"), 3, "!"), date=tx.file_month(L("bulletin_2024_03.txt")), nodate=tx.file_month(L("x")), name=tx.text_name(L("/a/b/c")), level=tx.level_number(L("Level 3")), nolevel=tx.level_number(L("none")),
        i=tx.coerce_int(L(" 7 "), 1), j=tx.coerce_int(L("x"), 1), head=tx.head_tail(L("a" * 50 + "b" * 50), 10), titles=tx.surfaced_titles(L("[1] A title  score=0.5\ntext\n[2] Other")), outcome=tx.tool_outcome(L("No documents found")),
        err=tx.tool_outcome(L("Error: x")), ok=tx.tool_outcome(L("Now")), blank=tx.tool_outcome(L(" \n")), fmt=tx.tool_format(L('<tool_call>\n{"name": "x"}')), kind=tx.http_class(L(503)), safe=tx.safe_name(L("a/b c.json")),
        ctx=tx.with_context(L("body"), L("f.txt"), L(""), L("Head")), lines=tx.lines(L("a\r\nb\x0bc\n")), parts=tx.image_parts(L("<image>What?")), gold=tx.gold_list(F.parse_json(L('{"target": ["a", " "]}'))), gold2=tx.gold_list(F.parse_json(L('"b"'))),
        present=tx.first_present([L(""), L("x")]), high=tx.highlight(L("z" * 400 + " needle " + "y" * 400), L("needle at")),
    )
    assert (r.clip, r.date, r.nodate, r.name, r.level, r.nolevel, r.i, r.j) == ("abc!", "2024-03", "", "c.txt", 3, None, 7, 1)
    assert r.head.startswith("aaa\n") and "90 characters" in r.head and r.head.endswith("bbbbbbb") and r.titles == ["A title", "Other"]
    assert (r.outcome, r.err, r.ok, r.blank, r.fmt, r.safe) == ("empty", "error", "ok", "empty", "HERMES_JSON", "a_b_c.json")
    assert r.kind["retryable"] and r.ctx == "Document: f.txt\nSection: Head\n\nbody" and r.lines == ["a", "b", "c"]
    assert [p["type"] for p in r.parts] == ["image", "text"] and r.gold == ["a"] and r.gold2 == ["b"] and r.present == "x"
    assert r.high.startswith("...") and "needle" in r.high and r.high.endswith("...") and len(r.high) == 505


@settings(max_examples=10, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("ab \n\r\t\x0b\x1c\x85   é"), max_size=30), min_size=1, max_size=20))
def test_white_space_is_pythons(spark, texts):
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", tx.collapse("t").alias("c"), tx.lines("t").alias("l"), tx.strip("t").alias("s")).collect()
    for r in rows:
        assert r.c == " ".join(r.t.split()) and r.s == r.t.strip() and r.l == r.t.splitlines()


def test_statistics(spark):
    i = lambda x: F.lit(x)
    r = one(
        spark, w=stats.wilson(i(10), i(64)), w0=stats.wilson(i(0), i(0)), a=stats.pass_at_k(i(4), i(1), 1), b=stats.pass_at_k(i(4), i(1), 3), c=stats.pass_at_k(i(4), i(2), 3), d=stats.pass_at_k(i(4), i(0), 3),
        m=stats.mcnemar(i(13), i(4)), m0=stats.mcnemar(i(0), i(0)), big=stats.mcnemar(i(2000), i(2100)),
    )
    assert 0.08 < r.w["low"] < 0.10 and 0.26 < r.w["high"] < 0.28 and tuple(r.w0) == (0.0, 1.0)
    assert (round(r.a, 9), round(r.b, 9), r.c, r.d) == (0.25, 0.75, 1.0, 0.0)
    assert abs(r.m - 0.0490417) < 1e-6 and r.m0 == 1.0 and 0.1 < r.big < 0.14
    try:
        one(spark, x=stats.pass_at_k(i(2), i(1), 3))
    except Exception as e:
        assert "pass@k" in str(e)
    else:
        raise AssertionError("k > n must fail")
