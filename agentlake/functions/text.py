"""Text as Column expressions: white space, answers, snippets, names, outcomes. All stay in the JVM."""

from __future__ import annotations

import string
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# What str.split() and str.splitlines() treat as white space and line ends.
WS = r"[\s\x1c-\x1f\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
NL = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body (or a lambda in it) uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(c: Column | str) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(F.regexp_replace(col(c), f"^{WS}+", ""), f"{WS}+$", "")


def collapse(c: Column | str) -> Column:
    """Runs of white space become one space, none at the ends."""
    return F.trim(F.regexp_replace(col(c), f"{WS}+", " "))


def lines(c: Column | str) -> Column:
    """The text's lines, without an empty one after a final line end."""
    parts = F.split(col(c), NL)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def normalise_answer(c: Column | str) -> Column:
    """Lower case, ASCII punctuation deleted, then articles, then white space collapsed."""
    bare = F.translate(F.lower(col(c)), string.punctuation, "")
    return collapse(F.regexp_replace(bare, r"(?U)\b(a|an|the)\b", " "))


def last_answer(c: Column | str) -> Column:
    """The last <answer> block, stripped; null without one."""
    found = F.regexp_extract_all(col(c), F.lit(r"(?is)<answer>(.*?)</answer>"), F.lit(1))
    return strip(F.try_element_at(found, F.lit(-1)))


def exact_match(pred: Column, golds: Column) -> Column:
    """Some normalised gold equals the normalised prediction, empty strings included."""
    return let(normalise_answer(F.coalesce(pred, F.lit(""))), lambda p: F.exists(golds, lambda g: normalise_answer(g) == p))


def cover_match(pred: Column, golds: Column) -> Column:
    """Some non-empty normalised gold is a substring of the normalised prediction."""
    return let(normalise_answer(F.coalesce(pred, F.lit(""))), lambda p: F.exists(F.transform(golds, normalise_answer), lambda g: (g != "") & F.contains(p, g)))


def _tokens(c: Column) -> Column:
    return F.filter(F.split(normalise_answer(c), " "), lambda t: t != "")


def _unshared(p: Column, g: Column) -> Column:
    """How many tokens of either side the other doesn't hold as often: one pass over both sides, sorted together."""
    side = lambda xs, n: F.transform(xs, lambda t: F.struct(t.alias("t"), F.lit(n).alias("n")))
    start = F.struct(F.lit("").alias("t"), F.lit(0).alias("run"), F.lit(0).alias("out"))

    def add(acc: Column, x: Column) -> Column:
        same = acc["t"] == x["t"]
        return F.struct(x["t"].alias("t"), F.when(same, acc["run"] + x["n"]).otherwise(x["n"]).alias("run"), F.when(same, acc["out"]).otherwise(acc["out"] + F.abs(acc["run"])).alias("out"))

    return F.aggregate(F.array_sort(F.concat(side(p, 1), side(g, -1))), start, add, lambda acc: acc["out"] + F.abs(acc["run"]))


def _f1(p: Column, g: Column) -> Column:
    total = F.size(p) + F.size(g)
    f1 = F.coalesce(F.try_divide((total - _unshared(p, g)).cast("double"), total.cast("double")), F.lit(0.0))  # overlap is half of what is shared
    return F.when((F.size(p) == 0) | (F.size(g) == 0), (F.size(p) == F.size(g)).cast("double")).otherwise(f1)


def token_f1(pred: Column, golds: Column) -> Column:
    """Best token F1 over golds; overlap counts tokens as often as both hold them; two empty sides score 1."""
    best = let(_tokens(F.coalesce(pred, F.lit(""))), lambda p: F.array_max(F.transform(F.transform(golds, _tokens), lambda g: _f1(p, g))))
    return F.coalesce(best, F.lit(0.0))


def holds_tokens(hay: Column, needle: Column) -> Column:
    """Whether normalised ``needle`` is a contiguous run of ``hay``'s tokens; an empty needle isn't."""
    return let(normalise_answer(needle), lambda n: (n != "") & F.contains(F.concat(F.lit(" "), normalise_answer(hay), F.lit(" ")), F.concat(F.lit(" "), n, F.lit(" "))))


def gold_surfaced(tool_texts: Column, golds: Column) -> Column:
    """Whether the joined tool texts hold some gold."""
    spaced = lambda c: F.concat(F.lit(" "), c, F.lit(" "))
    wanted = F.filter(F.transform(golds, normalise_answer), lambda g: g != "")
    return let(spaced(normalise_answer(F.array_join(tool_texts, "\n"))), lambda hay: F.exists(wanted, lambda g: F.contains(hay, spaced(g))))


def score_segments(assistant: Column, tool_texts: Column, golds: Column, format_score: float = 0.0, bonus: float = 0.0) -> Column:
    """Struct of an episode's metrics (X8): a wrong answer earns format + retrieval bonus, none the bonus only."""
    answer = last_answer(assistant)
    has = answer.isNotNull()
    em, cover = has & exact_match(answer, golds), has & cover_match(answer, golds)
    surfaced = gold_surfaced(tool_texts, golds)
    extra = F.when(surfaced, F.lit(bonus)).otherwise(0.0)
    score = F.when(em, F.lit(1.0)).when(has, format_score + extra).otherwise(extra)
    return F.struct(
        score.alias("score"),
        em.cast("double").alias("em"),
        cover.cast("double").alias("cover_em"),
        F.when(has, token_f1(answer, golds)).otherwise(0.0).alias("f1"),
        has.cast("double").alias("has_answer"),
        surfaced.cast("double").alias("gold_retrieved"),
        F.size(golds).cast("double").alias("num_gold"),
        F.regexp_count(assistant, F.lit("<tool_call>")).cast("double").alias("n_tool_calls"),
    )


def clip(c: Column | str, limit: int, marker: str = "\n... [truncated]") -> Column:
    """At most ``limit`` characters and then the marker."""
    return F.when(F.length(col(c)) > limit, F.concat(F.substring(col(c), 1, limit), F.lit(marker))).otherwise(col(c))


def snippet(c: Column | str, limit: int = 600) -> Column:
    return clip(c, limit, "...")


def highlight(content: Column, query: Column, before: int = 166, after: int = 333) -> Column:
    """A window around the first of the query's terms of 3 characters or more."""
    terms = F.filter(F.array_distinct(F.split(collapse(F.lower(query)), " ")), lambda t: F.length(t) >= 3)
    at = F.coalesce(F.array_min(F.transform(terms, lambda t: F.nullif(F.instr(F.lower(content), t), F.lit(0)))), F.lit(1))
    start, end = F.greatest(at - 1 - before, F.lit(0)), F.least(at - 1 + after, F.length(content))
    cut = F.substring(content, start + 1, end - start)
    return F.concat(F.when(start > 0, "...").otherwise(""), cut, F.when(end < F.length(content), "...").otherwise(""))


def coerce_int(c: Column | str, default: int) -> Column:
    """A string as an int, else the default."""
    return F.coalesce(strip(col(c).cast("string")).try_cast("int"), F.lit(default))


def text_name(c: Column | str) -> Column:
    """Basename, ending in .txt."""
    base = F.regexp_extract(strip(c), r"[^/]*$", 0)
    return F.when(base.endswith(".txt"), base).otherwise(F.concat(base, F.lit(".txt")))


def file_month(c: Column | str) -> Column:
    """YYYY-MM from a name that holds YYYY_MM, else '' (X15)."""
    y, m = (F.regexp_extract(col(c), r"(\d{4})_(\d{2})", k) for k in (1, 2))
    return F.when(y != "", F.concat_ws("-", y, m)).otherwise("")


def head_tail(c: Column | str, budget: int, share: float = 0.3) -> Column:
    """The first ``share`` and the rest of a budget from the end, with the number of characters left out."""
    head = int(budget * share)
    cut = F.concat(F.substring(col(c), 1, head), F.lit("\n... ["), (F.length(col(c)) - budget).cast("string"), F.lit(" characters omitted] ...\n"), F.right(col(c), F.lit(budget - head)))
    return F.when(F.length(col(c)) > budget, cut).otherwise(col(c))


def surfaced_titles(c: Column | str) -> Column:
    """Titles of search result lines ``[n] Title  score=...``."""
    return F.regexp_extract_all(col(c), F.lit(r"(?m)^\[\d+\] (.+?)(?:  score=[-0-9.e]+)?$"), F.lit(1))


def tool_outputs(results: Column) -> Column:
    """Results of tool calls that aren't errors (X18): ``results`` is array<struct<name,result>>."""
    return F.filter(F.transform(results, lambda r: r["result"]), lambda t: ~t.startswith("Error:"))


def tool_outcome(c: Column | str) -> Column:
    """error, empty or ok, by how a tool's text begins."""
    t = strip(c)
    error = t.rlike(r"^(?:Error:|Error executing|Unknown function|Invalid JSON)")
    none = t.startswith("No ") & F.substring(t, 1, 80).rlike("found|match|document")
    return F.when((t == "") | none, "empty").when(error, "error").otherwise("ok")


def tool_format(c: Column | str) -> Column:
    """How a model writes tool calls."""
    c = col(c)
    return F.when(c.isNull() | (strip(c) == ""), "UNKNOWN").when(c.rlike(r"<function=[^>]+>"), "QWEN_XML").when(c.rlike(r"(?s)<tool_call>\s*\{.*\"name\""), "HERMES_JSON").otherwise("OTHER")


def http_class(status: Column) -> Column:
    """(kind, retryable) of an HTTP status; null is a lost connection."""
    transient = status.isNull() | status.isin(408, 409, 425, 429) | (status >= 500)
    kind = F.when(status.isNull(), "connection").when(status.isin(408, 504), "timeout").when(status == 429, "rate_limit").when(status >= 500, "server").otherwise("request")
    return F.struct(kind.alias("kind"), transient.alias("retryable"))


def trace_bucket(em: Column, answered: Column, f1: Column, surfaced: Column) -> Column:
    """CORRECT, FORMAT, PARTIAL, SURFACED_MISSED or NOT_SURFACED, the first that holds."""
    return F.when(em, "CORRECT").when(~answered, "FORMAT").when(f1 >= 0.5, "PARTIAL").when(surfaced, "SURFACED_MISSED").otherwise("NOT_SURFACED")


def safe_name(c: Column | str) -> Column:
    """Characters outside [alnum-_.] become _."""
    return F.regexp_replace(col(c), r"[^A-Za-z0-9\-_.]", "_")


def with_context(content: Column, file_name: Column, month: Column, heading: Column) -> Column:
    """Lines naming document, month and section, a blank line, then the content."""
    part = lambda label, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(label), c))
    head = F.concat_ws("\n", part("Document: ", file_name), part("Bulletin date: ", month), part("Section: ", heading))
    return F.when(head != "", F.concat(head, F.lit("\n\n"), content)).otherwise(content)


def clean_answers(c: Column) -> Column:
    """Stripped, non-empty, without later spellings that differ in case only (P5)."""
    kept = F.filter(F.transform(c, strip), lambda a: a != "")
    return F.filter(kept, lambda a, i: ~F.exists(F.slice(kept, F.lit(1), i), lambda b: F.lower(b) == F.lower(a)))


def level_number(c: Column | str) -> Column:
    """'Level 3', 3 and '3' give 3; no digits give null."""
    return F.regexp_replace(col(c).cast("string"), r"[^0-9]", "").try_cast("int")


def gold_list(variant: Column) -> Column:
    """A gold answer of any JSON shape as strings (P9): {target}, {answers}, a string, or an array; blanks drop from arrays."""
    text = F.coalesce(F.try_variant_get(variant, "$.target", "string"), F.when(F.schema_of_variant(variant) == "STRING", F.try_variant_get(variant, "$", "string")))
    many = F.coalesce(F.try_variant_get(variant, "$.target", "array<string>"), F.try_variant_get(variant, "$.answers", "array<string>"), F.try_variant_get(variant, "$", "array<string>"))
    return F.when(many.isNotNull(), F.filter(many, lambda x: strip(x) != "")).when(text.isNotNull(), F.array(text)).otherwise(F.array().cast("array<string>"))


def passage_id(title: Column, text: Column) -> Column:
    """'p_' and 20 hex digits of the md5 of lower-cased title and text."""
    return F.concat(F.lit("p_"), F.substring(F.md5(F.concat(F.lower(strip(title)), F.lit("\n"), strip(text))), 1, 20))


def first_present(columns: Sequence[Column]) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in columns))


def image_parts(c: Column | str) -> Column:
    """A prompt split at <image>: array of {type, text}."""
    texts = F.split(col(c), "<image>")
    text = lambda t: F.struct(F.lit("text").alias("type"), t.alias("text"))
    image = F.struct(F.lit("image").alias("type"), F.lit(None).cast("string").alias("text"))
    parts = F.flatten(F.transform(texts, lambda t, i: F.when(i == 0, F.array(text(t))).otherwise(F.array(image, text(t)))))
    return F.filter(parts, lambda p: (p["type"] == "image") | (p["text"] != ""))
