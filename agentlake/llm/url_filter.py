"""URL filters: pattern rules indexed by their rarest literal token (DataFrame functions only).

A rule is a regular expression over ``host + path`` and the literal tokens any match must hold. Each rule is filed
under the token that the URLs hold least often. A URL's tokens fetch the rules filed under them, and only those
rules' regular expressions run. Site rules (host, path) come first, the longest that fits deciding; where none
fits, pattern rules decide, and a URL that no rule blocks is allowed.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKEN = r"[^\p{L}\p{N}]+"
#: The rule index goes into the plan as a literal up to this many rules; a larger one is joined.
INLINE_RULES = 500


@dataclass(frozen=True)
class Rule:
    """``name`` is what a verdict reports; ``rank`` orders rules that match, the largest deciding."""

    name: str
    action: str
    pattern: str
    tokens: tuple[str, ...]
    site: bool
    rank: int


def site_rule(action: str, host: str, path: str = "/") -> Rule:
    """Fits ``host`` and all its subdomains where the URL's path starts with ``path``."""
    tokens = tuple(t for t in re.split(r"[\W_]+", host.lower()) if t)
    pattern = rf"^(?:[^/]*\.)?{re.escape(host)}{re.escape(path)}"
    return Rule(host + path, action, pattern.replace(r"\-", "-"), tokens, True, (len(host) + len(path)) * 1000 + len(host))


def word_rule(action: str, *tokens: str) -> Rule:
    """Fits URLs that hold the words side by side, in order, anywhere in host or path."""
    words = r"[^\p{L}\p{N}]".join(map(re.escape, tokens))
    return Rule("-".join(tokens), action, rf"(?i)(?:^|[^\p{{L}}\p{{N}}]){words}(?:[^\p{{L}}\p{{N}}]|$)", tokens, False, len("".join(tokens)))


SITE_RULES = (
    site_rule("allow", "com", "/"),
    site_rule("block", "example.com", "/en/"),
    site_rule("allow", "www.example.com", "/en/"),
    site_rule("block", "net", "/es/"),
    site_rule("block", "net", "/fr/"),
)
#: Words of hosts and paths that lists of unwanted pages commonly hold.
PATTERN_RULES = (
    word_rule("block", "cheap", "pills"),
    word_rule("block", "adult"),
    word_rule("block", "free", "bets"),
    word_rule("block", "casino"),
    word_rule("block", "porn"),
    word_rule("block", "xxx"),
    word_rule("block", "viagra"),
    word_rule("block", "payday", "loans"),
)


def parts(urls: DataFrame, url: str = "url") -> DataFrame:
    """Add host and path. Null URLs and those without ``://`` have both empty."""
    rest = F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return urls.withColumn("host", F.translate(host, upper, lower)).withColumn("path", path)


#: The token that every URL holds, under which rules without a literal token are filed.
ANY = ""


def _tokens():
    return F.array_union(F.array(F.lit(ANY)), F.split(F.lower(F.concat("host", "path")), TOKEN))


def file_rules(urls: DataFrame, rules: tuple[Rule, ...]) -> dict[str, list[Rule]]:
    """Rules by their rarest token, counted over all of ``urls``; ties go to the token that sorts first, and a rule without
    any stands under ANY."""
    vocabulary = sorted({ANY, *(t for r in rules for t in r.tokens)})
    held = F.array_intersect(_tokens(), F.array(*map(F.lit, vocabulary)))
    counts = {r[0]: r[1] for r in urls.select(F.explode(held).alias("token")).groupBy("token").count().collect()}  # a row per rule token
    index: dict[str, list[Rule]] = {}
    for rule in rules:
        index.setdefault(min(rule.tokens, key=lambda t: (counts.get(t, 0), t), default=ANY), []).append(rule)
    return index


def judge(pages: DataFrame, rules: tuple[Rule, ...] = SITE_RULES + PATTERN_RULES, url: str = "url", default: str = "allow") -> DataFrame:
    """page_id, host, path, rule (the site rule that decides, else null), verdict, matched (the name of the deciding
    rule of either kind, else null) for every row of ``pages``. Null, empty, very long and repeated URLs are rows like others,
    ties between rules of one length go to allow, an empty table gives no rows, and other columns are ignored."""
    urls = parts(pages.select("page_id", F.col(url).alias("url")))
    index = file_rules(urls, rules)
    key = F.concat("host", "path")
    if len(rules) > INLINE_RULES:
        return _judge_by_join(urls, index, default)
    filed = lambda r: F.struct(F.lit(r.site).alias("site"), F.lit(r.rank).alias("rank"), F.lit(r.action == "allow").alias("allow"), F.lit(r.name).alias("name"), F.lit(r.action).alias("action"), F.lit(r.pattern).alias("pattern"))
    empty = F.filter(F.array(filed(rules[0])), lambda r: F.lit(False))
    fetched = F.flatten(F.transform(_tokens(), lambda t: _choose(t, {k: F.array(*map(filed, v)) for k, v in index.items()}, empty)))
    matched = F.filter(fetched, lambda r: F.call_function("rlike", key, r["pattern"]))
    best = urls.withColumn("best", F.array_max(matched))
    return best.select(
        "page_id", "host", "path",
        F.when(F.col("best.site"), F.col("best.name")).alias("rule"),
        F.coalesce(F.col("best.action"), F.lit(default)).alias("verdict"),
        F.col("best.name").alias("matched"),
    )


def _choose(token, arrays: dict, otherwise):
    out = otherwise
    for name, array in arrays.items():
        out = F.when(token == name, array).otherwise(out)
    return out


def _judge_by_join(urls: DataFrame, index: dict[str, list[Rule]], default: str) -> DataFrame:
    """The same with the index as a table, for rule sets too large for the plan. Each distinct URL is judged once, and
    only the matching rules' rows are grouped, map-side first, so a hot host doesn't gather in a task."""
    spark = urls.sparkSession
    filed = spark.createDataFrame(
        [(k, r.site, r.rank, r.action == "allow", r.name, r.action, r.pattern) for k, v in index.items() for r in v],
        "token string, site boolean, rank long, allow boolean, name string, action string, pattern string",
    )
    distinct = urls.select("host", "path").distinct()
    fetched = distinct.withColumn("token", F.explode(_tokens())).join(filed, "token")
    fetched = fetched.filter(F.call_function("rlike", F.concat("host", "path"), F.col("pattern")))
    best = fetched.groupBy("host", "path").agg(F.max(F.struct("site", "rank", "allow", "name", "action")).alias("best"))
    return urls.join(best, ["host", "path"], "left").select(
        "page_id", "host", "path",
        F.when(F.col("best.site"), F.col("best.name")).alias("rule"),
        F.coalesce(F.col("best.action"), F.lit(default)).alias("verdict"),
        F.col("best.name").alias("matched"),
    )
