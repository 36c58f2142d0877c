"""Passage corpora: adapters, content ids, dedup that keeps first, audits, digests and manifests."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agentlake.functions import text as tx
from agentlake.functions.arrow import arrow

LEAST_TEXT = 20


def paragraphs(df: DataFrame) -> DataFrame:
    """id, pos, title, text, supporting from nested paragraphs."""
    at = df.select("id", F.posexplode("paragraphs").alias("pos", "p"))
    return at.select("id", "pos", F.col("p.title").alias("title"), F.col("p.paragraph_text").alias("text"), F.col("p.is_supporting").alias("supporting"))


def parallel_contexts(df: DataFrame) -> DataFrame:
    """The same from a struct of parallel arrays: sentences joined by a space, blank ones dropped."""
    at = df.select("id", "supporting_facts", F.posexplode(F.arrays_zip("context.title", "context.sentences")).alias("pos", "c"))
    text = F.array_join(F.filter(F.transform("c.sentences", tx.strip), lambda s: s != ""), " ")
    return at.select("id", "pos", F.col("c.title").alias("title"), text.alias("text"), F.array_contains("supporting_facts.title", F.col("c.title")).alias("supporting"))


def passages(df: DataFrame) -> DataFrame:
    """Rows with collapsed title and text that are kept (F4), with their content id."""
    names = df.columns
    both = F.array(F.struct(tx.collapse("title").alias("title"), tx.collapse("text").alias("text")))
    # generated, so that what follows reads the collapsed texts instead of collapsing them again
    out = df.select(*(c for c in names if c not in ("title", "text")), F.explode(both).alias("_both")).select("*", "_both.title", "_both.text").drop("_both")
    out = out.filter((F.col("title") != "") & (F.length("text") >= LEAST_TEXT))
    return out.select(*names).withColumn("id", tx.passage_id(F.col("title"), F.col("text")))


def first_of_each(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """One row for each key, the first in order (W1, U2). An aggregate combines map-side, so a hot key doesn't gather."""
    rest = [c for c in df.columns if c != key]
    least = F.min_by(F.struct(*rest), F.struct(*order)).alias("_first")
    return df.groupBy(key).agg(least).select(key, "_first.*").select(*df.columns)


def audit(df: DataFrame) -> DataFrame:
    """Per source and split (A2): questions, paragraphs, supporting, supporting_kept, questions_fully_supported.

    Input rows: source, split, question, supporting, kept.
    """
    each = df.groupBy("source", "split", "question").agg(
        F.count(F.lit(1)).alias("paragraphs"),
        F.count_if("supporting").alias("supporting"),
        F.count_if(F.col("supporting") & F.col("kept")).alias("supporting_kept"),
    )
    full = F.count_if((F.col("supporting") > 0) & (F.col("supporting") == F.col("supporting_kept")))
    return each.groupBy("source", "split").agg(
        F.count(F.lit(1)).alias("questions"), F.sum("paragraphs").alias("paragraphs"), F.sum("supporting").alias("supporting"),
        F.sum("supporting_kept").alias("supporting_kept"), full.alias("questions_fully_supported"),
    )


def all_sources(loaders: dict[str, Callable[[], DataFrame]], allow_partial: bool = False) -> tuple[DataFrame | None, dict]:
    """Union of whole sources in order (U2, S2): a source that fails is fatal, or left out and named with complete = False."""
    union, failed = None, {}
    for i, (name, load) in enumerate(loaders.items()):
        try:
            df = load().withColumn("source_order", F.lit(i))
            df.limit(1).count()
        except Exception as e:
            if not allow_partial:
                raise
            failed[name] = f"{type(e).__name__}: {e}"[:300]
            continue
        union = df if union is None else union.unionByName(df)
    return union, {"complete": not failed, "failed": failed}


# --- digests ---


@arrow("string")
def _row_digest(row: pd.Series) -> pd.Series:
    return row.map(lambda r: hashlib.sha256(json.dumps(json.loads(r)).encode()).hexdigest())


def json_row_digest(columns: Sequence[Column]) -> Column:
    """sha256 of the ASCII JSON list of string columns as Python's json.dumps writes it (S3)."""
    return _row_digest(F.to_json(F.array(*columns)))


def ordered_digest(df: DataFrame, value: Column, order: Sequence[Column], separator: str = "\n", buckets: int = 4096) -> DataFrame:
    """sha256 of values joined in order (X26), for sets of ids a driver could hold: one row, one string."""
    rows = F.sort_array(F.collect_list(F.struct(*(c.alias(f"o{i}") for i, c in enumerate(order)), value.alias("v"))))
    return df.agg(F.sha2(F.array_join(F.transform(rows, lambda r: r["v"]), separator), 256).alias("digest"), F.count(F.lit(1)).alias("n"))


def content_digest(df: DataFrame, row: Column) -> DataFrame:
    """Order-independent digest (S3): row digests sorted and hashed together."""
    return df.agg(F.sha2(F.array_join(F.sort_array(F.collect_list(row)), ""), 256).alias("digest"), F.count(F.lit(1)).alias("n"))


def tree_digest(df: DataFrame, row: Column, digits: int = 4) -> DataFrame:
    """An order-independent digest for any size: sorted row digests hash to one digest for each leading ``digits`` hex
    digits, and those (at most 16 ** digits) hash together. Not equal to ``content_digest``; rows never gather."""
    leaves = df.select(row.alias("h")).groupBy(F.substring("h", 1, digits).alias("p")).agg(F.sha2(F.array_join(F.sort_array(F.collect_list("h")), ""), 256).alias("h"), F.count(F.lit(1)).alias("n"))
    return leaves.agg(F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("p", "h"))), lambda x: x["h"]), ""), 256).alias("digest"), F.sum("n").alias("n"))


#: Hex digits of a row digest that are summed at once; sums of 10**18 rows stay within 38 decimal digits.
PART = 16


def multiset_sums(row: Column) -> list[Column]:
    """Aggregates n and s0 .. s3 of row digests (64 hex digits): their number, and the sums of their quarters as integers.
    Sums combine in any order, so they fit a partial aggregate and the metrics of a writing job."""
    quarter = lambda i: F.conv(F.substring(row, PART * i + 1, PART), 16, 10).cast("decimal(20,0)")
    return [F.count(F.lit(1)).alias("n"), *(F.sum(quarter(i)).alias(f"s{i}") for i in range(4))]


def summed_digest(sums) -> str:
    """sha256 of what ``multiset_sums`` gave (a mapping or row)."""
    return hashlib.sha256(",".join(str(int(sums[c] or 0)) for c in ("n", "s0", "s1", "s2", "s3")).encode()).hexdigest()


def multiset_digest(df: DataFrame, row: Column) -> DataFrame:
    """An order-independent digest of row digests for tables of any size, in one partial aggregate: digest, n. Repeated
    rows count. It notices changes and faults; it isn't meant to withstand rows made to collide."""
    listed = F.concat_ws(",", "n", *(F.coalesce(F.col(f"s{i}").cast("decimal(38,0)"), F.lit(0)) for i in range(4)))
    return df.agg(*multiset_sums(row)).select(F.sha2(listed.cast("binary"), 256).alias("digest"), "n")


def archive_identity(files: DataFrame) -> DataFrame:
    """sha256 over sorted lines ``basename NUL sha256(text)`` of files (path, text) (K10). Repeated basenames fail."""
    named = files.select(F.regexp_extract("path", r"[^/]*$", 0).alias("name"), F.sha2("text", 256).alias("sha"))
    line = F.concat("name", F.lit("\u0000"), F.col("sha"), F.lit("\n"))
    whole = F.sha2(F.array_join(F.sort_array(F.collect_list(line)), ""), 256)
    same = F.count(F.lit(1)) == F.count_distinct("name")
    return named.agg(F.when(same, whole).otherwise(F.raise_error(F.lit("repeated basenames")).cast("string")).alias("identity"))


def provenance_hash(df: DataFrame) -> Column:
    """sha256 of a row as JSON with sorted keys (X27), by this engine's JSON encoding."""
    return F.sha2(F.to_json(F.struct(*sorted(df.columns))), 256)


def dotted(c: Column, path: str, default: str | None = None) -> Column:
    """A dotted path of a JSON text, or a default (Q17)."""
    return F.coalesce(F.try_variant_get(F.try_parse_json(c), "$." + path, "string"), F.lit(default))


def text_stats(df: DataFrame, column: str = "text") -> DataFrame:
    """Rows and their texts' average length in characters."""
    return df.agg(F.count(F.lit(1)).alias("rows"), F.avg(F.length(column)).alias("mean_chars"))
