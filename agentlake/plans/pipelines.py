"""Whole preparations: a passage corpus with its audit, and question splits."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from agentlake.operators import corpus, prep
from agentlake.sources import sinks


def build_corpus(spark: SparkSession, folder: str, loaders: dict[str, Callable[[], DataFrame]], allow_partial: bool = False) -> dict:
    """Passages of all sources, deduplicated by content id, with an audit and a manifest.

    Loaders give rows source, split, id, pos, title, text, supporting. A passage that several rows share is of the first.
    """
    union, state = corpus.all_sources(loaders, allow_partial)
    if union is None:
        raise ValueError(f"no source: {state['failed']}")
    kept = corpus.passages(union)
    firsts = corpus.first_of_each(kept.select("id", "source_order", "source", "split", "pos", "title", "text"), "id", ["source_order", "split", "pos"])
    ids = ["source_order", "split", "question", "pos"]
    rows = union.withColumnRenamed("id", "question")
    marked = rows.join(kept_rows(rows).select(*ids).withColumn("kept", F.lit(True)), ids, "left").withColumn("kept", F.coalesce("kept", F.lit(False)))
    tables = {"passages": firsts.select("id", "title", "text"), "audit": corpus.audit(marked), "origins": firsts.groupBy("source", "split").agg(F.count(F.lit(1)).alias("new"))}
    return sinks.write_tables(spark, folder, tables, "build_corpus", [state])


def kept_rows(rows: DataFrame) -> DataFrame:
    """Rows whose passage is kept."""
    return corpus.passages(rows.withColumnRenamed("id", "_id") if "id" in rows.columns else rows)


def make_splits(spark: SparkSession, folder: str, questions: DataFrame, dev: int, test: int, seed: str) -> dict:
    """dev: the first rows in source order; test: a stratified sample of the rest by largest remainders.

    ``questions``: source_id, hop_type, pos.
    """
    first = prep.prefix(questions, ["pos"], dev)
    pool = questions.join(first.select("source_id"), "source_id", "left_anti")
    want = prep.allocation(pool.groupBy(F.col("hop_type").alias("stratum")).agg(F.count(F.lit(1)).alias("size")), test)
    picked = prep.hash_pick(pool, "hop_type", "source_id", want, seed)
    manifest = sinks.write_tables(spark, folder, {"dev": first, "test": picked}, "make_splits")
    overlap = prep.overlap(*(spark.read.parquet(f"{folder}/{n}.parquet") for n in ("dev", "test")), ["source_id"])
    if overlap.limit(1).count():
        raise ValueError("dev and test overlap")
    digest = corpus.ordered_digest(spark.read.parquet(f"{folder}/test.parquet"), F.col("source_id"), [F.col("pos")]).first()
    return manifest | {"test_ids_sha256": digest["digest"], "test_n": digest["n"]}
