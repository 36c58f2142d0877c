"""From raw documents to packed training sequences.

Each stage is a function (spark, docs, sf_dir) -> DataFrame, written as Parquet and read again as the next one's docs.
All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from agentlake.llm import exact_dedup, mixing, near_dedup, packing, toxicity
from agentlake.llm.shared import materialise

#: Words in a block of the mix: several documents, as whole documents follow the block their first word is in.
MIX_BLOCK = 2048
#: Least similarity of near copies, in percent. 20 bands of 5 registers miss such a pair with probability 4e-4, a closer one less.
NEAR = 80


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the chain rejects go; every other row stays, null and empty texts too, unless the model says otherwise."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    labelled = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = toxicity.train(labelled, labels)
    return toxicity.without_toxic(docs, model)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (null counts as empty) the document with the largest id stays, once if its row is repeated."""
    return exact_dedup.keep_rows(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents of 80 % similarity or more one stays, and every document without an id or words."""
    kept = near_dedup.near_dedup(docs, near_dedup.Settings(percent=NEAR)).filter("kept").select(F.col("doc_id").alias("_agentlake_id")).distinct()
    return docs.join(kept, F.col("doc_id").eqNullSafe(F.col("_agentlake_id")), "left_semi").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix draws them, 0 to 3 times; those without words are in no block and go."""
    return mixing.mixed_documents(docs, block=MIX_BLOCK)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every row, null and empty texts included."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Shingle sets, token ids and the classifier are beyond SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
