"""Shared storage and global order.

Lineage is cut by writing a table into the folder that the cluster names in ``spark.checkpoint.dir``.
Every executor can read it, so a lost executor costs only the tasks it was running.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Tables written by this driver, removed when it ends.
_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The shared folder: ``spark.checkpoint.dir``; a temporary folder only where unset and Spark is local."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    folder = "file://" + tempfile.mkdtemp(prefix="agentlake-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def materialise(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder as Parquet and read back, with its own schema and no lineage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/agentlake/{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    _written.append((spark, path))
    table = spark.read.schema(df.schema).parquet(path)
    table._agentlake_path = path
    return table


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at.getParent(), True)


def release_table(df: DataFrame) -> None:
    """Delete what ``materialise`` wrote for ``df`` (that very frame), as soon as nothing reads it any more."""
    for entry in [e for e in _written if e[1] == getattr(df, "_agentlake_path", None)]:
        _written.remove(entry)
        _delete(*entry)


def release() -> None:
    """Delete the tables written so far; results that still read them must have been consumed."""
    while _written:
        try:
            _delete(*_written.pop())
        except Exception:  # the session has ended; the folder belongs to the cluster
            continue


atexit.register(release)


def narrow(df: DataFrame, limit: int) -> DataFrame:
    """``df``, marked for broadcast only if it has at most ``limit`` rows (counted); left to a shuffle join beyond."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def with_prefix(df: DataFrame, order: list[str], value: str, name: str) -> DataFrame:
    """Add ``row_index`` and ``prefix`` (sum of ``value`` over the rows before) in the global order of ``order``.

    Rows are dealt by range of ``order``, so a hot leading value spreads over partitions if later columns
    differ. The dealt table is written once; then each partition's total (one row per partition, which
    bounds what is broadcast) gives its offset and a window inside the partition does the rest.
    """
    dealt = materialise(
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_seq", F.monotonically_increasing_id()),
        name,
    )
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy("_part").agg(F.sum(value).alias("_sum"), F.count(F.lit(1)).alias("_n"))
    offsets = totals.select(
        "_part",
        F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"),
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"),
    )
    inside = Window.partitionBy("_part").orderBy("_seq").rowsBetween(Window.unboundedPreceding, 0)
    return (
        dealt.join(F.broadcast(offsets), "_part")
        .withColumn("prefix", F.col("_base") + F.sum(value).over(inside) - F.col(value))
        .withColumn("row_index", F.col("_first") + F.row_number().over(inside) - 1)
        .drop("_part", "_seq", "_base", "_first")
    )


def global_index(df: DataFrame, order: list[str], name: str = "row_index") -> DataFrame:
    """Add 0-based positions in the global order, without a window over the whole table in one task."""
    return with_prefix(df.withColumn("_one", F.lit(1)), order, "_one", "indexed").drop("_one", "prefix").withColumnRenamed("row_index", name)
