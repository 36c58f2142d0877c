"""Readers with declared schemas, explicit order and pinned content."""

from __future__ import annotations

import base64
import hashlib
import io
import re
import zipfile
import zlib
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from agentlake.functions.arrow import arrow
from agentlake.operators.corpus import tree_digest


class Rejected(ValueError):
    """A source that isn't what was pinned."""


def parquet(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Parquet with a declared schema."""
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.parquet(path)


def pinned(spark: SparkSession, path: str, sha256: str, columns: Sequence[str]) -> DataFrame:
    """Parquet whose content digest over ``columns`` must be as pinned (S1): 64 hex digits, nothing else is accepted."""
    if not re.fullmatch(r"[0-9a-f]{64}", sha256):
        raise Rejected("a pin is a full sha256")
    df = spark.read.parquet(path)
    found = tree_digest(df, F.sha2(F.to_json(F.struct(*columns)), 256)).first()["digest"]
    if found != sha256:
        raise Rejected(f"{path} holds other content than pinned")
    return df


def verified(candidates: Sequence[tuple[str, Callable[[], DataFrame]]], verify: Callable[[DataFrame], str | None], allow_fallback: bool = False) -> tuple[DataFrame, dict]:
    """The first candidate, or if allowed the first mirror that ``verify`` accepts (S2), with what was rejected."""
    rejected: dict[str, str] = {}
    for i, (name, load) in enumerate(candidates if allow_fallback else candidates[:1]):
        try:
            df = load()
            problem = verify(df)
        except Exception as e:
            problem = f"{type(e).__name__}: {e}"[:300]
        if problem is None:
            return df, {"fallback": name if i else None, "rejected": rejected}
        rejected[name] = problem
    raise Rejected(f"no acceptable source: {rejected}")


def row_count(spark: SparkSession, path: str) -> int:
    """Rows by the files' footers (S5): a count reads no column."""
    return spark.read.parquet(path).count()


def csv_strings(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header, all strings, quoted line ends allowed."""
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line (from 1), value of text files. A line's number is its place in its part of the file and the lines of the
    parts before; a part is what one task reads at once, so nothing larger meets in one task."""
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_part"), F.monotonically_increasing_id().alias("_seq"), "value")
    parts = rows.groupBy("file", "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("file").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.row_number().over(Window.partitionBy("file", "_part").orderBy("_seq"))
    placed = rows.withColumn("_at", inside).join(parts.withColumn("_before", before).drop("_n"), ["file", "_part"])
    return placed.select("file", (F.col("_before") + F.col("_at")).alias("line"), "value")


def json_lines(spark: SparkSession, path: str, schema: str, unique: str | None = None) -> DataFrame:
    """JSON lines without blank ones (S7, S8). A bad line, an empty source or a repeated key is an error that says where."""
    lines = spark.read.text(path).filter("trim(value) <> ''")
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}
    parsed = lines.select(F.from_json("value", f"{schema}, _corrupt_record string", options).alias("v"))
    if parsed.filter("v._corrupt_record is not null").limit(1).count():
        told = numbered_lines(spark, path).filter("trim(value) <> ''").withColumn("v", F.from_json("value", f"{schema}, _corrupt_record string", options))
        worst = told.filter("v._corrupt_record is not null").orderBy("file", "line").first()
        raise Rejected(f"{worst['file']}:{worst['line']}: not JSON: {worst['value'][:120]}")
    df = parsed.select("v.*").drop("_corrupt_record")
    if not df.limit(1).count():
        raise Rejected(f"{path} is empty")
    if unique and (twice := df.groupBy(unique).count().filter("count > 1").limit(3).collect()):
        raise Rejected(f"{path} repeats {[r[0] for r in twice]}")
    return df


def json_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON document a file."""
    return spark.read.schema(schema).option("multiLine", True).json(path).withColumn("file_name", F.regexp_extract(F.col("_metadata.file_path"), r"[^/]*$", 0))


def whole_texts(spark: SparkSession, path: str) -> DataFrame:
    """file_name, text of non-empty text files (S10); bytes that aren't UTF-8 are replaced."""
    raw = spark.read.format("binaryFile").load(path)
    name = F.regexp_extract("path", r"[^/]*$", 0).alias("file_name")
    return raw.select(name, F.make_valid_utf8(F.col("content").cast("string")).alias("text")).filter("text <> ''")


def _members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for content in batch["content"]:
            with zipfile.ZipFile(io.BytesIO(content)) as z:
                for name in sorted(n for n in z.namelist() if n.endswith(".txt")):  # a member at a time
                    yield pd.DataFrame({"file_name": [name.rsplit("/", 1)[-1]], "text": [z.read(name).decode("utf-8", "replace")]})


def zipped_texts(spark: SparkSession, path: str) -> DataFrame:
    """file_name, text of the .txt members of zip files."""
    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(_members, "file_name string, text string")


def id_list(spark: SparkSession, path: str) -> DataFrame:
    """id, pos of a file with an id a line (S15). The file is read as one text, so pos is exact."""
    one = spark.read.text(path, wholetext=True)
    at = one.select(F.posexplode(F.split("value", r"\r\n|\n")).alias("pos", "id"))
    return at.filter(F.trim("id") != "").select(F.trim("id").alias("id"), "pos")


def titles(spark: SparkSession, path: str) -> DataFrame:
    """key, titles of a side file keyed by question or uid."""
    raw = spark.read.schema("question string, uid string, titles array<string>").json(path)
    return raw.select(F.coalesce("question", "uid").alias("key"), "titles")


def embedded_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Objects inside log lines (S17): line, value of lines that hold one; other lines drop out."""
    rows = numbered_lines(spark, path).select("file", "line", F.regexp_extract("value", r"\{.*\}", 0).alias("json"))
    return rows.filter(F.expr("try_parse_json(json) is not null and json <> ''")).withColumn("value", F.from_json("json", schema)).drop("json")


def last_value(rows: DataFrame) -> DataFrame:
    """The last object of each file."""
    return rows.groupBy("file").agg(F.max_by("value", "line").alias("value"))


@arrow("binary")
def _inflated(data: pd.Series) -> pd.Series:
    return data.map(lambda d: zlib.decompress(base64.b64decode(d)))


def reassembled(chunks: DataFrame) -> DataFrame:
    """Payloads from chunks (name, index, total, data, bytes, sha256) (S18): each index 0 .. total-1 once with one content,
    base64 of zlib, length and sha256 as announced; ``problem`` tells what isn't so."""
    each = chunks.groupBy("name", "index").agg(F.count_distinct("data").alias("kinds"), F.min("data").alias("data"), F.max("total").alias("total"), F.max("bytes").alias("bytes"), F.max("sha256").alias("sha256"))
    whole = each.groupBy("name").agg(
        F.max("kinds").alias("kinds"), F.count(F.lit(1)).alias("n"), F.max("index").alias("last"), F.max("total").alias("total"), F.max("bytes").alias("bytes"), F.max("sha256").alias("sha256"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("index", "data"))), lambda c: c["data"]), "").alias("data"),
    )
    problem = F.when(F.col("kinds") > 1, "conflicting chunks").when((F.col("n") != F.col("total")) | (F.col("last") != F.col("total") - 1), "missing chunks")
    sound = whole.withColumn("problem", problem)
    out = sound.withColumn("payload", F.when(F.col("problem").isNull(), _inflated(F.when(F.col("problem").isNull(), F.col("data")).otherwise(F.lit(base64.b64encode(zlib.compress(b"")).decode())))))
    wrong = (F.length("payload") != F.col("bytes")) | (F.sha2("payload", 256) != F.col("sha256"))
    return out.select("name", "payload", F.coalesce("problem", F.when(wrong, "wrong length or digest")).alias("problem"))


HARD_ERRORS = r"(?i)traceback \(most recent call last\)|out of memory|CUDA error|NCCL (error|timeout)|segmentation fault|RuntimeError|killed"


def hard_errors(spark: SparkSession, path: str, pattern: str = HARD_ERRORS, most: int = 5, width: int = 300) -> DataFrame:
    """The first few failure lines of logs by file and line, clipped."""
    rows = numbered_lines(spark, path)
    return rows.filter(F.col("value").rlike(pattern)).orderBy("file", "line").limit(most).select("file", "line", F.substring("value", 1, width).alias("value"))


def json_directory(spark: SparkSession, path: str, schema: str, stream: bool = False) -> DataFrame:
    """A directory of closed JSON files (S20, D21), at once or as a stream."""
    reader = spark.readStream if stream else spark.read
    return reader.schema(schema).option("multiLine", True).json(path)


def digest_of_bytes(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()
