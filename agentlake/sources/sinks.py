"""Sinks: versioned tables with manifests written last, records that never overwrite, parts, identities."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from agentlake.operators.corpus import multiset_digest, multiset_sums, summed_digest


class _Files:
    """Small files next to tables, by the file system that Spark uses for the path."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.path = self.jvm.org.apache.hadoop.fs.Path(path)
        self.fs = self.path.getFileSystem(self.conf)

    def exists(self) -> bool:
        return self.fs.exists(self.path)

    def delete(self) -> None:
        self.fs.delete(self.path, True)

    def read(self) -> str:
        stream = self.fs.open(self.path)
        try:
            return str(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def write(self, text: str, overwrite: bool) -> None:
        """Written beside and renamed in one step of the file system, so a reader sees the old file or the new one, and of
        several writers that may not overwrite one wins."""
        fs, uri = self.jvm.org.apache.hadoop.fs, self.path.toUri()
        beside = fs.Path(f"{self.path.toString()}.{uuid.uuid4().hex}.partial")
        stream = self.fs.create(beside, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        how = self.gateway.new_array(fs.Options.Rename, 1)
        how[0] = fs.Options.Rename.OVERWRITE if overwrite else fs.Options.Rename.NONE
        try:
            fs.FileContext.getFileContext(uri, self.conf).rename(beside, self.path, how)
        except Exception as e:
            self.fs.delete(beside, False)
            if "FileAlreadyExistsException" in str(e):
                raise FileExistsError(str(self.path.toString())) from None
            raise

    def size(self) -> int:
        """Bytes of the data files below."""
        files, total = self.fs.listFiles(self.path, True), 0
        while files.hasNext():
            file = files.next()
            if not str(file.getPath().getName()).startswith(("_", ".")):
                total += file.getLen()
        return total


def write_json(spark: SparkSession, path: str, value: object, overwrite: bool = False) -> None:
    """A JSON record, atomic, which replaces another only if told to (K7)."""
    _Files(spark, path).write(json.dumps(value, indent=1, sort_keys=True) + "\n", overwrite)


def read_json(spark: SparkSession, path: str) -> object | None:
    file = _Files(spark, path)
    return json.loads(file.read()) if file.exists() else None


def _row(df: DataFrame) -> Column:
    return F.sha2(F.to_json(F.struct(*sorted(df.columns))), 256)


def output_record(df: DataFrame, name: str) -> dict:
    """name, rows and content digest of a table that is there: one pass."""
    row = multiset_digest(df, _row(df)).first()
    return {"name": name, "rows": row["n"], "sha256": row["digest"]}


def write_recorded(df: DataFrame, path: str, name: str, row: Column | None = None) -> dict:
    """Write a table as Parquet and return its record: name, rows, bytes, sha256 (K2).

    Rows and digest are metrics that the writing job observes, bytes come from the file system's listing; the table isn't
    read again. The digest doesn't depend on order or files, so ``output_record`` of the table read later gives the same. ``row``: another digest of a row (64 hex digits).
    """
    seen = Observation(name)
    df.observe(seen, *multiset_sums(_row(df) if row is None else row)).write.mode("overwrite").parquet(path)
    sums = seen.get
    return {"name": name, "rows": sums["n"], "bytes": _Files(df.sparkSession, path).size(), "sha256": summed_digest(sums)}


def write_tables(spark: SparkSession, folder: str, tables: dict[str, DataFrame], tool: str, sources: Sequence[dict] = (), versions: dict | None = None) -> dict:
    """Tables as Parquet and a manifest (K1 - K3), a job a table. The old manifest goes first and the new one comes last, so
    a manifest always describes complete data; each table's files commit as a job."""
    at = f"{folder}/DATA_MANIFEST.json"
    _Files(spark, at).delete()
    outputs = [write_recorded(df, f"{folder}/{name}.parquet", name) for name, df in tables.items()]
    manifest = {"schema": "agentlake.manifest.v1", "tool": tool, "created_utc": datetime.now(UTC).isoformat(), "versions": versions or {"spark": spark.version}, "sources": list(sources), "outputs": outputs}
    write_json(spark, at, manifest, overwrite=True)
    return manifest


def find_manifest(spark: SparkSession, folder: str, name: str) -> dict | None:
    """The manifest of a table: its own, else the folder's if that lists the table."""
    for file in (f"{name}.manifest.json", "DATA_MANIFEST.json"):
        found = read_json(spark, f"{folder}/{file}")
        if found and any(o["name"] == name for o in found["outputs"]):
            return found
    return None


def provenance(spark: SparkSession, folder: str, name: str) -> dict:
    """Recorded and present digest of a table (K5)."""
    manifest = find_manifest(spark, folder, name)
    recorded = next((o["sha256"] for o in manifest["outputs"] if o["name"] == name), None) if manifest else None
    now = output_record(spark.read.parquet(f"{folder}/{name}.parquet"), name)["sha256"]
    return {"recorded": recorded, "present": now, "same": recorded == now}


def write_json_lines(df: DataFrame, path: str) -> None:
    """JSON lines (K6); fails where something is already."""
    df.write.mode("errorifexists").option("ignoreNullFields", False).json(path)


def differing(expected: dict, found: dict) -> list[str]:
    """Keys whose values differ."""
    return sorted(k for k in {*expected, *found} if expected.get(k) != found.get(k))


def table_problems(df: DataFrame, schema, key: str, expected: int | None = None) -> list[str]:
    """What is wrong with a table: schema, key not unique, unexpected count."""
    found = df.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(key).alias("keys")).first()
    checks = [("schema", [(f.name, f.dataType) for f in df.schema] != [(f.name, f.dataType) for f in schema]), ("repeated keys", found["n"] != found["keys"]), ("count", expected is not None and found["n"] != expected)]
    return [name for name, wrong in checks if wrong]


def ensure_table(spark: SparkSession, name: str, build: Callable[[], DataFrame], key: str, properties: dict[str, str], expected: int | None = None) -> str:
    """A catalog table that is reused only if it verifies, else loaded beside, verified and renamed into place."""
    if spark.catalog.tableExists(name):
        have = {r["key"]: r["value"] for r in spark.sql(f"SHOW TBLPROPERTIES {name}").collect()}
        if all(have.get(k) == v for k, v in properties.items()) and not table_problems(spark.table(name), build().schema, key, expected):
            return "reused"
    staged = f"{name}__staged"
    spark.sql(f"DROP TABLE IF EXISTS {staged}")
    df = build()
    df.write.saveAsTable(staged)
    wrong = table_problems(spark.table(staged), df.schema, key, expected)
    if wrong:
        spark.sql(f"DROP TABLE {staged}")
        raise ValueError(f"{name}: {wrong}")
    listed = ", ".join(f"'{k}' = '{v}'" for k, v in properties.items())
    spark.sql(f"ALTER TABLE {staged} SET TBLPROPERTIES ({listed})")
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    spark.sql(f"ALTER TABLE {staged} RENAME TO {name}")
    return "built"


def versioned_name(base: str, sha256: str) -> tuple[str, str]:
    """Names of a table and its index by content."""
    table = f"{base}_v{sha256[:8]}"
    return table, f"{table}_index"


def index_state(status: DataFrame, expected: int) -> DataFrame:
    """ready, pending or failed for rows (name, state, indexed) (K15): ready only if online with the expected rows."""
    s = F.upper("state")
    ready = s.startswith("ONLINE") & (F.col("indexed") == expected)
    return status.withColumn("ready", F.when(s.rlike("FAILED|OFFLINE_FAILED"), "failed").when(ready, "ready").otherwise("pending"))


def write_parts(df: DataFrame, path: str, key: str, batch: int | None = None) -> None:
    """A closed JSON part for each key (K8, K16, M7), with a safe name; finished keys stay as they are.

    Each call writes a folder of its own, ``batch`` or the next number. Keys that another batch has finished are left out,
    and a batch that is written again replaces itself, so a call that was cut off or repeated gives each key once.
    """
    from agentlake.functions.text import safe_name

    spark = df.sparkSession
    rows = df.withColumn("part", safe_name(key))
    if _Files(spark, path).exists():
        done = spark.read.schema(StructType([df.schema[key], StructField("batch", LongType())])).json(path)
        if batch is None:
            batch = (done.agg(F.max("batch")).first()[0] or 0) + 1
        rows = rows.join(done.filter(F.col("batch") != batch).select(key).distinct(), key, "left_anti")
    rows.select(*df.columns, "part").repartition("part").write.mode("overwrite").partitionBy("part").json(f"{path}/batch={batch or 0}")


def parts_of(path: str, key: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that writes parts under the stream's own batch numbers, so a batch that ran before a
    restart is replaced, not repeated."""

    def write(batch: DataFrame, batch_id: int) -> None:
        write_parts(batch, path, key, batch_id)

    return write


def replace_block(text: str, name: str, body: str) -> str:
    """``text`` with the part between the markers of ``name`` replaced."""
    start, end = f"<!-- {name}:start -->", f"<!-- {name}:end -->"
    head, found, rest = text.partition(start)
    if not found or end not in rest:
        raise ValueError(f"no block {name}")
    return f"{head}{start}\n{body}\n{end}{rest.partition(end)[2]}"


def stale_block(text: str, name: str, body: str) -> bool:
    """Whether the part between the markers of ``name`` isn't ``body`` any more."""
    return replace_block(text, name, body) != text


def markdown_table(df: DataFrame) -> str:
    """A small result as a Markdown table."""
    rows = [[str(v) for v in r] for r in df.collect()]
    return "\n".join("| " + " | ".join(r) + " |" for r in [df.columns, ["---"] * len(df.columns), *rows])
