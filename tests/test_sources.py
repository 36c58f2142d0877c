import base64
import hashlib
import json
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from agentlake.operators.corpus import tree_digest
from agentlake.sources import readers, sinks


def test_pins_and_mirrors(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, t string")
    df.write.parquet(f"{tmp_path}/p")
    sha = tree_digest(df, F.sha2(F.to_json(F.struct("id", "t")), 256)).first()["digest"]
    assert readers.pinned(spark, f"{tmp_path}/p", sha, ["id", "t"]).count() == 2 and readers.row_count(spark, f"{tmp_path}/p") == 2
    for pin in ("main", "0" * 64):
        with pytest.raises(readers.Rejected):
            readers.pinned(spark, f"{tmp_path}/p", pin, ["id", "t"])
    verify = lambda d: None if d.count() == 2 else "count"
    wrong, right = ("first", lambda: df.limit(1)), ("mirror", lambda: df)
    assert readers.verified([wrong, right], verify, allow_fallback=True)[1] == {"fallback": "mirror", "rejected": {"first": "count"}}
    with pytest.raises(readers.Rejected):
        readers.verified([wrong, right], verify)


def test_text_formats(spark, tmp_path):
    (tmp_path / "a.csv").write_text('uid,q\n1,"a\nb"\n2,c\n')
    assert readers.csv_strings(spark, f"{tmp_path}/a.csv", "uid string, q string").count() == 2
    (tmp_path / "a.jsonl").write_text('{"uid": "1"}\n\n{"uid": "2"}\n')
    assert readers.json_lines(spark, f"{tmp_path}/a.jsonl", "uid string", "uid").count() == 2
    for name, text in (("bad", "{no\n"), ("empty", "\n"), ("twice", '{"uid": "1"}\n{"uid": "1"}\n')):
        (tmp_path / f"{name}.jsonl").write_text(text)
        with pytest.raises(readers.Rejected):
            readers.json_lines(spark, f"{tmp_path}/{name}.jsonl", "uid string", "uid")
    (tmp_path / "d.json").write_text(json.dumps({"document": {"elements": [{"content": "x"}]}}, indent=1))
    assert readers.json_documents(spark, f"{tmp_path}/d.json", "document struct<elements:array<struct<content:string>>>").first()["file_name"] == "d.json"
    (tmp_path / "t").mkdir()
    (tmp_path / "t/x.txt").write_bytes(b"caf\xc3\xa9 \xff")
    (tmp_path / "t/empty.txt").write_bytes(b"")
    assert [tuple(r) for r in readers.whole_texts(spark, f"{tmp_path}/t").collect()] == [("x.txt", "café �")]
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("in/b.txt", "B")
        z.writestr("no.md", "x")
    assert [tuple(r) for r in readers.zipped_texts(spark, f"{tmp_path}/z.zip").collect()] == [("b.txt", "B")]
    (tmp_path / "ids").write_text("b\n\na\n")
    assert [(r["id"], r["pos"]) for r in readers.id_list(spark, f"{tmp_path}/ids").orderBy("pos").collect()] == [("b", 0), ("a", 2)]
    (tmp_path / "side.json").write_text('{"question": "q", "titles": ["a"]}\n{"uid": "u", "titles": []}\n')
    assert {r["key"] for r in readers.titles(spark, f"{tmp_path}/side.json").collect()} == {"q", "u"}
    (tmp_path / "log").write_text('start\n12:00 {"v": 1}\n{bad}\nRuntimeError: x\n{"v": 2} done\n')
    found = readers.embedded_json(spark, f"{tmp_path}/log", "v int")
    assert found.count() == 2 and readers.last_value(found).first()["value"]["v"] == 2 and readers.hard_errors(spark, f"{tmp_path}/log").count() == 1
    (tmp_path / "parts").mkdir()
    (tmp_path / "parts/1.json").write_text('{"v": 1}')
    assert readers.json_directory(spark, f"{tmp_path}/parts", "v int").count() == 1


def test_reassembly(spark):
    data = b"payload" * 50
    text = base64.b64encode(zlib.compress(data)).decode()
    cut = [text[:10], text[10:]]
    row = lambda name, i, d, n=2, sha=hashlib.sha256(data).hexdigest(): (name, i, n, d, len(data), sha)
    rows = [row("ok", 1, cut[1]), row("ok", 0, cut[0]), row("ok", 0, cut[0]), row("gap", 0, cut[0]), row("clash", 0, cut[0]), row("clash", 0, "x"), row("clash", 1, cut[1]), row("sha", 0, text, 1, "0")]
    got = {r["name"]: r for r in readers.reassembled(spark.createDataFrame(rows, "name string, index int, total int, data string, bytes int, sha256 string")).collect()}
    assert bytes(got["ok"]["payload"]) == data and got["ok"]["problem"] is None
    assert (got["gap"]["problem"], got["clash"]["problem"], got["sha"]["problem"]) == ("missing chunks", "conflicting chunks", "wrong length or digest")


def test_manifests(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, t string")
    sinks.write_tables(spark, str(tmp_path), {"train": df}, "prep")
    assert sinks.find_manifest(spark, str(tmp_path), "train")["outputs"][0]["rows"] == 2 and sinks.find_manifest(spark, str(tmp_path), "other") is None
    assert sinks.provenance(spark, str(tmp_path), "train")["same"]
    df.limit(1).write.mode("overwrite").parquet(f"{tmp_path}/train.parquet")
    assert not sinks.provenance(spark, str(tmp_path), "train")["same"]
    at = f"{tmp_path}/x.json"
    sinks.write_json(spark, at, {"a": 1})
    with pytest.raises(FileExistsError):
        sinks.write_json(spark, at, {"a": 2})
    assert sinks.read_json(spark, at) == {"a": 1} and sinks.read_json(spark, at + "no") is None
    sinks.write_json_lines(df, f"{tmp_path}/l")
    with pytest.raises(Exception, match="(?i)exist"):
        sinks.write_json_lines(df, f"{tmp_path}/l")
    sinks.write_parts(df, f"{tmp_path}/parts", "t")
    assert spark.read.json(f"{tmp_path}/parts").count() == 2
    assert sinks.differing({"a": 1, "b": 2}, {"a": 1, "c": 3}) == ["b", "c"] and sinks.versioned_name("t", "ab" * 32) == ("t_vabababab", "t_vabababab_index")
    assert sinks.replace_block("x <!-- t:start -->old<!-- t:end --> y", "t", sinks.markdown_table(df.limit(1))).count("| 1 | a |") == 1
    with pytest.raises(ValueError):
        sinks.replace_block("x", "t", "y")
    s = spark.createDataFrame([("a", "ONLINE_NO_PENDING", 2), ("b", "ONLINE", 1), ("c", "FAILED", 0)], "name string, state string, indexed int")
    assert [r["ready"] for r in sinks.index_state(s, 2).collect()] == ["ready", "pending", "failed"]


def test_record_comes_from_the_writing_job(spark, tmp_path):
    """One job a table; its record is what the table gives when it is read, whatever its files and order."""
    df = spark.createDataFrame([(i % 7, None if i % 5 == 0 else f"t{i}") for i in range(100)], "id int, t string")
    spark.sparkContext.setJobGroup("recorded", "one write")
    record = sinks.write_recorded(df, f"{tmp_path}/t.parquet", "t")
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("recorded")
    spark.sparkContext.setJobGroup("after", "reads")
    assert len(jobs) == 1 and record["rows"] == 100
    assert record["bytes"] == sum(f.stat().st_size for f in (tmp_path / "t.parquet").glob("part-*"))
    for again in (spark.read.parquet(f"{tmp_path}/t.parquet").orderBy(F.desc("id")), df.repartition(7)):
        assert sinks.output_record(again, "t") == {k: record[k] for k in ("name", "rows", "sha256")}
    other = [df.limit(99), df.union(df.limit(1)), df.withColumn("t", F.coalesce("t", F.lit("")))]
    assert len({sinks.output_record(x, "t")["sha256"] for x in [df, *other]}) == 4
    assert sinks.write_recorded(df.limit(0), f"{tmp_path}/e.parquet", "e")["rows"] == 0


def test_tables(spark):
    df = spark.createDataFrame([(1,), (2,)], "id int")
    assert sinks.ensure_table(spark, "t_ensure", lambda: df, "id", {"sha": "1"}, 2) == "built" and sinks.ensure_table(spark, "t_ensure", lambda: df, "id", {"sha": "1"}, 2) == "reused"
    assert sinks.ensure_table(spark, "t_ensure", lambda: df, "id", {"sha": "2"}, 2) == "built"
    with pytest.raises(ValueError):
        sinks.ensure_table(spark, "t_twice", lambda: df.union(df), "id", {"sha": "1"})
    assert not spark.catalog.tableExists("t_twice") and sinks.table_problems(df, df.schema, "id", 3) == ["count"]
    spark.sql("DROP TABLE t_ensure")


def test_lines_have_numbers(spark, tmp_path):
    """In every file, also where it is read in several parts; blank lines count."""
    text = {"a.log": ["x", "", "RuntimeError: one", "y"], "b.log": [f"line {i} " + "z" * 50 for i in range(400)] + ["Traceback (most recent call last)", 'said {"k": 1} and', 'said {"k": 2}']}
    for name, lines in text.items():
        (tmp_path / name).write_text("\n".join(lines) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        got = sorted((r["file"].rsplit("/", 1)[1], r["line"], r["value"]) for r in readers.numbered_lines(spark, str(tmp_path)).collect())
        errors = [(r["file"].rsplit("/", 1)[1], r["line"]) for r in readers.hard_errors(spark, str(tmp_path)).collect()]
        found = readers.embedded_json(spark, str(tmp_path), "k int")
        assert {r["line"]: r["value"]["k"] for r in found.collect()} == {402: 1, 403: 2} and [r["value"]["k"] for r in readers.last_value(found).collect()] == [2]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == sorted((name, i, x) for name, lines in text.items() for i, x in enumerate(lines, 1)) and errors == [("a.log", 3), ("b.log", 401)]
    (tmp_path / "bad.jsonl").write_text('{"uid": "a"}\n\n{"uid": \n')
    with pytest.raises(Exception, match="bad.jsonl:3: not JSON"):
        readers.json_lines(spark, f"{tmp_path}/bad.jsonl", "uid string")


def test_stale_block():
    text = "x\n<!-- t:start -->\nold\n<!-- t:end -->\ny"
    assert sinks.stale_block(text, "t", "new") and not sinks.stale_block(sinks.replace_block(text, "t", "new"), "t", "new")
