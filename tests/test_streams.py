"""Streams equal their batch forms."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from agentlake.sources import sinks
from agentlake.streaming import streams

T0 = dt.datetime(2024, 1, 1)


def run(df, tmp_path, mode):
    rows = []
    q = df.writeStream.outputMode(mode).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).foreachBatch(lambda b, i: rows.extend(b.collect())).start()
    try:
        assert q.awaitTermination(150)
    finally:
        q.stop()
    return rows


def files(spark, df, tmp_path, n=3):
    """The rows as ``n`` files, read one a batch, in order of ``event_id``."""
    for i in range(n):
        df.filter(F.col("part") == i).drop("part").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    return spark.readStream.schema(df.drop("part").schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")


def events(spark):
    rows = [(w, i * 3 + w, T0 + dt.timedelta(seconds=i * 60 + w), (i * 7 + w) % 5 == 0, i // 20) for w in range(3) for i in range(60)]
    return spark.createDataFrame(rows, "worker long, event_id long, ts timestamp, failed boolean, part int")


def test_failure_windows(spark, tmp_path):
    batch = events(spark)
    bounds = {"window": 20, "least": 10, "most": 0.15}
    want = {r["worker"]: (r["calls"], r["failures"], r["tripped_at"]) for r in streams.failure_windows(batch, "worker", ["ts", "event_id"], "failed", 20, 10, 0.15).collect()}
    got = {r["worker"]: (r["calls"], r["failures"], r["tripped_at"]) for r in run(streams.failure_stream(files(spark, batch, tmp_path), **bounds), tmp_path, "update")}
    assert got == want and all(v[2] for v in want.values())


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


def test_group_completion(spark, tmp_path):
    """Complete groups at once; those whose hour is up incomplete; repeats of a finished group change nothing."""
    rows = [("a", 0, 1.0, at(0), 0), ("b", 0, 1.0, at(0), 0), ("a", 1, 0.0, at(1), 1), ("a", 1, 0.5, at(1), 1), ("b", 1, 1.0, at(2), 2), ("c", 0, 1.0, at(2), 2), ("a", 0, 1.0, at(3), 2), ("a", 1, 1.0, at(3), 2),
            ("d", 0, 1.0, at(90), 3), ("d", 1, 0.0, at(90), 3), ("e", 0, 1.0, at(91), 4)]
    df = spark.createDataFrame(rows, "group string, sample int, reward double, ts timestamp, part int")
    got = sorted(map(tuple, run(streams.completed_groups(files(spark, df, tmp_path, 5), 2), tmp_path, "append")))
    assert got == [("a", 2, 0.5, True, True), ("b", 2, 1.0, False, True), ("c", 1, 1.0, False, False), ("d", 2, 0.5, True, True)]


def test_state_of_groups_ends(spark, tmp_path):
    """A thousand groups, fifty every ten minutes: state doesn't grow with the groups that are over."""
    rows = [(f"g{i}", s, float(s), at(i // 50 * 10), i // 50) for i in range(1000) for s in range(2 if i % 5 else 1)]
    df = spark.createDataFrame(rows, "group string, sample int, reward double, ts timestamp, part int")
    stream = streams.completed_groups(files(spark, df, tmp_path, 20), 2, timeout_s=600)
    out, sizes = [], []
    q = stream.writeStream.outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).foreachBatch(lambda b, i: out.extend(b.collect())).start()
    try:
        assert q.awaitTermination(300)
        sizes = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["numInputRows"]]
    finally:
        q.stop()
    assert len(sizes) == 20 and max(sizes[10:]) <= max(sizes[:6])
    assert sum(r["complete"] for r in out) == 800 and 0 < sum(not r["complete"] for r in out) <= 200 and len({r["group"] for r in out}) == len(out)


def test_bounded_staleness(spark, tmp_path):
    """Versions go up while producers still make samples with old parameters; the stream drops what the batch form drops."""
    rows = [(run_, seq, max(0, seq // 4 - lag), seq // 8) for run_, lag in (("fresh", 0), ("behind", 2), ("stuck", 9)) for seq in range(40)]
    df = spark.createDataFrame(rows, "run string, seq long, parameter_version long, part int")
    want = {r["run"]: tuple(r) for r in streams.consumed_batch(df, 2, 1, 2, 1).collect()}
    for i in range(5):
        df.filter(F.col("part") == i).drop("part").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    told = run(streams.consumed(streams.sample_files(spark, f"{tmp_path}/in", 1), 2, 1, 2, 1), tmp_path, "update")
    got = {r["run"]: tuple(r) for r in told}  # the last of each run
    assert got == want and len(told) == 15
    assert want["fresh"][1:3] == (40, 0) and want["stuck"][1:] == (8, 32, 2, 2) and 0 < want["behind"][2] < 32


def test_parts_of_a_stream_that_was_killed(spark, tmp_path):
    """Killed after a part was written but before its batch counted, then restarted; later the whole input comes again."""
    rows = [(f"k{i}", i, i // 4) for i in range(12)] + [("k1", 99, 2)]
    df = spark.createDataFrame(rows, "key string, v int, part int")
    source = files(spark, df, tmp_path)
    write = sinks.parts_of(f"{tmp_path}/out", "key")

    def killed(batch, i):
        write(batch, i)
        if i == 1:
            raise RuntimeError("killed")

    def start(f, checkpoint):
        q = source.writeStream.option("checkpointLocation", f"{tmp_path}/{checkpoint}").trigger(availableNow=True).foreachBatch(f).start()
        q.awaitTermination(150)

    with pytest.raises(Exception, match="killed"):
        start(killed, "cp")
    start(write, "cp")
    parts = lambda: sorted((r["key"], r["v"]) for r in spark.read.json(f"{tmp_path}/out").collect())
    want = sorted((f"k{i}", i) for i in range(12))
    assert parts() == want
    start(write, "another")  # a checkpoint that was lost
    assert parts() == want
    sinks.write_parts(df.drop("part").filter("v < 3").union(spark.createDataFrame([("new/key", 1)], "key string, v int")), f"{tmp_path}/out", "key")
    assert parts() == sorted([*want, ("new/key", 1)])


def test_version_rollup(spark, tmp_path):
    df = spark.createDataFrame([(i % 2, float(i % 3), i % 3) for i in range(30)], "version int, reward double, part int")
    want = {tuple(r) for r in streams.version_rollup(df).collect()}
    last = {r["version"]: tuple(r) for r in run(streams.version_rollup(files(spark, df, tmp_path)), tmp_path, "update")}
    assert set(last.values()) == want


def test_silent_workers(spark, tmp_path):
    rows = [(1, T0, 0), (2, T0, 0), (2, T0 + dt.timedelta(minutes=12), 1), (3, T0 + dt.timedelta(minutes=40), 2)]
    df = spark.createDataFrame(rows, "worker long, ts timestamp, part int")
    got = {r["worker"] for r in run(streams.silent_workers(files(spark, df, tmp_path), 600), tmp_path, "append")}
    assert {1, 2} <= got and 3 not in got


def test_bounds_and_aborts(spark, tmp_path):
    assert streams.samples_per_sync(2, 2, 4, 32) == 16
    with pytest.raises(ValueError):
        streams.samples_per_sync(2, 2, 4, 33)
    rows = spark.createDataFrame([(1,), (3,)], "parameter_version int")
    assert streams.fresh_enough(rows, 4, 1).count() == 1
    record = streams.first_abort(spark, f"{tmp_path}/abort.json")
    for reason in ("first", "second"):
        record(spark.createDataFrame([(reason, "x")], "reason string, source string"), 0)
    assert not [f for f in tmp_path.iterdir() if "partial" in f.name]
    assert sinks.read_json(spark, f"{tmp_path}/abort.json")["reason"] == "first"
    old = spark.createDataFrame([(T0,), (T0 + dt.timedelta(hours=1),)], "modificationTime timestamp")
    assert streams.fresh_files(old, (T0 + dt.timedelta(hours=1)).replace(tzinfo=dt.UTC).timestamp()).count() == 1
    assert streams.settled(lambda: True, 1) and not streams.settled(lambda: False, 0.01, 0.01)
    d = streams.deduplicated(events(spark), "event_id", "ts", "1 hour")
    assert d.columns == events(spark).columns
