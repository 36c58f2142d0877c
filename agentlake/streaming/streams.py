"""Stateful streams: group completion, count windows with a latch, heartbeats, staleness, rollups.

Each has a batch form over the same rows; the tests hold the two equal.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
WINDOW, LEAST, MOST_FAILING = 200, 50, 0.05


def prepare(spark: SparkSession) -> None:
    """State that survives executors and outgrows memory."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


# --- M3: the last WINDOW calls of a worker; tripped once more than MOST_FAILING of at least LEAST failed ---


def failure_windows(events: DataFrame, worker: str, order: list[str], failed: str, window: int = WINDOW, least: int = LEAST, most: float = MOST_FAILING) -> DataFrame:
    """Batch form: worker, calls, failures in the last window, and the call at which it tripped (null: never)."""
    w = Window.partitionBy(worker).orderBy(*order)
    last = w.rowsBetween(1 - window, 0)
    at = events.withColumn("n", F.row_number().over(w)).withColumn("seen", F.count(F.lit(1)).over(last)).withColumn("bad", F.sum(F.col(failed).cast("int")).over(last))
    trips = (F.col("seen") >= least) & (F.col("bad") > most * F.col("seen"))
    return at.groupBy(worker).agg(F.max("n").cast("long").alias("calls"), F.max_by("bad", "n").cast("long").alias("failures"), F.min(F.when(trips, F.col("n"))).cast("long").alias("tripped_at"))


FAILURES = StructType([StructField("worker", LongType()), StructField("calls", LongType()), StructField("failures", LongType()), StructField("tripped_at", LongType())])


class FailureWindow(StatefulProcessor):
    """The window as a string of flags, oldest first, and a latch, for each worker."""

    def __init__(self, window: int = WINDOW, least: int = LEAST, most: float = MOST_FAILING):
        self.window, self.least, self.most = window, least, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("window", StructType([StructField("flags", StringType()), StructField("calls", LongType()), StructField("tripped_at", LongType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        flags, calls, tripped = self.state.get() if self.state.exists() else ("", 0, None)
        batch = pd.concat(list(rows)).sort_values(["ts", "event_id"])
        for bad in batch["failed"]:
            flags, calls = (flags + ("1" if bad else "0"))[-self.window :], calls + 1
            if tripped is None and len(flags) >= self.least and flags.count("1") > self.most * len(flags):
                tripped = calls
        self.state.update((flags, calls, tripped))
        yield pd.DataFrame({"worker": [key[0]], "calls": [calls], "failures": [flags.count("1")], "tripped_at": pd.array([tripped], dtype="Int64")})

    def close(self) -> None:
        pass


def failure_stream(events: DataFrame, **bounds) -> DataFrame:
    """Update stream of (worker, calls, failures, tripped_at) from events (worker, ts, event_id, failed)."""
    return events.groupBy("worker").transformWithStateInPandas(FailureWindow(**bounds), FAILURES, "Update", "None")


# --- M2: a group comes out when all its samples are there, or when its time is up ---

GROUPS = StructType([StructField("group", StringType()), StructField("n", IntegerType()), StructField("mean", DoubleType()), StructField("mixed", BooleanType()), StructField("complete", BooleanType())])


class GroupCompletion(StatefulProcessor):
    """The rewards of an unfinished group; repeats of a sample don't count.

    A group has one timer, ``timeout`` after its first sample by event time. Until then a finished group is remembered, so
    repeats don't open it again; then all of its state goes, and an unfinished one comes out incomplete. Samples that come
    later still are behind the watermark.
    """

    def __init__(self, samples: int, timeout_ms: int):
        self.samples, self.timeout = samples, timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getMapState("seen", StructType([StructField("sample", IntegerType())]), StructType([StructField("reward", DoubleType())]))
        self.state = handle.getValueState("state", StructType([StructField("done", BooleanType()), StructField("ends", LongType())]))

    def _told(self, key, complete: bool) -> pd.DataFrame:
        rewards = [v[0] for _, v in self.seen.iterator()]
        return pd.DataFrame({"group": [key[0]], "n": [len(rewards)], "mean": [sum(rewards) / len(rewards)], "mixed": [min(rewards) < max(rewards)], "complete": [complete]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        done, ends = self.state.get() if self.state.exists() else (False, None)
        n = 0 if done else sum(1 for _ in self.seen.iterator())
        for batch in rows:
            if ends is None:
                ends = int(batch["ts"].min().timestamp() * 1000) + self.timeout
                self.handle.registerTimer(ends)
            for sample, reward in zip(batch["sample"], batch["reward"], strict=True):
                if not done and not self.seen.containsKey((int(sample),)):
                    self.seen.updateValue((int(sample),), (float(reward),))
                    n += 1
                    if n == self.samples:
                        yield self._told(key, True)
                        self.seen.clear()
                        done = True
        self.state.update((done, ends))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        done, _ = self.state.get()
        if not done:
            yield self._told(key, False)
        self.seen.clear()
        self.state.clear()

    def close(self) -> None:
        pass


def completed_groups(rewards: DataFrame, samples: int, timeout_s: float = 3600, lateness: str = "1 minute") -> DataFrame:
    """Append stream of groups from rewards (group, sample, reward, ts): complete ones as soon as ``samples`` are there (the
    first that came), others when ``timeout_s`` has passed since their first sample (M2). State of a group ends with it."""
    timed = rewards.withWatermark("ts", lateness).groupBy("group")
    return timed.transformWithStateInPandas(GroupCompletion(samples, int(timeout_s * 1000)), GROUPS, "Append", "EventTime")


# --- M1: samples made by parameters of bounded age, and when parameters are synchronised ---

CONSUMED = StructType([StructField(n, StringType() if n == "run" else LongType()) for n in ("run", "accepted", "stale", "version", "syncs")])


class Staleness:
    """Consumption of one run's samples in order: a sample is stale if its parameters are more than ``bound`` versions
    behind; every ``per_sync`` accepted samples the parameters are synchronised and their version goes up."""

    def __init__(self, per_sync: int, bound: int, accepted: int = 0, stale: int = 0):
        self.per_sync, self.bound, self.accepted, self.stale = per_sync, bound, accepted, stale

    @property
    def version(self) -> int:
        return self.accepted // self.per_sync

    def take(self, made_by: int) -> bool:
        fresh = self.version - made_by <= self.bound
        self.accepted, self.stale = self.accepted + fresh, self.stale + (not fresh)
        return fresh

    def row(self, run: str) -> pd.DataFrame:
        return pd.DataFrame({"run": [run], "accepted": [self.accepted], "stale": [self.stale], "version": [self.version], "syncs": [self.version]})


class Consumption(StatefulProcessor):
    def __init__(self, per_sync: int, bound: int):
        self.per_sync, self.bound = per_sync, bound

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("counts", StructType([StructField("accepted", LongType()), StructField("stale", LongType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = Staleness(self.per_sync, self.bound, *(self.state.get() if self.state.exists() else ()))
        for made_by in pd.concat(list(rows)).sort_values("seq")["parameter_version"]:  # of a micro-batch, whose size the source bounds
            now.take(int(made_by))
        self.state.update((now.accepted, now.stale))
        yield now.row(key[0])

    def close(self) -> None:
        pass


def sample_files(spark: SparkSession, path: str, files_at_once: int) -> DataFrame:
    """Samples (run, seq, parameter_version) as producers write them, at most so many files a trigger: the queue's bound."""
    return spark.readStream.schema("run string, seq long, parameter_version long").option("maxFilesPerTrigger", files_at_once).parquet(path)


def consumed(samples: DataFrame, trigger: int, require: int, mini: int, bound: int) -> DataFrame:
    """Update stream of each run's counts from samples (run, seq, parameter_version) (M1): accepted, stale (dropped),
    version, syncs. A synchronisation takes trigger * require * mini samples."""
    per_sync = trigger * require * mini
    return samples.groupBy("run").transformWithStateInPandas(Consumption(per_sync, bound), CONSUMED, "Update", "None")


def consumed_batch(samples: DataFrame, trigger: int, require: int, mini: int, bound: int) -> DataFrame:
    """Batch form: each run's samples in order of ``seq``."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        now = Staleness(trigger * require * mini, bound)
        for made_by in rows.sort_values("seq")["parameter_version"]:
            now.take(int(made_by))
        return now.row(key[0])

    return samples.select("run", "seq", "parameter_version").groupBy("run").applyInPandas(run, CONSUMED)


# --- M5 heartbeats, M1 staleness, M6 freshness, M11 rollup ---


def heartbeat_gaps(events: DataFrame, worker: str, ts: str, seconds: float) -> DataFrame:
    """Gaps between a worker's events longer than a bound (batch form of M5)."""
    last = F.lag(ts).over(Window.partitionBy(worker).orderBy(ts))
    gap = F.timestamp_diff("MICROSECOND", F.col("last"), F.col(ts)) / 1e6
    return events.withColumn("last", last).filter("last is not null").withColumn("gap_s", gap).filter(F.col("gap_s") > seconds).select(worker, "last", ts, "gap_s")


class Heartbeat(StatefulProcessor):
    """Reports a worker when its event-time timer runs out, which every event puts off."""

    def __init__(self, milliseconds: int):
        self.milliseconds = milliseconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", StructType([StructField("at", LongType())]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        at = max(int(batch["ts"].max().timestamp() * 1000) for batch in rows)
        if self.last.exists():
            old = self.last.get()[0]
            self.handle.deleteTimer(old + self.milliseconds)
            at = max(at, old)
        self.last.update((at,))
        self.handle.registerTimer(at + self.milliseconds)
        yield pd.DataFrame({"worker": pd.Series([], dtype="int64"), "silent_since_ms": pd.Series([], dtype="int64")})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame({"worker": [key[0]], "silent_since_ms": [self.last.get()[0]]})
        self.last.clear()

    def close(self) -> None:
        pass


def silent_workers(events: DataFrame, seconds: float, lateness: str = "1 minute") -> DataFrame:
    """Append stream of workers silent longer than a bound by event time (M5), from events (worker, ts)."""
    schema = StructType([StructField("worker", LongType()), StructField("silent_since_ms", LongType())])
    return events.withWatermark("ts", lateness).groupBy("worker").transformWithStateInPandas(Heartbeat(int(seconds * 1000)), schema, "Append", "EventTime")


def fresh_enough(rows: DataFrame, current_version: int, staleness: int) -> DataFrame:
    """Samples made by parameters at most ``staleness`` versions old (M1)."""
    return rows.filter(F.lit(current_version) - F.col("parameter_version") <= staleness)


def samples_per_sync(trigger: int, require: int, mini: int, total: int) -> int:
    """trigger * require * mini, which must divide the total."""
    n = trigger * require * mini
    if n <= 0 or total % n:
        raise ValueError(f"{total} samples are not a whole number of syncs of {n}")
    return n


def fresh_files(files: DataFrame, since_s: float, slack_s: float = 300) -> DataFrame:
    """Files written after a start time, less some slack (M6)."""
    return files.filter(F.unix_timestamp("modificationTime") >= F.lit(since_s - slack_s))


def version_rollup(rows: DataFrame) -> DataFrame:
    """Running trajectories and successes by version (M11); the same plan in batch and in an update stream."""
    return rows.groupBy("version").agg(F.count(F.lit(1)).alias("trajectories"), F.count_if(F.col("reward") > 0).alias("successes"))


def first_abort(spark: SparkSession, path: str):
    """A foreachBatch function that records the first abort only (M4): rows (reason, source) of a batch. Of several streams,
    in any process, the file system lets one write the record."""
    from agentlake.sources.sinks import write_json

    def record(batch: DataFrame, batch_id: int) -> None:
        for row in batch.orderBy("reason").limit(1).collect():
            try:
                write_json(spark, path, {"reason": row["reason"], "source": row["source"], "batch": batch_id})
            except FileExistsError:
                pass

    return record


def deduplicated(rows: DataFrame, key: str, ts: str, lateness: str) -> DataFrame:
    """Each key once within the watermark, so a resumed stream doesn't repeat finished work (M7)."""
    return rows.withWatermark(ts, lateness).dropDuplicatesWithinWatermark([key])


def settled(probe, deadline_s: float, every_s: float = 1.0) -> bool:
    """Polls until certified or out of time."""
    import time

    end = time.monotonic() + deadline_s
    while not probe():
        if time.monotonic() >= end:
            return False
        time.sleep(every_s)
    return True
