"""The episode protocol as a stream, in batch, and by hand."""

import json

from pyspark.sql import Window
from pyspark.sql import functions as F
from test_streams import files, run

from agentlake.streaming import protocol

EVENTS = "episode_id string, seq long, kind string, request int, tool string, text string, part int"


def made(df):
    return sorted((r["episode_id"], r["terminal_seen"], r["terminal_text"], [tuple(o) for o in r["observations"]]) for r in df)


def hand():
    long = "x" * 60
    return [
        ("a", 0, "request", 1, None, None, 0), ("a", 1, "observation", None, "search", "No documents found", 0), ("a", 2, "observation", None, "read", long, 0), ("a", 3, "request", 2, None, None, 1),
        ("a", 4, "observation", None, "run", "Error: x", 1), ("a", 5, "submit", None, None, '{"answer": 1, "answer": 2}', 1), ("a", 6, "submit", None, None, '{"answer": "ä", "path": "[1, 2]"}', 2), ("a", 7, "submit", None, None, "[3]", 2),
        ("a", 8, "finalise", None, None, None, 2), ("a", 9, "observation", None, "late", "ignored", 2), ("a", 10, "request", 3, None, None, 2),
        ("b", 0, "observation", None, "read", "", 0), ("b", 1, "finalise", None, None, None, 1), ("c", 0, "request", 1, None, None, 0), ("d", 0, "submit", None, None, None, 1), ("d", 1, "finalise", None, None, None, 2),
    ]


def test_by_hand(spark, tmp_path):
    df = spark.createDataFrame(hand(), EVENTS)
    want = [
        ("a", True, json.dumps({"answer": "ä", "path": [1, 2]}, ensure_ascii=False), [("obs_1", 1, "search", "empty", 1, 2, "No documents found"), ("obs_2", 2, "read", "ok", 1, 2, "x" * 7 + "...(truncated)"), ("obs_3", 3, "run", "error", 2, None, None)]),
        ("b", False, "", [("obs_1", 1, "read", "empty", 0, None, None)]), ("d", True, "", []),
    ]
    assert made(protocol.records(df.drop("part"), 41).collect()) == want
    assert made(run(protocol.record_stream(files(spark, df, tmp_path), 41), tmp_path, "append")) == want


def test_stream_equals_batch_on_conversations(spark, tmp_path):
    turns = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    events = protocol.conversation_events(turns).withColumn("part", F.ntile(3).over(Window.orderBy("seq")) - 1)
    batch = protocol.records(events.drop("part"), 300)
    want = made(batch.collect())
    assert made(run(protocol.record_stream(files(spark, events, tmp_path), 300), tmp_path, "append")) == want and len(want) == turns.select("conv_id").distinct().count()
