"""The protocol of an episode: what a policy asked for, what it was given and when, and what it submitted (Q13, M8).

Events (episode_id, seq, kind, request, tool, text) in order of ``seq``; ``kind`` is one of

- ``request``: the policy is about to generate its ``request``-th turn (ascending numbers). What is pending is now
  delivered: only then does an observation count as evidence.
- ``observation``: a tool gave ``text``. It gets the next number, is clipped to the budget first (its marker line included),
  and waits for the next request.
- ``submit``: ``text`` is the report, strict JSON of an object whose ``path`` may be JSON in a string. Of several
  submissions the last one that is an object, or isn't JSON (then an empty text), stands.
- ``finalise``: the record comes out; what was never delivered keeps no text. Later events are ignored.

``records`` replays whole tables with windows and aggregates; ``record_stream`` keeps each open episode as state.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, IntegerType, LongType, StringType, StructField, StructType

from agentlake.functions import text as tx
from agentlake.functions.arrow import arrow
from agentlake.functions.structured import strict_json

SUFFIX = "...(truncated)"
OBSERVATION = "observation_id string, order int, tool string, outcome string, generated_by_request int, delivered_to_request int, delivered_text string"
RECORD = f"episode_id string, terminal_seen boolean, terminal_text string, observations array<struct<{', '.join(c.replace(' ', ': ', 1) for c in OBSERVATION.split(', '))}>>"
NAMES = [c.split()[0] for c in OBSERVATION.split(", ")]


def submitted(text: str | None) -> str | None:
    """The report as one line of JSON; empty if it isn't strict JSON, None if it isn't an object."""
    try:
        report = strict_json(text or "")
        if not isinstance(report, dict):
            return None
        if isinstance(report.get("path"), str):
            report = report | {"path": strict_json(report["path"])}
        return json.dumps(report, ensure_ascii=False, allow_nan=False)
    except ValueError:
        return ""


@arrow("string")
def _submitted(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else submitted(t))


def clipped(text: Column, order: Column, most: int) -> Column:
    """The text of an observation as the policy sees it after its marker line, all within ``most`` characters."""
    room = F.greatest(F.lit(most) - F.length(F.concat(F.lit("[observation obs_"), order.cast("string"), F.lit("]\n"))), F.lit(0))
    cut = F.concat(F.substring(text, F.lit(1), F.greatest(room - len(SUFFIX), F.lit(0))), F.substring(F.lit(SUFFIX), F.lit(1), room))
    return F.when(F.length(text) > room, cut).otherwise(text)


def records(events: DataFrame, most: int) -> DataFrame:
    """Batch form: a record (RECORD) for each episode that was finalised."""
    w = Window.partitionBy("episode_id").orderBy("seq")
    before, after = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(1, Window.unboundedFollowing)
    asked = F.when(F.col("kind") == "request", F.col("request"))
    at = events.withColumn("over", F.coalesce(F.count_if(F.col("kind") == "finalise").over(before), F.lit(0))).filter("over = 0")
    at = at.withColumn("n", F.count_if(F.col("kind") == "observation").over(w)).withColumn("by", F.coalesce(F.last(asked, ignorenulls=True).over(before), F.lit(0)))
    at = at.withColumn("to", F.first(asked, ignorenulls=True).over(after)).withColumn("cut", clipped(F.coalesce("text", F.lit("")), F.col("n"), most))
    fields = (
        F.concat(F.lit("obs_"), F.col("n").cast("string")), F.col("n").cast("int"), F.col("tool"), tx.tool_outcome("cut"), F.col("by").cast("int"), F.col("to").cast("int"), F.when(F.col("to").isNotNull(), F.col("cut")),
    )
    seen = F.struct("n", *(f.alias(name) for f, name in zip(fields, NAMES, strict=True)))
    given = _submitted(F.when(F.col("kind") == "submit", F.coalesce("text", F.lit(""))))
    at = at.withColumn("given", given)
    listed = F.transform(F.sort_array(F.collect_list(F.when(F.col("kind") == "observation", seen))), lambda o: F.struct(*(o[name].alias(name) for name in NAMES)))
    done = at.groupBy("episode_id").agg(
        F.count_if(F.col("kind") == "finalise").alias("ends"), (F.count_if(F.col("kind") == "submit") > 0).alias("terminal_seen"),
        F.coalesce(F.max_by("given", F.when(F.col("given").isNotNull(), F.col("seq"))), F.lit("")).alias("terminal_text"), listed.alias("observations"),
    )
    return done.filter("ends > 0").select("episode_id", "terminal_seen", "terminal_text", "observations")


class Episode(StatefulProcessor):
    """An open episode: its observations so far in a list, the rest in a value. Finalising ends the state."""

    def __init__(self, most: int):
        self.most = most

    def init(self, handle: StatefulProcessorHandle) -> None:
        kinds = {"string": StringType(), "int": IntegerType()}
        self.told = handle.getListState("told", StructType([StructField(c.split()[0], kinds[c.split()[1]]) for c in OBSERVATION.split(", ")]))
        fields = [("n", IntegerType()), ("request", IntegerType()), ("seen", BooleanType()), ("text", StringType()), ("over", BooleanType()), ("seq", LongType())]
        self.rest = handle.getValueState("rest", StructType([StructField(*f) for f in fields]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n, now, seen, text, over, last = self.rest.get() if self.rest.exists() else (0, 0, False, "", False, -1)
        if over:
            return
        told = [list(o) for o in self.told.get()]
        held = [tuple(o) for o in told]
        for e in pd.concat(list(rows)).sort_values("seq").itertuples():  # of a micro-batch
            last = int(e.seq)
            if e.kind == "request":
                now = int(e.request)
                for o in told:
                    if o[5] is None and o[4] < now:
                        o[5] = now
            elif e.kind == "observation":
                n += 1
                room = max(0, self.most - len(f"[observation obs_{n}]\n"))
                said = e.text or ""
                said = said if len(said) <= room else said[: max(0, room - len(SUFFIX))] + SUFFIX[:room]
                told.append([f"obs_{n}", n, e.tool, None, now, None, said])
            elif e.kind == "submit":
                seen, given = True, submitted(e.text)
                text = text if given is None else given
            elif e.kind == "finalise":
                over = True
                break
        self.rest.update((n, now, seen, text, over, last))
        if over:
            self.told.clear()
            out = [dict(zip(NAMES, (*o[:6], o[6] if o[5] is not None else None), strict=True)) | {"outcome": o[6]} for o in told]
            yield pd.DataFrame({"episode_id": [key[0]], "terminal_seen": [seen], "terminal_text": [text], "observations": [out]})
        elif [tuple(o) for o in told] != held:
            self.told.put([tuple(o) for o in told])

    def close(self) -> None:
        pass


def record_stream(events: DataFrame, most: int) -> DataFrame:
    """Append stream of records (RECORD) as episodes are finalised. A source must give an episode's events in order; of a
    finished one a few numbers stay in state, so late events don't open it again."""
    schema = StructType.fromDDL(RECORD)
    out = events.select("episode_id", "seq", "kind", "request", "tool", "text").groupBy("episode_id").transformWithStateInPandas(Episode(most), schema, "Append", "None")
    named = F.transform("observations", lambda o: o.withField("outcome", tx.tool_outcome(o["outcome"])))  # the state carries the text itself
    return out.withColumn("observations", named)


def conversation_events(turns: DataFrame) -> DataFrame:
    """Turns (conv_id, turn, role, text) as events: a user's turn is what a tool gave, an assistant's is a request that then
    submits what it says; after the last turn the episode is finalised."""
    none = F.lit(None)

    def e(n: int, kind: str, text: Column = none, request: Column = none) -> Column:
        return F.struct(F.lit(n).alias("n"), F.lit(kind).alias("kind"), request.cast("int").alias("request"), text.cast("string").alias("text"))

    last = F.col("turn") == F.max("turn").over(Window.partitionBy("conv_id"))
    said = F.when(F.col("role") == "assistant", F.array(e(0, "request", request=F.col("turn") + 1), e(1, "submit", F.to_json(F.struct(F.col("text").alias("answer")))))).otherwise(F.array(e(0, "observation", F.col("text"))))
    every = F.concat(said, F.filter(F.array(e(2, "finalise")), lambda x: F.col("last")))
    at = turns.withColumn("last", last).select(F.col("conv_id").cast("string").alias("episode_id"), "turn", F.col("role").alias("tool"), F.explode(every).alias("e"))
    return at.select("episode_id", (F.col("turn").cast("long") * 4 + F.col("e.n")).alias("seq"), "e.kind", "e.request", "tool", "e.text")
