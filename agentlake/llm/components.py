"""Distributed union-find: connected components of an edge table by hooking, pointer jumping and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agentlake.llm.shared import materialise, narrow

#: Rows up to which (counted) a table of labels is broadcast.
FEW = 1_000_000


def _mapped(rows: DataFrame, columns: list[str], labels: DataFrame) -> DataFrame:
    """``rows`` with the ids in ``columns`` replaced by their labels (id, label); ids without one stay."""
    for c in columns:
        found = rows.join(labels.toDF(c, "_agentlake_label"), c, "left")
        rows = found.withColumn(c, F.coalesce("_agentlake_label", c)).select(*rows.columns)
    return rows


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """(id, component) for every id in ``edges`` (a, b); component is the smallest id reachable.

    Each round hooks every id to the least of itself and its neighbours (combined map-side, so a hub's edges don't
    gather) and jumps to that one's hook. Edges are contracted to their ends' labels, and those within one label
    leave, until none is left; then each id's labels of the rounds are followed. Labels that are few are broadcast,
    so that a round shuffles its edges once. Rounds grow with the logarithm of a component's diameter; ``rounds`` only
    guards against a fault.
    """
    left, steps = materialise(edges.filter("a <> b").select("a", "b"), "links"), []
    for _ in range(rounds):
        near = left.select(F.explode(F.array(F.struct(F.col("a").alias("id"), F.col("b").alias("near")), F.struct(F.col("b").alias("id"), F.col("a").alias("near")))).alias("e")).select("e.*")
        hooks = materialise(near.groupBy("id").agg(F.least("id", F.min("near")).alias("hook")), "hooks")
        few = hooks.count() <= FEW
        jumped = _mapped(hooks, ["hook"], F.broadcast(hooks) if few else hooks)
        steps.append(F.broadcast(jumped) if few else materialise(jumped, "jumped"))
        left = materialise(_mapped(left, ["a", "b"], steps[-1]).filter("a <> b"), "links")
        if not left.limit(1).count():
            labels = steps[0].toDF("id", "component")
            for step in steps[1:]:
                labels = _mapped(labels, ["component"], step)
            return materialise(labels, "labels")
    raise RuntimeError("components did not settle")


def merged(labels: DataFrame, more: DataFrame) -> DataFrame:
    """(id, component) as of the edges that gave ``labels`` (id, component) and of ``more`` (a, b), whose ids may be new."""
    near = narrow(labels, FEW)
    joined = narrow(components(_mapped(more.select("a", "b"), ["a", "b"], near)), FEW)
    new = joined.join(near.select("id"), "id", "left_anti")
    return materialise(_mapped(labels, ["component"], joined).unionByName(new), "labels")
