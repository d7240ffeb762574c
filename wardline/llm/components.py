"""Connected components of a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.plans.stages import Stages


LEAST_TASKS = 12
ROWS_PER_TASK = 100_000


def tasks_for(rows: int, per_task: int = ROWS_PER_TASK) -> int:
    """Tasks for a measured number of narrow rows, so that small rounds do not run many empty tasks."""
    return max(LEAST_TASKS, -(-rows // per_task))


def components(edges: DataFrame, stages: Stages) -> DataFrame:
    """(node, component) of every node of the edges (a, b); the component is its smallest node.

    Every node hooks onto its smallest neighbour, hooks are followed to their ends by
    doubling, and edges are drawn anew between those ends; edges inside a component drop
    out, so that each round works on fewer. Every round's tables are written.
    """
    apart = edges.where("a != b").select(F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high"))
    live, count = stages.measured(apart, F.count(F.lit(1)))
    labels = None
    while labels is None or count:
        tasks = tasks_for(count)
        ends = live.select(F.col("high").alias("node"), F.col("low").alias("other")).unionByName(
            live.select(F.col("low").alias("node"), F.col("high").alias("other"))
        )
        hooks = ends.groupBy("node").agg(F.least("node", F.min("other")).alias("root"))
        hooks = stages.write(hooks.coalesce(tasks))
        moved = 1
        while moved:
            ahead = hooks.select(F.col("node").alias("root"), F.col("root").alias("next"))
            jumped = hooks.join(ahead, "root").select("node", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved"))
            hooks, moved = stages.measured(jumped.coalesce(tasks), F.count_if("moved"))
            hooks = hooks.drop("moved")
        if labels is None:
            labels = hooks.withColumnRenamed("root", "component")
        else:
            further = hooks.select(F.col("node").alias("component"), "root")
            joined = labels.join(further, "component", "left").select("node", F.coalesce("root", "component").alias("component"))
            labels = stages.write(joined.coalesce(tasks))
        lows, highs = hooks.toDF("low", "first"), hooks.toDF("high", "second")
        drawn = live.join(lows, "low").join(highs, "high").where("first != second")
        again = drawn.select(F.least("first", "second").alias("low"), F.greatest("first", "second").alias("high")).distinct()
        live, count = stages.measured(again.coalesce(tasks), F.count(F.lit(1)))
    return labels
