"""Reachability, vulnerability spread, cycles and trust over ``src, dst`` edges.

All loops are semi-naive: a round joins only what the last round found, and its
result is written to the shared folder before the next one starts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.plans.stages import Stages, reach


def transitive(edges: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """``root, node``: everything a root depends on, directly or not, without itself.

    ``roots`` is a one-column frame; left out, every edge source is a root.
    """
    stages = Stages(edges.sparkSession, "transitive")
    links = stages.write(edges.select("src", "dst").distinct())
    seed = links.select(F.col("src").alias("root"), F.col("dst").alias("node"))
    if roots is not None:
        seed = seed.join(roots.toDF("root").distinct(), "root", "left_semi")

    def step(frontier: DataFrame) -> DataFrame:
        return frontier.join(links, frontier["node"] == links["src"]).select("root", F.col("dst").alias("node"))

    return reach(seed, step, stages).where(F.col("root") != F.col("node"))


def affected(edges: DataFrame, vulnerable: DataFrame) -> DataFrame:
    """``node, cause``: nodes that depend on a vulnerable node, one row per cause.

    Vulnerable nodes themselves are neither reported nor walked through.
    """
    stages = Stages(edges.sparkSession, "affected")
    bad = stages.write(vulnerable.toDF("bad").distinct())
    links = stages.write(
        edges.select("src", "dst").distinct().join(bad, F.col("src") == F.col("bad"), "left_anti")
    )
    seed = links.join(bad, links["dst"] == bad["bad"]).select(F.col("src").alias("node"), F.col("bad").alias("cause"))

    def step(frontier: DataFrame) -> DataFrame:
        return frontier.join(links, frontier["node"] == links["dst"]).select(F.col("src").alias("node"), "cause")

    return reach(seed, step, stages)


def affected_versions(edges: DataFrame, matches: DataFrame, vulnerable: DataFrame) -> DataFrame:
    """Version-aware spread: an edge reaches *every* version its constraint admits.

    ``edges`` hold ``node, dep_name, raw_constraint`` and ``matches`` hold
    ``dep_name, raw_constraint, dep_node``. The walk alternates between the two,
    so the edge-times-version product is never built.
    """
    stages = Stages(edges.sparkSession, "affected-versions")
    bad = stages.write(vulnerable.toDF("bad").distinct())
    needs = stages.write(
        edges.select("node", "dep_name", "raw_constraint")
        .distinct()
        .join(bad, F.col("node") == F.col("bad"), "left_anti")
    )
    admits = stages.write(matches.select("dep_name", "raw_constraint", "dep_node").distinct())
    rule = ["dep_name", "raw_constraint"]

    def step(frontier: DataFrame) -> DataFrame:
        hit = frontier.join(admits, frontier["node"] == admits["dep_node"]).select("cause", *rule).distinct()
        return hit.join(needs, rule).select("node", "cause")

    seed = step(bad.select(F.col("bad").alias("node"), F.col("bad").alias("cause"))).distinct()
    return reach(seed, step, stages)


def cycle_groups(edges: DataFrame) -> DataFrame:
    """``node, cycle``: nodes that can reach themselves, grouped by mutual reach.

    A group is named after its smallest member. Nodes off every cycle are peeled
    away first. What is left is split by colouring: each node takes the largest
    label that reaches it, and walking back from a label's own node inside its
    colour gives exactly one group. Work per round is linear in the edges left.
    """
    stages = Stages(edges.sparkSession, "cycles")
    links = stages.write(edges.select("src", "dst").distinct())
    loops = links.where(F.col("src") == F.col("dst")).select(F.col("src").alias("node"))
    core, size = stages.measured(links.where(F.col("src") != F.col("dst")), F.count(F.lit(1)))
    found = []
    while size:
        core, size = _peel(core, size, stages)
        if size == 0:
            break
        colours = _colour(core, stages)
        group = stages.write(_walk_back(core, colours))
        found.append(group.groupBy("colour").agg(F.min("node").alias("cycle")).join(group, "colour").select("node", "cycle"))
        # An edge between two groups is on no cycle; one inside a group is settled.
        left = core.join(group.select(F.col("node").alias("src")), "src", "left_anti")
        left = left.join(group.select(F.col("node").alias("dst")), "dst", "left_anti").select("src", "dst")
        core, size = stages.measured(left, F.count(F.lit(1)))
    groups = loops.select("node", F.col("node").alias("cycle"))
    if found:
        members = reduce(DataFrame.unionByName, found)
        sizes = members.groupBy("cycle").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
        named = members.join(sizes, "cycle").select("node", "cycle")
        groups = named.unionByName(groups.join(named, "node", "left_anti"))
    return groups


def _peel(core: DataFrame, size: int, stages: Stages) -> tuple[DataFrame, int]:
    """Drop edges out of nodes nothing enters and into nodes nothing leaves, until none is left to drop."""
    while size:
        entered, left_from = core.select(F.col("dst").alias("src")), core.select(F.col("src").alias("dst"))
        kept = core.join(entered, "src", "left_semi").join(left_from, "dst", "left_semi").select("src", "dst")
        core, left = stages.measured(kept, F.count(F.lit(1)))
        if left == size:
            break
        size = left
    return core, size


def _colour(core: DataFrame, stages: Stages) -> DataFrame:
    """Largest node that reaches each node, itself included."""
    nodes = core.select(F.col("src").alias("node")).distinct()
    labels = stages.write(nodes.select("node", F.col("node").alias("colour"), F.lit(True).alias("changed")))
    moving = 1
    while moving:
        sent = (
            labels.where("changed")
            .join(core, F.col("node") == F.col("src"))
            .groupBy(F.col("dst").alias("node"))
            .agg(F.max("colour").alias("offer"))
        )
        better = F.coalesce(F.col("offer") > F.col("colour"), F.lit(False))
        moved = labels.join(sent, "node", "left").select(
            "node", F.when(better, F.col("offer")).otherwise(F.col("colour")).alias("colour"), better.alias("changed")
        )
        labels, moving = stages.measured(moved, F.count_if("changed"))
    return labels.drop("changed")


def _walk_back(core: DataFrame, colours: DataFrame) -> DataFrame:
    """``colour, node`` reached against the edges from each colour's own node."""
    stages = Stages(core.sparkSession, "walk-back")
    seed = colours.where(F.col("node") == F.col("colour")).select("colour", "node")
    source = colours.select(F.col("node").alias("src"), F.col("colour").alias("src_colour"))
    inner = core.join(source, "src")

    def step(frontier: DataFrame) -> DataFrame:
        same = (frontier["node"] == inner["dst"]) & (frontier["colour"] == inner["src_colour"])
        return frontier.join(inner, same).select("colour", F.col("src").alias("node"))

    return reach(seed, step, stages)


def lowest_trust(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Effective score per node: own score times the lowest effective score it depends on.

    ``nodes`` hold ``node, intrinsic``. A node is settled once all its
    dependencies are; the loop ends when a round settles none. Nodes on a cycle,
    above one, or depending on an unknown node stay unsettled: NULL ``effective``.
    """
    stages = Stages(nodes.sparkSession, "trust")
    links = stages.write(edges.select("src", "dst").distinct())
    needs = links.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("need"))
    start = nodes.select("node", "intrinsic").join(needs, "node", "left").fillna(0, ["need"])
    none = F.lit(None).cast("double")
    settled = F.col("got") == F.col("need")
    state = start.select("*", F.lit(0).cast("long").alias("got"), none.alias("lowest"))
    score = F.col("intrinsic") * F.coalesce("lowest", F.lit(1.0))
    while True:
        # One table per round: rows settled in it leave, the others wait for the next.
        state, count = stages.append(state, "state", F.count_if(settled))
        if count == 0:
            break
        ready = state.where(settled).select(F.col("node").alias("dst"), score.alias("effective"))
        news = (
            links.join(ready, "dst")
            .groupBy(F.col("src").alias("node"))
            .agg(F.count(F.lit(1)).alias("more"), F.min("effective").alias("low"))
        )
        state = (
            state.where(~settled)
            .join(news, "node", "left")
            .select(
                "node",
                "intrinsic",
                "need",
                (F.col("got") + F.coalesce("more", F.lit(0))).alias("got"),
                F.least("lowest", "low").alias("lowest"),
            )
        )
    done = stages.table("state", state).where(settled).select("node", "intrinsic", score.alias("effective"))
    return done.unionByName(state.select("node", "intrinsic", none.alias("effective")))
