"""Package versions, and dependency edges resolved against them.

Node tables hold ``seq, name, version``; edge tables hold
``name, version, dep_name, raw_constraint``. Constraints repeat far more often
than edges do, so they are parsed once per distinct text and name and turned into
stretches of the version order; edges only ever join to that reduced table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.functions.semver import parse_constraint, parse_version, sort_key, spans
from wardline.plans.shape import pick, running_in_blocks
from wardline.plans.stages import Stages


def latest_nodes(nodes: DataFrame) -> DataFrame:
    """Later rows replace earlier rows of the same name and version."""
    return pick(nodes, ["name", "version"], ["seq"], last=True)


def with_semver(nodes: DataFrame) -> DataFrame:
    """Readable versions only, parsed; see :func:`unreadable` for the others."""
    return nodes.withColumn("semver", parse_version(F.col("version"))).where(F.col("semver").isNotNull())


def unreadable(nodes: DataFrame) -> DataFrame:
    return nodes.where(parse_version(F.col("version")).isNull())


def ranked(nodes: DataFrame) -> DataFrame:
    """Position of each version within its name, newest first, ties in input order, then by text.

    All rows are dealt over ranges of name and order and ranked inside a range; the rows
    of a name in earlier ranges are added from the ranges' counts. No name is too large.
    """
    stages = Stages(nodes.sparkSession, "ranked")
    parsed = with_semver(nodes).select("*", "semver.*").drop("semver")
    order = [F.col("major").desc(), F.col("minor").desc(), F.col("patch").desc(), F.col("seq"), F.col("version")]
    ranges = parsed.repartitionByRange(F.col("name"), *order).withColumn("_range", F.spark_partition_id())
    placed = running_in_blocks(
        stages.write(ranges),
        keys=["name"],
        block=["_range"],
        order=order,
        block_order=[F.col("_range")],
        per_row=F.count(F.lit(1)),
        per_block=F.count(F.lit(1)),
        across=F.sum("_block"),
    )
    rank = F.col("_within") + F.coalesce(F.col("_before"), F.lit(0))
    return placed.select(*nodes.columns, rank.alias("version_rank"))


def listed(nodes: DataFrame) -> DataFrame:
    """``name, available``: the distinct versions of each name in one text, newest first.

    Ties stand in input order, then by text, unreadable versions last. The text of a name holds
    all of its versions, so callers narrow ``nodes`` to the names that they report.
    """
    parsed = parse_version(F.col("version"))
    once = nodes.groupBy("name", "version").agg(F.min("seq").alias("seq")).withColumn("semver", parsed)
    newest_first = [-F.col(f"semver.{part}") for part in ("major", "minor", "patch")]
    row = F.struct(F.col("semver").isNull(), *newest_first, "seq", "version")
    texts = F.transform(F.sort_array(F.collect_list(row)), lambda r: r["version"])
    return once.groupBy("name").agg(F.array_join(texts, ", ").alias("available"))


PAIRS_PER_TASK = 1_000_000


def placed_spans(edges: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Readable versions by place, and the stretches of places that each constraint admits.

    A version's ``place`` is the number of versions of its name before it: by order, then
    later input first, then text, so that the last place of a stretch is its best version.
    Constraints are turned into stretches of the order; versions and the ends of stretches
    are sorted together, once, and an end gets the number of versions before it. No version
    is ever compared with a constraint: work is a sort of versions and ends. All rows are
    dealt over ranges of name and order, so no name is too large for a task. Dealing them
    over ranges reads them twice; what takes parsing is written before, and constraints are
    parsed once per text, however many names they stand with.

    Returns ``dep_name, place, dep_version, semver, dep_seq`` and
    ``dep_name, raw_constraint, first, after``, of which stretches without a version are left out.
    """
    stages = Stages(nodes.sparkSession, "spans")
    wanted = edges.select("dep_name", "raw_constraint").distinct().where(F.col("dep_name").isNotNull())
    texts = edges.select("raw_constraint").distinct()
    parsed = stages.write(texts.withColumn("_spans", spans(parse_constraint(F.col("raw_constraint")))))
    ends = wanted.join(parsed, "raw_constraint").select(
        "dep_name", "raw_constraint", F.posexplode("_spans").alias("part", "_span")
    ).select(
        "dep_name", "raw_constraint", "part", F.explode(F.array("_span.low", "_span.high")).alias("key")
    )
    named = nodes.where(F.col("name").isNotNull())
    have = stages.write(named.select("name", "version", "seq", parse_version(F.col("version")).alias("semver")))
    offered = have.where(F.col("semver").isNotNull()).select(
        F.col("name").alias("dep_name"),
        F.col("version").alias("dep_version"),
        "semver",
        F.col("seq").alias("dep_seq"),
        sort_key(F.col("semver")).alias("key"),
    ).withColumn("versions", F.lit(1))
    both = offered.unionByName(ends.withColumn("versions", F.lit(0)), allowMissingColumns=True)
    # an end stands before the versions that are equal to it
    order = [F.col("key"), F.col("versions"), F.col("dep_seq").desc(), F.col("dep_version")]
    ranges = both.repartitionByRange(F.col("dep_name"), *order).withColumn("_range", F.spark_partition_id())
    running = running_in_blocks(
        stages.write(ranges),
        keys=["dep_name"],
        block=["_range"],
        order=order,
        block_order=[F.col("_range")],
        per_row=F.sum("versions"),
        per_block=F.sum("versions"),
        across=F.sum("_block"),
    )
    before = F.col("_within") - F.col("versions") + F.coalesce("_before", F.lit(0))
    counted = stages.write(running.withColumn("place", before).drop("_within", "_before", "_range", "key"))
    placed = counted.where("versions = 1").select("dep_name", "place", "dep_version", "semver", "dep_seq")
    stretches = (
        counted.where("versions = 0")
        .groupBy("dep_name", "raw_constraint", "part")
        .agg(F.min("place").alias("first"), F.max("place").alias("after"))
    )
    return placed, stretches.where("first < after").drop("part")


def constraint_counts(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``dep_name, raw_constraint, candidates``: how many versions satisfy each constraint that any satisfies."""
    _, stretches = placed_spans(edges, nodes)
    return stretches.groupBy("dep_name", "raw_constraint").agg(F.sum(F.col("after") - F.col("first")).alias("candidates"))


def constraint_matches(edges: DataFrame, nodes: DataFrame, pairs_per_task: int = PAIRS_PER_TASK) -> DataFrame:
    """Each distinct ``(dep_name, raw_constraint)`` with every version that satisfies it.

    The places of each stretch are listed and looked up by equality: rows are only made for
    matches. A long stretch is cut first and its cuts are dealt over the tasks.
    """
    placed, stretches = placed_spans(edges, nodes)
    size = F.lit(pairs_per_task).cast("long")
    cuts = stretches.select(
        "dep_name", "raw_constraint", "after", F.explode(F.sequence(F.col("first"), F.col("after") - 1, size)).alias("start")
    ).repartition("dep_name", "raw_constraint", "start")
    stop = F.least(F.col("start") + size, F.col("after")) - 1
    listed = cuts.select("dep_name", "raw_constraint", F.explode(F.sequence(F.col("start"), stop)).alias("place"))
    return listed.join(placed, ["dep_name", "place"]).select("dep_name", "raw_constraint", "dep_version", "semver", "dep_seq")


def resolve_all(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Every satisfying version per distinct constraint, with the number of edges behind it."""
    users = edges.groupBy("dep_name", "raw_constraint").agg(F.count(F.lit(1)).alias("edge_count"))
    found = constraint_matches(edges, nodes).join(users, ["dep_name", "raw_constraint"])
    return found.select("dep_name", "raw_constraint", "dep_version", "edge_count")


def resolve_highest(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Each edge with the highest satisfying version; NULL when nothing satisfies it.

    That version is the last place of the constraint's last stretch: one lookup each.
    """
    placed, stretches = placed_spans(edges, nodes)
    last = stretches.groupBy("dep_name", "raw_constraint").agg((F.max("after") - 1).alias("place"))
    best = last.join(placed, ["dep_name", "place"]).select("dep_name", "raw_constraint", "dep_version")
    return edges.join(best, ["dep_name", "raw_constraint"], "left").select(
        "name", "version", "dep_name", "raw_constraint", "dep_version"
    )


def package_id(name: str, version: str):
    return F.concat_ws("@", F.col(name), F.col(version))


def version_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``src, dst`` edges between package versions, each to the highest satisfying version."""
    resolved = resolve_highest(edges, nodes).where(F.col("dep_version").isNotNull())
    return resolved.select(
        package_id("name", "version").alias("src"), package_id("dep_name", "dep_version").alias("dst")
    ).distinct()


def graph_stats(nodes: DataFrame, edges: DataFrame, conflicts: DataFrame) -> DataFrame:
    """Per name: versions, direct dependencies and conflicts."""
    counts = [
        nodes.groupBy("name").agg(F.countDistinct("version").alias("versions")),
        edges.groupBy("name").agg(F.count(F.lit(1)).alias("dependencies")),
        conflicts.groupBy("name").agg(F.count(F.lit(1)).alias("conflicts")),
    ]
    joined = counts[0].join(counts[1], "name", "left").join(counts[2], "name", "left")
    return joined.fillna(0, ["dependencies", "conflicts"])
