"""Mixing of sources to target weights as a time-varying curriculum.

Each source gets a share of all words by its weight, at most ``MOST_REPEATS`` times what
it has; what exceeds that is shared again among the others. Over the training time from 0
to 1 a source's demand follows the schedule of its weight class: the schedule is
integrated, scaled to the source's target, and inverted, which gives every copy of a
document the position at which the words before it are used up. Documents are then sorted
by position in ranges.

All documents of a source come in the order of a hash. As many whole passes are made as
the target allows, then the first documents of one more pass, the last of them cut so
that the target is met to the word.

Defined results: a null or blank text has size 0 and is never taken; a null source is a
source of its own, the last; an empty table gives no rows; repeated rows count each.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wardline.plans.shape import running_in_blocks
from wardline.plans.stages import Stages

WORD = r"[^\x20\x09-\x0D]+"
CLASSES = 3
MOST_REPEATS = 3
ROWS_PER_BLOCK = 20_000
LEAST_BLOCKS = 256
#: Rate of use over training time of each weight class: steady, rising, falling late.
SCHEDULES = {
    1: ((0.0, 1.0), (1.0, 1.0)),
    2: ((0.0, 0.5), (1.0, 1.5)),
    3: ((0.0, 1.5), (0.5, 1.25), (1.0, 0.25)),
}


def size_of(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def ranked_sources(sources: DataFrame, stages: Stages) -> DataFrame:
    """Adds ``_source``, the place from 1 of each source by code point, null last.

    Sources are ranked within ranges, so that their number may grow.
    """
    order = F.col("source").asc_nulls_last()
    ranges = stages.write(sources.repartitionByRange(order).withColumn("_range", F.spark_partition_id()))
    numbered = running_in_blocks(
        ranges, [], ["_range"], [order], [F.col("_range")], F.row_number(), F.count(F.lit(1)), F.sum("_block")
    )
    return numbered.withColumn("_source", (F.coalesce("_before", F.lit(0)) + F.col("_within")).cast("int")).drop(
        "_range", "_within", "_before"
    )


def targets(sources: DataFrame, repeats: int = MOST_REPEATS) -> DataFrame:
    """Adds ``target``: the share of all words by weight, with the excess over the limit shared again.

    Takes source, ``source_size`` and ``weight``. Each round is one aggregate over the
    sources; numbers stay whole until the last division.
    """
    wide = "decimal(38,0)"
    limit, weight = (F.col("source_size") * repeats).cast(wide), F.col("weight").cast(wide)
    total, weights = sources.agg(F.sum("source_size"), F.sum("weight")).first()
    share, parts = int(total or 0), int(weights or 1)
    while True:
        above = weight * F.lit(share).cast("decimal(19,0)") > limit * F.lit(parts).cast("decimal(19,0)")
        full, open_weights = sources.agg(F.sum(F.when(above, limit)), F.sum(F.when(~above, weight))).first()
        rest = (int(total or 0) - int(full or 0), int(open_weights or 1))
        if rest == (share, parts):
            break
        share, parts = rest
    shared = (F.col("weight") * F.lit(share).cast("long")).cast("double") / F.lit(float(parts))
    return sources.withColumn("target", F.when(above, (F.col("source_size") * repeats).cast("double")).otherwise(shared))


def position(part: Column, weight: Column, schedules: dict = SCHEDULES) -> Column:
    """The time at which ``part`` (0 to 1) of a source's demand is used up."""
    result = F.lit(None).cast("double")
    for kind, knots in schedules.items():
        areas = [(b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:])]
        total, before = sum(areas), 0.0
        inverse = F.lit(None).cast("double")
        for (start, rate), (end, next_rate), area in zip(knots, knots[1:], areas):
            rest = part * F.lit(total) - F.lit(before)
            slope = (next_rate - rate) / (end - start)
            root = F.sqrt(F.greatest(F.lit(rate * rate) + F.lit(2 * slope) * rest, F.lit(0.0)))
            inverse = F.when(rest >= 0, F.lit(start) + F.lit(2.0) * rest / (F.lit(rate) + root)).otherwise(inverse)
            before += area
        result = F.when(weight == kind, inverse).otherwise(result)
    return result


def plan(df: DataFrame, keep: Sequence[str], text: str = "text", schedules: dict = SCHEDULES) -> DataFrame:
    """One row per document: the kept columns, size, source_size, target, taken, position and ``_copies``.

    ``df`` needs doc_id, source and the text. A kept column named like an added one gives
    way to it; ``_doc`` holds all kept ones. ``_copies`` lists the words and the position
    of each copy taken; ``position`` is that of the first.
    """
    stages = Stages(df.sparkSession, "mixing")
    sized = df.select(
        F.struct(F.lit(0).alias("_none"), *[F.col(c) for c in keep]).alias("_doc"),
        F.col("source"),
        F.col("doc_id").alias("_id"),
        size_of(text).alias("size"),
    )
    key = F.concat_ws(":", F.coalesce(F.col("_id").cast("string"), F.lit("")), F.col("size").cast("string"))
    sized = sized.withColumn("_digest", F.md5(key.cast("binary")))
    narrow, rows = stages.measured(sized.select("source", "size", "_digest"), F.count(F.lit(1)))
    count = max(LEAST_BLOCKS, rows // ROWS_PER_BLOCK)
    # blocks are ranges of the digest: order by block, then digest, is order by digest
    block = F.floor(F.conv(F.substring("_digest", 1, 8), 16, 10).cast("long") * F.lit(count) / F.lit(2**32)).cast("long")
    sources = narrow.groupBy("source").agg(F.sum("size").alias("source_size"))
    weighted = ranked_sources(sources, stages).withColumn("weight", (F.col("_source") - 1) % CLASSES + 1)
    priced = stages.write(targets(stages.write(weighted))).withColumnRenamed("source", "_name")
    known = F.col("source").eqNullSafe(F.col("_name"))
    placed = sized.withColumn("_part", block).join(priced, known)
    before = _before(narrow.withColumn("_part", block).join(priced, known))
    inside = W.partitionBy("_source", "_part").orderBy("_digest", "_id", "size").rowsBetween(W.unboundedPreceding, W.currentRow)
    run = placed.withColumn("_within", F.sum("size").over(inside)).join(before, ["_source", "_part"])
    start = F.coalesce("_before", F.lit(0)) + F.col("_within") - F.col("size")
    goal = F.floor("target").cast("long")
    passes = F.when(F.col("source_size") > 0, F.floor(goal / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    run = run.withColumn("_start", start).withColumn("_goal", goal).withColumn("_passes", passes)
    rest = F.col("_goal") - F.col("_passes") * F.col("source_size") - F.col("_start")
    extra = F.greatest(F.lit(0), F.least(F.col("size"), rest)).cast("long")
    run = run.withColumn("_extra", extra).withColumn("taken", F.col("_passes") * F.col("size") + F.col("_extra"))

    def copy(number: Column) -> Column:
        words = F.when(number < F.col("_passes"), F.col("size")).otherwise(F.col("_extra"))
        part = (number * F.col("source_size") + F.col("_start")).cast("double") / F.col("_goal").cast("double")
        return F.struct(words.alias("words"), position(part, F.col("weight"), schedules).alias("position"))

    numbers = F.sequence(F.lit(0), F.col("_passes").cast("int"))
    copies = F.filter(F.transform(numbers, copy), lambda c: c["words"] > 0)
    listed = run.withColumn("_copies", F.when(F.col("taken") > 0, copies))
    added = ["size", "source_size", "target", "taken"]
    first = F.col("_copies")[0]["position"].alias("position")
    own = [F.col("_doc")[c].alias(c) for c in keep if c not in (*added, "position", "_copies")]
    return listed.select("_doc", *own, *added, first, "_copies")


def _before(totals: DataFrame) -> DataFrame:
    """Words of a source in the blocks before each block."""
    sums = totals.groupBy("_source", "_part").agg(F.sum("size").alias("_words"))
    earlier = W.partitionBy("_source").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    return sums.select("_source", "_part", F.sum("_words").over(earlier).alias("_before"))


def first_words(text: Column, words: Column) -> Column:
    """The text up to the end of its n-th word."""
    pieces = F.split(text, r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")
    return F.array_join(F.slice(pieces, F.lit(1), words.cast("int")), "")


def mix(df: DataFrame, text: str = "text", schedules: dict = SCHEDULES) -> DataFrame:
    """The documents of the mix, a row per copy, sorted by position; the columns are those of ``df``."""
    copies = plan(df, df.columns, text, schedules).select("_doc", "size", F.explode("_copies").alias("_copy"))
    own = F.col("_doc")[text]
    cut = F.when(F.col("_copy.words") < F.col("size"), first_words(own, F.col("_copy.words"))).otherwise(own)
    ordered = copies.orderBy(F.col("_copy.position"))
    return ordered.select(*[(cut if c == text else F.col("_doc")[c]).alias(c) for c in df.columns])
