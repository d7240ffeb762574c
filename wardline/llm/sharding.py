"""Shards of near equal size by longest-processing-time scheduling.

Equal texts form a group that stays together. Groups are sorted by size and each goes to
the least loaded shard, through a heap. The driver only schedules a number of items that
is bounded by parameters: every group larger than a fixed share of one shard is an item
(their number is bounded because their sizes add up), and the smaller groups are dealt by
hash into a fixed number of bundles, which are items too. With few documents every group
is an item of its own.

Defined results: a null text counts as an empty one (size 1, crc 0) and shares its group;
repeated rows keep one row each; an empty table gives no rows.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.plans.shape import running_in_blocks
from wardline.plans.stages import Stages

PARTS = 256
ROWS_PER_BLOCK = 20_000
LEAST_BLOCKS = 64


def schedule(sizes: list[int], shards: int) -> list[int]:
    """Shard of each item: by size, largest first, to the least loaded shard (the lower number on ties)."""
    heap = [(0, shard) for shard in range(shards)]
    placed = [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        load, shard = heapq.heappop(heap)
        placed[i] = shard
        heapq.heappush(heap, (load + sizes[i], shard))
    return placed


def shard(df: DataFrame, shards: int = 8, text: str = "text", parts: int = PARTS) -> DataFrame:
    """Adds size, text_crc32, shard and slot (in place of columns of those names), and leaves out the text.

    ``parts`` sets how fine the items are: at most ``2 * shards * parts`` of them, each
    group above a ``parts``-th of a shard alone.
    """
    spark = df.sparkSession
    content = F.coalesce(F.col(text), F.lit("")).cast("binary")
    added = ("size", "text_crc32", "shard", "slot")
    kept = [c for c in df.columns if c != text and c not in added]
    stages = Stages(spark, "sharding")
    rows, total = stages.measured(
        df.select(
            F.struct(F.lit(0).alias("_none"), *[F.col(c) for c in kept]).alias("_doc"),
            (F.length(content) + F.lit(1)).cast("long").alias("size"),
            F.crc32(content).alias("text_crc32"),
            F.unhex(F.sha2(content, 256)).alias("_group"),
            F.monotonically_increasing_id().alias("_row"),
        ),
        F.sum("size"),
    )
    groups = rows.groupBy("_group").agg(F.sum("size").alias("_bytes"))
    items = shards * parts
    large = F.col("_bytes") * items > F.lit(total)
    bundle = F.pmod(F.xxhash64("_group"), F.lit(items)).cast("int")
    # a large group is known by its key, the rest by their bundle
    sums = groups.groupBy(F.when(large, F.col("_group")).alias("_group"), F.when(~large, bundle).alias("_bundle"))
    listed = sums.agg(F.sum("_bytes").alias("_bytes")).orderBy("_group", "_bundle").collect()
    placed = schedule([r["_bytes"] for r in listed], shards)
    alone = [(bytes(r["_group"]), s) for r, s in zip(listed, placed) if r["_group"] is not None]
    together = [(r["_bundle"], s) for r, s in zip(listed, placed) if r["_group"] is None]
    by_group = F.broadcast(spark.createDataFrame(alone, "_group binary, _own int"))
    by_bundle = F.broadcast(spark.createDataFrame(together, "_bundle int, _shared int"))
    assigned = (
        rows.withColumn("_bundle", bundle)
        .join(by_group, "_group", "left")
        .join(by_bundle, "_bundle", "left")
        .withColumn("shard", F.coalesce("_own", "_shared"))
        .drop("_group", "_bundle", "_own", "_shared")
    )
    return _with_slots(assigned, rows.count()).select(*[F.col("_doc")[c].alias(c) for c in kept], *added)


def _with_slots(df: DataFrame, rows: int) -> DataFrame:
    """Numbers the rows of each shard from 0 without a gap; a shard's rows are ordered in blocks."""
    count = max(LEAST_BLOCKS, rows // ROWS_PER_BLOCK)
    blocked = df.withColumn("_part", F.pmod(F.xxhash64("_row"), F.lit(count)))
    numbered = running_in_blocks(
        blocked,
        ["shard"],
        ["_part"],
        [F.col("_row")],
        [F.col("_part")],
        F.row_number(),
        F.count(F.lit(1)),
        F.sum("_block"),
    )
    slot = F.coalesce("_before", F.lit(0)) + F.col("_within") - 1
    return numbered.withColumn("slot", slot.cast("long")).drop("_part", "_within", "_before", "_row")
