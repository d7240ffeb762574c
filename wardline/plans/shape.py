"""Row-shaping helpers chosen for their plans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def unnest(df: DataFrame, array: str, keep: Sequence[str | Column]) -> DataFrame:
    """One row per struct of ``array`` with the struct's fields as columns.

    The outer form plus a filter on the result is deliberate: a plain ``inline``
    lets the optimiser infer a size test below the projection, which would
    compute the whole array a second time.
    """
    item = df.schema[array].dataType.elementType
    rows = df.select(*keep, F.explode_outer(array).alias("_item")).where(F.col("_item").isNotNull())
    kept = [c for c in rows.columns if c != "_item"]
    return rows.select(*kept, *[F.col(f"_item.{f}").alias(f) for f in item.names])


def unnest_values(df: DataFrame, array: Column, keep: Sequence[str | Column], name: str) -> DataFrame:
    """One row per element of an array of plain values."""
    return df.select(*keep, F.explode_outer(array).alias(name)).where(F.col(name).isNotNull())


def pick(df: DataFrame, keys: Sequence[str], order: Sequence[str], last: bool) -> DataFrame:
    """One row per key: the last or first by ``order``.

    An aggregate, not a window: copies of a hot key collapse before the shuffle.
    """
    rest = [c for c in df.columns if c not in keys]
    rank = F.struct(*[F.col(c) for c in order])
    best = (F.max_by if last else F.min_by)(F.struct(*rest), rank)
    picked = df.groupBy(*keys).agg(best.alias("_row"))
    return picked.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest]).select(*df.columns)


def running_in_blocks(
    df: DataFrame,
    keys: Sequence[str],
    block: Sequence[str],
    order: Sequence[Column],
    block_order: Sequence[Column],
    per_row: Column,
    per_block: Column,
    across: Column,
) -> DataFrame:
    """Two-level running aggregate, so that no task orders a whole hot key.

    Rows are ordered only inside (keys, block). Blocks are reduced first with
    map-side partial aggregation, and the running value of the blocks before is
    taken over that much smaller table. ``per_row`` runs over the block's window,
    ``per_block`` reduces one block to ``_block``, and ``across`` runs over the
    preceding blocks' ``_block``. Adds ``_within`` and ``_before``.
    """
    parts = [*keys, *block]
    inside = W.partitionBy(*parts).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    before = W.partitionBy(*keys).orderBy(*block_order).rowsBetween(W.unboundedPreceding, -1)
    totals = df.groupBy(*parts).agg(per_block.alias("_block")).withColumn("_before", across.over(before)).drop("_block")
    return df.withColumn("_within", per_row.over(inside)).join(totals, parts)
