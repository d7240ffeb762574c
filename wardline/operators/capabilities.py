"""Capability sets as long tables ``(key, resource, access)``.

Access levels form a chain, so the join of two levels is the larger one and the
meet the smaller one. A set holds one row per key and resource after
:func:`normalise`, which also makes every join below one-to-one per key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.functions import catalog as C


def level_join(*levels: Column) -> Column:
    return F.greatest(F.lit(C.NONE), *levels)


def level_meet(*levels: Column) -> Column:
    return F.least(F.lit(C.ADMIN), *levels)


def normalise(caps: DataFrame, key: str) -> DataFrame:
    """Highest access per key and resource."""
    return caps.groupBy(key, "resource").agg(F.max("access").alias("access"))


def join_and_meet(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Both bounds per key and resource; a missing side counts as NONE."""
    other = normalise(right, key).withColumnRenamed("access", "_right")
    pairs = normalise(left, key).join(other, [key, "resource"], "full")
    mine, theirs = F.coalesce("access", F.lit(C.NONE)), F.coalesce("_right", F.lit(C.NONE))
    return pairs.select(
        key, "resource", level_join(mine, theirs).alias("join_level"), level_meet(mine, theirs).alias("meet_level")
    )


def permits(held: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """Adds ``permitted`` to the wanted rows. A resource not held permits nothing, not even NONE."""
    limits = normalise(held, key).withColumnRenamed("access", "_held")
    checked = wanted.join(limits, [key, "resource"], "left")
    return checked.withColumn("permitted", F.coalesce(F.col("_held") >= F.col("access"), F.lit(False))).drop("_held")


def violations(held: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """Wanted rows that the held set does not permit."""
    return permits(held, wanted, key).where(~F.col("permitted")).drop("permitted")


def subset_of(held: DataFrame, wanted: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Per key: is everything wanted also permitted? An empty wanted set is a subset of anything."""
    verdicts = permits(held, wanted, key).groupBy(key).agg(F.bool_and("permitted").alias("is_subset"))
    return keys.select(key).join(verdicts, key, "left").fillna(True, ["is_subset"])


def contained(held: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """Wanted rows held at exactly the same level."""
    return wanted.join(normalise(held, key), [key, "resource", "access"], "left_semi")


def matrix(caps: DataFrame, key: str) -> DataFrame:
    """One row per key, one column per resource, missing resources at NONE."""
    wide = caps.groupBy(key).pivot("resource", list(C.RESOURCES)).agg(F.max("access"))
    return wide.fillna(C.NONE, list(C.RESOURCES))
