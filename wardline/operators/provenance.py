"""Row stamps: a hash over a row's canonical JSON, and its later check."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STAMP = "content_hash"


def row_hash(columns: list[str]) -> Column:
    """SHA-256 over the columns in name order, NULLs kept visible."""
    canonical = F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"})
    return F.sha2(canonical, 256)


def stamp(df: DataFrame) -> DataFrame:
    return df.withColumn(STAMP, row_hash(df.columns))


def verify(df: DataFrame) -> DataFrame:
    """Adds ``intact``; a missing stamp is not intact."""
    content = [c for c in df.columns if c != STAMP]
    return df.withColumn("intact", F.coalesce(F.col(STAMP) == row_hash(content), F.lit(False)))
