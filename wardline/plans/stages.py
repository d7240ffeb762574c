"""Written intermediate tables and frontier loops.

A loop step is written as a Parquet table in the shared folder and read back:
that cuts the lineage, survives lost executors, gives the optimiser real sizes
(so a small frontier is broadcast only when its measured size allows). The stop
test is observed while writing, so a round is one job.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from wardline.session import shared_folder


class Stages:
    """Tables of one job under one fresh folder; ``drop()`` removes them."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        unique = uuid.uuid4().hex
        self.root = f"{shared_folder(spark)}/{label}-{unique}"
        self._name = f"{label.replace('-', '_')}_{unique}"
        self._buckets: dict[str, int] = {}
        self._next = 0

    def _save(self, df: DataFrame, path: str, measure: Column) -> tuple[DataFrame, int]:
        seen = Observation()
        df.observe(seen, measure.alias("value")).write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path), int(seen.get["value"] or 0)

    def write(self, df: DataFrame) -> DataFrame:
        return self.measured(df, F.count(F.lit(1)))[0]

    def measured(self, df: DataFrame, measure: Column) -> tuple[DataFrame, int]:
        """Write a table and return it with an aggregate taken on the way."""
        self._next += 1
        return self._save(df, f"{self.root}/t{self._next}", measure)

    def append(self, df: DataFrame, table: str, measure: Column | None = None) -> tuple[DataFrame, int]:
        """Add one round's rows under a named table; returns those rows and a measure, by default their number."""
        self._next += 1
        rows = F.count(F.lit(1)) if measure is None else measure
        return self._save(df, f"{self.root}/{table}/round={self._next}", rows)

    def table(self, name: str, like: DataFrame) -> DataFrame:
        """All rounds appended so far, as one scan."""
        rows = self.spark.read.option("recursiveFileLookup", "true").schema(like.schema)
        return rows.parquet(f"{self.root}/{name}")

    def append_bucketed(self, df: DataFrame, table: str, keys: list[str], turn: int) -> tuple[DataFrame, int]:
        """Add one round's rows to a table bucketed by ``keys``; returns all rounds with ``_round``, and the number added."""
        name, seen = f"{self._name}_{table}", Observation()
        buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        rows = df.withColumn("_round", F.lit(turn)).observe(seen, F.count(F.lit(1)).alias("value"))
        writer = rows.write.format("parquet").mode("append").option("path", f"{self.root}/{table}")
        writer.bucketBy(self._buckets.setdefault(name, buckets), *keys).saveAsTable(name)
        return self.spark.table(name), int(seen.get["value"] or 0)

    def unregister(self) -> None:
        """Take the bucketed tables' names out of the catalog; their files stay."""
        for name in self._buckets:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self._buckets.clear()

    def drop(self) -> None:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.root)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def reach(
    seed: DataFrame,
    step: Callable[[DataFrame], DataFrame],
    stages: Stages,
) -> DataFrame:
    """Fixpoint of ``step`` from ``seed``: every row found once.

    ``step`` maps the rows found last round to candidate rows of the same
    columns. Rows seen before are dropped, so cycles end the loop by themselves: it
    stops on an empty frontier only. All rows seen stand in buckets of their key: a
    round deals out its candidates alone, and hashes them, not what was seen before. Rows
    with a null are left out.
    """
    keys = seed.columns
    turn = 0
    seen, found = stages.append_bucketed(seed.dropna(subset=keys).distinct(), "seen", keys, turn)
    while found:
        reached = step(seen.where(F.col("_round") == turn).select(*keys))
        candidates = reached.select(*keys).dropna(subset=keys).distinct()
        known = seen.select(*keys).join(candidates.hint("shuffle_hash"), keys, "left_semi")
        fresh = candidates.join(known.hint("shuffle_hash"), keys, "left_anti")
        turn += 1
        seen, found = stages.append_bucketed(fresh, "seen", keys, turn)
    stages.unregister()
    return stages.table("seen", seed)
