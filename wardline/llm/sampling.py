"""Folds and bounded samples of labelled rows, from which the classifiers are fitted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(doc_id: str, folds: int) -> Column:
    """crc32 of the id as text modulo ``folds``; null for a null id."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(folds))


def held_out(doc_id: str, folds: int, fold: int) -> Column:
    """Whether a row is kept from learning; false for a null id, which is not learned from either."""
    return F.coalesce(remainder(doc_id, folds) == fold, F.lit(False))


def labelled_ids(labels: DataFrame, label: str, per_class: int) -> tuple[list[tuple], dict]:
    """Up to ``per_class`` (doc_id, label) rows of each label in hash order, and the number of rows of each label.

    The number of distinct labels (classes, languages) is taken to be small. Only ids
    and labels are read.
    """
    rows = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.col(label).alias("label"))
    totals = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    picked: list[tuple] = []
    for value in sorted(totals):
        first = rows.where(F.col("label") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        picked += [(r["doc_id"], r["label"]) for r in first.collect()]
    return picked, totals


def labelled_rows(docs: DataFrame, picked: list[tuple], label_type: str) -> DataFrame:
    """Texts of the sampled ids with their labels; the broadcast side has the sample's bounded size."""
    spark = docs.sparkSession
    kind = dict(docs.dtypes)["doc_id"]
    ids = spark.createDataFrame(picked, f"doc_id {kind}, label {label_type}")
    return docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")


def sampled(docs: DataFrame, picked: list[tuple], label_type: str) -> DataFrame:
    """The sampled documents' texts with their labels, bounded even if ids repeat."""
    return labelled_rows(docs, picked, label_type).limit(2 * len(picked) + 1)
