"""Queries on tables that are folders of several files, and on documents that hold NULLs."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from workloads import all_cases, compare

SF_DIR = "/root/testdata/sf0.001"
STREAMED = {"stream_drift": "documents", "stream_scan": "documents", "stream_evidence": "events"}


@pytest.mark.parametrize("name", list(STREAMED))
def test_stream_of_a_folder(name, spark, tmp_path):
    table = STREAMED[name]
    spark.read.parquet(f"{SF_DIR}/{table}.parquet").repartition(3).write.parquet(f"{tmp_path}/{table}.parquet")
    case = all_cases()[name]
    df = case.run(spark, str(tmp_path))
    got = compare.ordered(df.columns, [tuple(r) for r in df.collect()])
    assert compare.difference(got, compare.expected(compare.database(SF_DIR), case.sql)) == ""


@pytest.mark.parametrize("keys", [("lang",), ("source", "lang")])
@pytest.mark.parametrize("name", ["stream_drift", "stream_scan"])
def test_stream_of_partition_folders(name, keys, spark, tmp_path):
    spark.read.parquet(f"{SF_DIR}/documents.parquet").write.partitionBy(*keys).parquet(f"{tmp_path}/documents.parquet")
    _agrees(name, spark, tmp_path)


def test_stream_of_a_folder_with_one_file(spark, tmp_path):
    spark.read.parquet(f"{SF_DIR}/documents.parquet").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    _agrees("stream_scan", spark, tmp_path)


@pytest.mark.parametrize("name", ["stream_scan", "scan_findings", "framework_definitions", "source_findings"])
def test_documents_with_nulls(name, spark, tmp_path):
    rows = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    holes = {c: F.when(F.col("doc_id") % n != 1, F.col(c)) for c, n in (("text", 7), ("lang", 5), ("source", 3))}
    rows.withColumns(holes).write.parquet(f"{tmp_path}/documents.parquet")
    case = all_cases()[name]
    df = case.run(spark, str(tmp_path))
    db = compare.duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = compare.ordered(df.columns, [tuple(r) for r in df.collect()])
    assert compare.difference(got, compare.expected(db, case.sql)) == ""


def _agrees(name, spark, folder):
    case = all_cases()[name]
    df = case.run(spark, str(folder))
    got = compare.ordered(df.columns, [tuple(r) for r in df.collect()])
    assert compare.difference(got, compare.expected(compare.database(SF_DIR), case.sql)) == ""
