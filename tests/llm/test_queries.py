"""Queries with SQL against DuckDB on the smallest data set."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry_points
from wardline.llm.queries import CASES
from workloads import compare

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", [n for n, c in CASES.items() if c.sql is not None])
def test_query(name, spark):
    df = CASES[name].run(spark, SF_DIR)
    assert compare.nested_loops(df) == []
    got = compare.ordered(df.columns, [tuple(r) for r in df.collect()])
    assert compare.difference(got, compare.expected(compare.database(SF_DIR), CASES[name].sql)) == ""


def test_registered():
    names = entry_points.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 14))
