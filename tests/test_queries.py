"""Every registered query against its SQL on the smallest data set."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry_points
from workloads import all_cases, compare

SF_DIR = "/root/testdata/sf0.001"
QUERIES = {name: case.run for name, case in all_cases().items()}
ORACLES = {name: case.sql for name, case in all_cases().items() if case.sql is not None}


@pytest.fixture(scope="module")
def db():
    return compare.database(SF_DIR)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(name, spark, db):
    df = QUERIES[name](spark, SF_DIR)
    assert compare.nested_loops(df) == []
    got = compare.ordered(df.columns, [tuple(r) for r in df.collect()])
    if name in ORACLES:
        assert compare.difference(got, compare.expected(db, ORACLES[name])) == ""
    else:
        assert got[1]


def test_every_case_is_registered():
    assert set(QUERIES) <= set(entry_points.queries()) and set(ORACLES) <= set(entry_points.oracle_sql())


def test_entry(spark):
    df = entry_points.entry(spark)
    assert df.columns[:2] == ["seq", "skill_name"]
    assert df.count() > 0
