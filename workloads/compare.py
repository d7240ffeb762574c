"""Comparison of a query's rows with those of its SQL in DuckDB."""

from __future__ import annotations

import duckdb

from workloads.fixtures import TABLES

PLAIN = {"int", "str", "float", "bool", "NoneType"}
LOOPS = ("CartesianProduct", "BroadcastNestedLoopJoin")


def database(sf_dir: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for table in TABLES:
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return db


def ordered(columns: list[str], rows) -> tuple[list[str], list[tuple]]:
    """Columns by name and rows in a fixed order."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(r[i] for i in order) for r in rows), key=repr)


def expected(db: duckdb.DuckDBPyConnection, sql: str) -> tuple[list[str], list[tuple]]:
    result = db.execute(sql)
    return ordered([d[0] for d in result.description], result.fetchall())


def difference(got: tuple[list[str], list[tuple]], want: tuple[list[str], list[tuple]]) -> str:
    """Empty when both sides agree."""
    kinds = {type(v).__name__ for _, rows in (got, want) for r in rows for v in r} - PLAIN
    if kinds:
        return f"values of type {sorted(kinds)}"
    if got[0] != want[0]:
        return f"columns {got[0]} and {want[0]}"
    if got[1] == want[1]:
        return ""
    left, right = set(got[1]), set(want[1])
    extra, missing = [r for r in got[1] if r not in right][:2], [r for r in want[1] if r not in left][:2]
    return f"{len(got[1])} and {len(want[1])} rows; only left {str(extra)[:500]}; only right {str(missing)[:500]}"


def nested_loops(df) -> list[str]:
    """Names of nested-loop joins in a query's physical plan."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [name for name in LOOPS if name in plan]
