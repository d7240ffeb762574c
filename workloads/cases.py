"""Named queries with the SQL that another engine runs for comparison."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Case(NamedTuple):
    run: Query
    sql: str | None


CASES: dict[str, Case] = {}


def case(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; ``sql`` is left out where SQL cannot say it on whole tables."""

    def add(run: Query) -> Query:
        CASES[name] = Case(run, sql)
        return run

    return add
