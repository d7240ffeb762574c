"""Queries over the given tables: one per operator, with comparison SQL."""

from __future__ import annotations

from importlib import import_module

from workloads.cases import CASES, Case

_MODULES = ("skills", "graphs", "scores", "locks", "registries", "files")


def all_cases() -> dict[str, Case]:
    for module in _MODULES:
        import_module(f"workloads.{module}")
    return CASES
