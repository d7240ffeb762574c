"""Small tables of large texts are dealt out, and only short rows are sorted."""

from __future__ import annotations

import re

import pytest

from wardline.sources.mcp import skills_from_configs
from workloads import all_cases

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["sbom_dependencies", "lock_validate"])
def test_small_tables_are_dealt_out(name, spark):
    plan = all_cases()[name].run(spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert "RoundRobinPartitioning" in plan


def test_servers_are_picked_before_they_are_read(spark):
    rows = [
        (1, "a/mcp.json", '{"mcpServers":{"s":{"command":"one","args":["@o/p"]}}}'),
        (2, "a/claude_desktop_config.json", '{"mcpServers":{"s":{"command":"two"},"t":{"command":"three"}}}'),
    ]
    found = skills_from_configs(spark.createDataFrame(rows, "seq long, path string, content string"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not any("MCP server: " in line for line in plan.splitlines() if re.search(r"Aggregate|Sort ", line))
    winners = {"a/mcp.json", "a/claude_desktop_config.json"}
    got = {(r.name, r.seq) for r in found.where(found.source_path.isin(*winners)).select("name", "seq").collect()}
    assert len(got) == 2 and {n for n, _ in got} == {"s", "t"} and ("t", 2) in got
