"""Time the headline queries and print one JSON line.

Reads BENCH_SF_DIR (default the 0.1 data set) on BENCH_CPUS local cores. Each
query is planned and run to completion into a no-op sink, once to warm up and
once on the clock.
"""

from __future__ import annotations

import json
import os
import sys
import time

from wardline.session import local_session
from workloads import all_cases

QUERIES = (
    "scan_findings",
    "exec_summary",
    "cap_violations",
    "framework_definitions",
    "src_workflow_nodes",
    "registry_scan_mcp",
    "edge_resolve_highest",
    "versions_ranked",
    "trust_chain",
    "lock_diff",
    "lock_build",
    "sbom_summary",
    "fleet_inventory",
    "transitive_deps",
    "vuln_propagate",
    "trust_dag",
    "cycle_nodes",
)


def run(query, spark, sf_dir: str) -> float:
    start = time.perf_counter()
    query(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    cases = all_cases()
    timings = {}
    for name in sys.argv[1:] or QUERIES:
        run(cases[name].run, spark, sf_dir)
        timings[name] = round(run(cases[name].run, spark, sf_dir), 3)
    skills = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    scan = timings.get("scan_findings")
    line = {
        "metric": "headline queries, total",
        "value": round(sum(timings.values()), 3),
        "unit": "sec",
        "queries": timings,
        "sf": os.path.basename(sf_dir).removeprefix("sf"),
        "skills_per_sec": round(skills / scan, 1) if scan else None,
    }
    print(json.dumps(line))
    spark.stop()


if __name__ == "__main__":
    main()
