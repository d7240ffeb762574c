"""Writers. Documents become JSON lines in many files, in a stable order.

A single JSON object over a whole corpus would have to pass through one task,
so each writer emits one line per skill, range-partitioned and sorted by its
key: reading the files in name order gives the document's order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.operators.lock import entry_json
from wardline.operators.report import scan_documents
from wardline.operators.sbom import component_json


def _write_lines(rows: DataFrame, key: str, line, path: str) -> None:
    ordered = rows.repartitionByRange(F.col(key)).sortWithinPartitions(key)
    ordered.select(line.alias("value")).write.mode("overwrite").text(path)


def write_lock(lock: DataFrame, path: str) -> None:
    """``{"name": ..., "entry": {...}}`` lines by name."""
    rows = entry_json(lock)
    name = F.substring(F.to_json(F.struct("name")), 2, 1 << 30)
    line = F.concat(F.lit('{"entry":'), F.col("entry"), F.lit(","), name)
    _write_lines(rows, "name", line, path)


def write_sbom(components: DataFrame, path: str) -> None:
    """One ``{"component": ..., "dependency": ...}`` line per component."""
    rows = component_json(components)
    line = F.concat(F.lit('{"component":'), F.col("component"), F.lit(',"dependency":'), F.col("dependency"), F.lit("}"))
    _write_lines(rows, "seq", line, path)


def write_results(results: DataFrame, path: str) -> None:
    """Nested results, one JSON line per skill."""
    rows = scan_documents(results)
    _write_lines(rows, "seq", F.to_json(F.struct("*")), path)


def write_payload(sections: DataFrame, path: str) -> None:
    """Report sections as JSON lines, one folder per section."""
    sections.write.mode("overwrite").partitionBy("section").text(path)
