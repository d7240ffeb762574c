"""What takes parsing is parsed once per text and before rows are dealt over ranges."""

from __future__ import annotations

from wardline.operators import versions
from wardline.plans.stages import Stages


def test_constraints_are_parsed_once_per_text(spark, monkeypatch):
    written = []
    write = Stages.write

    def recorded(self, df):
        table = write(self, df)
        written.append((set(df.columns), table.count()))
        return table

    monkeypatch.setattr(Stages, "write", recorded)
    nodes = spark.createDataFrame([(i, f"n{i % 40}", f"{i % 3}.0.0") for i in range(120)], "seq long, name string, version string")
    edges = spark.createDataFrame(
        [("a", "1.0.0", f"n{i}", c) for i in range(40) for c in (">=1.0.0", "!=1.0.0", None)],
        "name string, version string, dep_name string, raw_constraint string",
    )
    counts = versions.constraint_counts(edges, nodes).collect()
    assert sorted({(r.raw_constraint, r.candidates) for r in counts}) == [("!=1.0.0", 2), (">=1.0.0", 2)] and len(counts) == 80
    assert [n for columns, n in written if "_spans" in columns] == [3]
    assert [n for columns, n in written if "semver" in columns and "key" not in columns and "place" not in columns] == [120]
