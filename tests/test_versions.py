"""Version order and constraints against a plain reading of the rules."""

from __future__ import annotations

import itertools

import duckdb
import pytest
from pyspark.sql import functions as F

from wardline.functions import semver
from wardline.operators import resolution, versions
from workloads import all_cases, compare

VERSIONS = ["0.0.1", "0.2.0", "0.2.9", "0.3.0", "1.0.0", "1.2.3", "1.10.0", "2.0.0", "10.0.1", "1.0.0-rc.1", "1.0.0+b"]
BROKEN = ["1.0", "01.0.0", "v1.0.0", "", "latest", "1.0.0.0"]
CONSTRAINTS = ["*", "", "==1.0.0", "!=1.0.0", ">=1.2.3", "<=0.2.9", ">1.2.3", "<1.0.0", "^0.2.0", "^1.2.0", "~1.2.0", " >=0.2.0 , <2.0.0 ", "^0.0.1"]


def triple(version):
    return tuple(int(p) for p in version.split("-")[0].split("+")[0].split("."))


def holds(version, constraint):
    text = constraint.strip()
    if text == "*":
        return True
    v = triple(version)
    for atom in (a.strip() for a in text.split(",") if a.strip()):
        op = next(o for o in ("==", "!=", ">=", "<=", ">", "<", "^", "~") if atom.startswith(o))
        t = triple(atom[len(op) :].strip())
        span = {"^": v[0] == t[0] and (t[0] > 0 or v[1] == t[1]) and v >= t, "~": v[:2] == t[:2] and v >= t}
        plain = {"==": v == t, "!=": v != t, ">=": v >= t, "<=": v <= t, ">": v > t, "<": v < t}
        if not {**span, **plain}[op]:
            return False
    return True


def test_constraints(spark):
    pairs = list(itertools.product(VERSIONS, CONSTRAINTS))
    df = spark.createDataFrame(pairs, "v string, c string")
    fits = semver.satisfies(semver.parse_version(F.col("v")), semver.parse_constraint(F.col("c")))
    got = {(r.v, r.c): r.fits for r in df.select("v", "c", fits.alias("fits")).collect()}
    assert got == {(v, c): holds(v, c) for v, c in pairs}


def test_broken_versions_and_constraints(spark):
    df = spark.createDataFrame([(v,) for v in BROKEN], "v string")
    assert {r[0] for r in df.select(semver.parse_version(F.col("v"))).collect()} == {None}
    one = spark.createDataFrame([("1.0.0", "=>1"), ("1.0.0", "1.0.0"), ("bad", "*"), ("bad", ">=1.0.0")], "v string, c string")
    fits = semver.satisfies(semver.parse_version(F.col("v")), semver.parse_constraint(F.col("c")))
    assert [r[0] for r in one.select(fits).collect()] == [False, False, True, False]


def test_rank_of_one_hot_name(spark):
    """All rows share a name; ties keep input order."""
    rows = [(i, "hot", f"{i % 3}.{i % 7}.{i % 11}", i) for i in range(400)]
    nodes = spark.createDataFrame(rows, "seq long, name string, version string, x int")
    got = {r.seq: r.version_rank for r in versions.ranked(nodes).collect()}
    order = sorted(rows, key=lambda r: tuple(-p for p in triple(r[2])) + (r[0],))
    assert got == {r[0]: i + 1 for i, r in enumerate(order)}


def test_hot_name_is_split_without_losing_matches(spark):
    nodes = spark.createDataFrame([(i, "hot", v) for i, v in enumerate(VERSIONS)] + [(99, "cold", "1.0.0")], "seq int, name string, version string")
    rows = [("x", "1.0.0", n, c) for n in ("hot", "cold") for c in CONSTRAINTS]
    edges = spark.createDataFrame(rows, "name string, version string, dep_name string, raw_constraint string")
    want = {("hot", c, v) for c in CONSTRAINTS for v in VERSIONS if holds(v, c)}
    want |= {("cold", c, "1.0.0") for c in CONSTRAINTS if holds("1.0.0", c)}
    for pairs_per_task in (10, 10_000):
        got = versions.constraint_matches(edges, nodes, pairs_per_task).select("dep_name", "raw_constraint", "dep_version").collect()
        assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_last_row_of_a_version_wins(spark):
    nodes = spark.createDataFrame([(1, "a", "1.0.0", "old"), (5, "a", "1.0.0", "new"), (2, "b", "1.0.0", "x")], "seq int, name string, version string, note string")
    assert {(r.name, r.note) for r in versions.latest_nodes(nodes).collect()} == {("a", "new"), ("b", "x")}


def test_general_diagnosis_only_without_reasons(spark):
    nodes = spark.createDataFrame([(1, "a", "1.0.0")], "seq int, name string, version string")
    none = spark.createDataFrame([], "name string, version string, dep_name string, raw_constraint string")
    fine = spark.createDataFrame([("a", "*")], "name string, raw_constraint string")
    broken = spark.createDataFrame([("b", "*")], "name string, raw_constraint string")
    assert [r.reason for r in resolution.diagnose(fine, nodes, none, none).collect()] == ["general"]
    assert [r.reason for r in resolution.diagnose(broken, nodes, none, none).collect()] == ["missing"]


def test_diagnosis_lists_every_version_newest_first(spark):
    own = ["1.9.0", "bad", "0.9.0", "1.10.0", "1.10.0-rc", "1.9.0", "99999999999999999999.0.0", "10.0.0"]
    nodes = spark.createDataFrame([(i, "a", v) for i, v in enumerate(own)] + [(50, "b", "1.0.0"), (51, "only", "bad")], "seq int, name string, version string")
    none = spark.createDataFrame([], "name string, version string, dep_name string, raw_constraint string")
    wants = [("a", "==9.9.9"), ("b", "^1.0.0"), ("only", "*"), ("c", "*"), ("a", "~3.0.0")]
    asked = spark.createDataFrame(wants, "name string, raw_constraint string")
    newest_first = "99999999999999999999.0.0, 10.0.0, 1.10.0, 1.10.0-rc, 1.9.0, 0.9.0, bad"
    assert sorted(r.message for r in resolution.diagnose(asked, nodes, none, none).collect()) == [
        f"No version of 'a' satisfies constraint '==9.9.9' (available: {newest_first})",
        f"No version of 'a' satisfies constraint '~3.0.0' (available: {newest_first})",
        "No version of 'only' satisfies constraint '*' (available: bad)",
        "Skill 'c' is not available in the graph",
    ]


@pytest.mark.parametrize("keys", [0, 400])
def test_diagnosis_agrees_with_its_sql_on_repeated_and_null_parts(spark, tmp_path, keys):
    """Packages of several versions of a major and unreadable ones; no part leaves the general line alone."""
    rows = [(i % 97 if i % 31 else None, i * 7 % 50 if i % 17 else None) for i in range(keys)]
    spark.createDataFrame(rows, "p_partkey long, p_size int").coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    case = all_cases()["resolve_diagnose"]
    df = case.run(spark, str(tmp_path))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    want = compare.expected(db, case.sql)
    assert compare.difference(compare.ordered(df.columns, [tuple(r) for r in df.collect()]), want) == ""
    if keys:
        assert any("'pkg-' " in m and "(available: .., .0., " in m for m, _ in want[1])
    else:
        assert [reason for _, reason in want[1]] == ["general"]


def test_valid_assignment_breaks_nothing(spark):
    nodes = spark.createDataFrame([(1, "a", "1.0.0"), (2, "b", "2.0.0"), (3, "b", "1.0.0")], "seq int, name string, version string")
    edges = spark.createDataFrame([("a", "1.0.0", "b", "<2.0.0")], "name string, version string, dep_name string, raw_constraint string")
    none = edges.limit(0)
    wants = spark.createDataFrame([("a", "*")], "name string, raw_constraint string")

    def broken(*chosen):
        picked = spark.createDataFrame(chosen, "name string, version string")
        return sorted(r.rule for r in resolution.verify_assignment(picked, nodes, edges, none, wants).collect())

    assert broken(("a", "1.0.0"), ("b", "1.0.0")) == []
    assert broken(("a", "1.0.0"), ("b", "2.0.0")) == ["dependency"]
    assert broken(("b", "1.0.0"), ("b", "2.0.0")) == ["at_most_one", "requirement"]
    assert broken(("a", "9.0.0")) == ["requirement", "unknown_version"] or broken(("a", "9.0.0")) == ["unknown_version"]


@pytest.mark.parametrize("asked, offered", [(1, 3000), (60, 50), (300, 1)])
def test_hot_names_are_split_on_both_sides(spark, asked, offered):
    edges = spark.range(asked).selectExpr("'a' AS name", "'1' AS version", "'hot' AS dep_name", "concat('>=', id, '.0.0') AS raw_constraint")
    nodes = spark.range(offered).selectExpr("id AS seq", "'hot' AS name", "concat(id, '.0.0') AS version")
    got = versions.constraint_matches(edges, nodes, pairs_per_task=100)
    assert got.count() == sum(max(0, offered - a) for a in range(asked))
    assert got.select("raw_constraint", "dep_version").distinct().count() == got.count()


def test_one_name_with_all_versions_is_ranked_over_ranges(spark):
    nodes = spark.range(20_000).selectExpr("id % 7 AS seq", "'hot' AS name", "concat('0.0.', id) AS version")
    rows = versions.ranked(nodes).collect()
    assert sorted(r.version_rank for r in rows) == list(range(1, 20_001))
    assert all(r.version == f"0.0.{20_000 - r.version_rank}" for r in rows)


def test_stretches_agree_with_the_rules_on_every_version(spark):
    texts = [*CONSTRAINTS, ">1.0.0,<1.0.0", "!=1.0.0,!=1.2.3", "!=1.0.0,==1.0.0", ">=1.0.0,!=1.0.0,!=9.9.9,<2.0.0", "==1.0.0,", "=>1", "^1.2.0,~1.2.0"]
    own = [*VERSIONS, "1.2.4", "0.0.2", "1.0.1", "9223372036854775807.0.0", "99999999999999999999.0.0", *BROKEN]
    df = spark.createDataFrame([(v, c) for v in own for c in texts], "v string, c string")
    v, c = semver.parse_version(F.col("v")), semver.parse_constraint(F.col("c"))
    inside = F.exists(semver.spans(c), lambda s: (s["low"] <= semver.sort_key(v)) & (semver.sort_key(v) < s["high"]))
    rows = df.where(v.isNotNull()).select("v", "c", semver.satisfies(v, c).alias("want"), inside.alias("got")).collect()
    assert [r for r in rows if r.want != r.got] == [] and len({r.want for r in rows}) == 2


def test_matching_sorts_versions_and_ends_instead_of_comparing_them(spark):
    """100,000 versions of one name against 500 constraints: 50 million pairs that are never made."""
    n, asked = 100_000, 500
    nodes = spark.range(n).selectExpr("id AS seq", "'hot' AS name", "concat(id div 1000, '.', id % 1000 div 10, '.', id % 10) AS version")
    edges = spark.range(asked).selectExpr(
        "'a' AS name", "cast(id AS string) AS version", "'hot' AS dep_name",
        "concat('>=', id % 100, '.', id, '.0,<', id % 100, '.', id + 2, '.0,!=', id % 100, '.', id, '.5') AS raw_constraint",
    )
    placed, stretches = versions.placed_spans(edges, nodes)
    assert placed.count() == n and stretches.count() == 200  # only minors below 100 exist, each stretch in two
    matched = versions.constraint_matches(edges, nodes)
    assert matched.count() == sum(9 + (10 if m < 99 else 0) for m in range(100))
    plan = matched._jdf.queryExecution().executedPlan().toString()
    assert "Join [dep_name" in plan and "NestedLoop" not in plan
    highest = {r.version: r.dep_version for r in versions.resolve_highest(edges, nodes).collect()}
    assert all(highest[str(m)] == f"{m}.{min(m + 1, 99)}.9" for m in range(100))
    assert all(highest[str(m)] is None for m in range(100, asked))
    rules = resolution.dependency_rules(edges, nodes)
    assert rules.where("impossible").count() == 400 and rules.agg(F.max("candidates")).first()[0] == 19


def test_best_of_equal_versions_and_repeated_rows(spark):
    rows = [(3, "a", "1.0.0+x"), (1, "a", "1.0.0"), (1, "a", "1.0.0-rc"), (1, "a", "1.0.0"), (9, "a", "bad"), (0, None, "2.0.0")]
    nodes = spark.createDataFrame(rows, "seq int, name string, version string")
    wants = [("x", "1", "a", "*"), ("x", "1", "a", "^1.0.0"), ("x", "1", "a", None), ("x", "1", None, "*"), ("x", "1", "z", "*")]
    edges = spark.createDataFrame(wants, "name string, version string, dep_name string, raw_constraint string")
    got = versions.resolve_highest(edges, nodes).select("dep_name", "raw_constraint", "dep_version").collect()
    best = "1.0.0-rc"  # of equal versions the earliest input, then the last text
    want = {("a", "*", best), ("a", "^1.0.0", best), ("a", None, None), (None, "*", None), ("z", "*", None)}
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert versions.constraint_matches(edges, nodes).count() == 8


def test_pruning_moves_only_the_newly_dead(spark, monkeypatch):
    """A chain that dies from its far end, beside names that stay: each round writes what it kills."""
    length = 6
    nodes = spark.createDataFrame(
        [(i, f"n{i}", "1.0.0", ["a"]) for i in range(length)] + [(100 + i, f"fine{i}", "1.0.0", ["a"]) for i in range(50)]
        + [(200, "choice", "1.0.0", ["a"]), (201, "choice", "2.0.0", ["b"])],
        "seq int, name string, version string, capabilities array<string>",
    )
    rows = [(f"n{i}", "1.0.0", f"n{i + 1}", "*") for i in range(length - 1)] + [(f"n{length - 1}", "1.0.0", "absent", "*")]
    rows += [(f"fine{i}", "1.0.0", f"fine{i + 1}", "^1.0.0") for i in range(49)] + [("fine49", "1.0.0", "choice", "*"), ("n0", "1.0.0", None, "*")]
    edges = spark.createDataFrame(rows, "name string, version string, dep_name string, raw_constraint string")
    written = []
    append = resolution.Stages.append

    def counted(self, df, table, measure=None):
        rows, count = append(self, df, table, measure)
        written.append((table, count))
        return rows, count

    monkeypatch.setattr(resolution.Stages, "append", counted)
    kept = {tuple(r) for r in resolution.prune(nodes, edges).collect()}
    assert kept == {(f"fine{i}", "1.0.0") for i in range(50)} | {("choice", "1.0.0"), ("choice", "2.0.0")}
    dead = [n for table, n in written if table == "dead"]
    assert sum(dead) == length and max(dead) <= 2 and dead[-1] == 0
    assert all(n <= 2 for n in [n for table, n in written if table == "support"][1:])
    only_a = {tuple(r) for r in resolution.prune(nodes, edges, ["a"]).collect()}
    assert only_a == kept - {("choice", "2.0.0")}
