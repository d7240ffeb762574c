"""Queries over package versions, dependency graphs and resolution rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.functions import semver
from wardline.operators import graph, resolution, versions
from workloads import fixtures as fx
from workloads import oracle as o
from workloads.cases import case

ALLOWED = ("network:READ", "filesystem:READ")


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.derive(spark, sf_dir, fx.PKG_VERSIONS)
    return rows.withColumn("capabilities", F.array("capability"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.derive(spark, sf_dir, fx.DEP_CONSTRAINTS)


def conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.derive(spark, sf_dir, fx.CONFLICTS)


def requirements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.derive(spark, sf_dir, fx.REQUIREMENTS)


_SEMVER = r"'^(0|[1-9]\d*)\.(0|[1-9]\d*)\.(0|[1-9]\d*)(?:-[0-9A-Za-z\-.]+)?(?:\+[0-9A-Za-z\-.]+)?$'"


def triple(text: str) -> str:
    """Version as a list of three numbers, which compares like a version."""
    return "[" + ", ".join(f"TRY_CAST(regexp_extract({text}, {_SEMVER}, {i}) AS BIGINT)" for i in (1, 2, 3)) + "]"


# Needs CTEs pkgs(name, version, seq) and wants(dep_name, raw_constraint).
MATCHES = rf"""
SELECT w.dep_name, w.raw_constraint, n.version AS dep_version, n.seq AS dep_seq, {triple('n.version')} AS v
FROM (SELECT DISTINCT dep_name, raw_constraint FROM wants) w JOIN pkgs n ON n.name = w.dep_name
WHERE regexp_matches(n.version, {_SEMVER}) AND (w.raw_constraint = '*' OR NOT EXISTS (
  SELECT 1 FROM (SELECT regexp_extract(a, '^(==|!=|>=|<=|>|<|\^|~)', 1) AS op,
      {triple("regexp_replace(a, '^[=!<>^~]+', '')")} AS t FROM (SELECT unnest(str_split(w.raw_constraint, ',')) AS a)) x
  WHERE NOT CASE op WHEN '==' THEN {{v}} = t WHEN '!=' THEN {{v}} <> t WHEN '>=' THEN {{v}} >= t WHEN '<=' THEN {{v}} <= t
    WHEN '>' THEN {{v}} > t WHEN '<' THEN {{v}} < t WHEN '~' THEN {{v}}[1] = t[1] AND {{v}}[2] = t[2] AND {{v}} >= t
    ELSE {{v}}[1] = t[1] AND (t[1] > 0 OR {{v}}[2] = t[2]) AND {{v}} >= t END))
""".replace("{v}", triple("n.version"))

_PKGS = ("pkgs", fx.PKG_VERSIONS)
_EDGES = ("edges", fx.DEP_CONSTRAINTS)
_WANTS = ("wants", "SELECT dep_name, raw_constraint FROM edges")
_MATCHES = ("matches", MATCHES)


def _on_edges(body: str, *more: tuple[str, str]) -> str:
    return o.with_(_PKGS, _EDGES, _WANTS, _MATCHES, *more) + body


@case(
    "semver_parse",
    o.with_(("releases", fx.RELEASES))
    + f"SELECT seq, version, v[1] AS major, v[2] AS minor, v[3] AS patch FROM (SELECT seq, version, {triple('version')} AS v FROM releases)",
)
def semver_parse(spark, sf_dir):
    rows = fx.derive(spark, sf_dir, fx.RELEASES)
    return rows.select("seq", "version", semver.parse_version(F.col("version")).alias("v")).select("seq", "version", "v.*")


@case(
    "version_quarantine",
    o.with_(("releases", fx.RELEASES))
    + f"SELECT seq, name, version FROM releases WHERE NOT regexp_matches(version, {_SEMVER})",
)
def version_quarantine(spark, sf_dir):
    return versions.unreadable(fx.derive(spark, sf_dir, fx.RELEASES)).select("seq", "name", "version")


@case("constraint_match", _on_edges("SELECT dep_name, raw_constraint, dep_version FROM matches"))
def constraint_match(spark, sf_dir):
    found = versions.constraint_matches(edges(spark, sf_dir), nodes(spark, sf_dir))
    return found.select("dep_name", "raw_constraint", "dep_version")


@case(
    "node_upsert",
    o.with_(("releases", fx.RELEASES)) + "SELECT name, version, max(seq) AS seq FROM releases GROUP BY name, version",
)
def node_upsert(spark, sf_dir):
    return versions.latest_nodes(fx.derive(spark, sf_dir, fx.RELEASES)).select("name", "version", "seq")


@case(
    "graph_stats",
    o.with_(_PKGS, _EDGES, ("conflicts", fx.CONFLICTS))
    + "SELECT name, versions, coalesce(d.n, 0) AS dependencies, coalesce(c.n, 0) AS conflicts FROM"
    " (SELECT name, count(DISTINCT version) AS versions FROM pkgs GROUP BY name)"
    " LEFT JOIN (SELECT name, count(*) AS n FROM edges GROUP BY name) d USING (name)"
    " LEFT JOIN (SELECT name, count(*) AS n FROM conflicts GROUP BY name) c USING (name)",
)
def graph_stats(spark, sf_dir):
    return versions.graph_stats(nodes(spark, sf_dir), edges(spark, sf_dir), conflicts(spark, sf_dir))


@case(
    "versions_ranked",
    o.with_(("releases", fx.RELEASES), ("latest", "SELECT name, version, max(seq) AS seq FROM releases GROUP BY name, version"))
    + f"SELECT name, version, row_number() OVER (PARTITION BY name ORDER BY {triple('version')} DESC, seq, version) AS version_rank"
    f" FROM latest WHERE regexp_matches(version, {_SEMVER})",
)
def versions_ranked(spark, sf_dir):
    latest = versions.latest_nodes(fx.derive(spark, sf_dir, fx.RELEASES))
    return versions.ranked(latest).select("name", "version", "version_rank")


@case(
    "edge_resolve_highest",
    _on_edges(
        "SELECT e.name, e.version, e.dep_name, e.raw_constraint, m.dep_version FROM edges e LEFT JOIN"
        " (SELECT dep_name, raw_constraint, dep_version, row_number() OVER (PARTITION BY dep_name, raw_constraint"
        " ORDER BY v DESC, dep_seq, dep_version DESC) AS rn FROM matches) m"
        " ON m.dep_name = e.dep_name AND m.raw_constraint = e.raw_constraint AND m.rn = 1"
    ),
)
def edge_resolve_highest(spark, sf_dir):
    return versions.resolve_highest(edges(spark, sf_dir), nodes(spark, sf_dir))


@case(
    "edge_resolve_all",
    _on_edges(
        "SELECT m.dep_name, m.raw_constraint, m.dep_version, e.n AS edge_count FROM matches m JOIN"
        " (SELECT dep_name, raw_constraint, count(*) AS n FROM edges GROUP BY ALL) e USING (dep_name, raw_constraint)"
    ),
)
def edge_resolve_all(spark, sf_dir):
    return versions.resolve_all(edges(spark, sf_dir), nodes(spark, sf_dir))


# --- reachability -------------------------------------------------------------------

_CLOSURE = (
    "WITH RECURSIVE e AS ({edges}), c(root, node) AS (SELECT src, dst FROM e UNION"
    " SELECT c.root, e.dst FROM c JOIN e ON c.node = e.src) "
)


@case("transitive_deps", _CLOSURE.format(edges=fx.DEP_EDGES) + "SELECT root, node FROM c WHERE root <> node")
def transitive_deps(spark, sf_dir):
    return graph.transitive(fx.derive(spark, sf_dir, fx.DEP_EDGES))


_VERSION_EDGES = (
    "SELECT DISTINCT e.name || '@' || e.version AS src, e.dep_name || '@' || m.dep_version AS dst FROM edges e JOIN"
    " (SELECT dep_name, raw_constraint, dep_version, row_number() OVER (PARTITION BY dep_name, raw_constraint"
    " ORDER BY v DESC, dep_seq, dep_version DESC) AS rn FROM matches) m"
    " ON m.dep_name = e.dep_name AND m.raw_constraint = e.raw_constraint AND m.rn = 1"
)


@case(
    "transitive_versions",
    _on_edges(
        "SELECT root, node FROM c WHERE root <> node",
        ("e", _VERSION_EDGES),
        ("c(root, node)", "SELECT src, dst FROM e UNION SELECT c.root, e.dst FROM c JOIN e ON c.node = e.src"),
    ).replace("WITH ", "WITH RECURSIVE ", 1),
)
def transitive_versions(spark, sf_dir):
    return graph.transitive(versions.version_edges(edges(spark, sf_dir), nodes(spark, sf_dir)))


VULNERABLE = "SELECT p_partkey AS node FROM part WHERE p_size = 1 OR p_partkey = 3"


@case(
    "vuln_propagate",
    f"WITH RECURSIVE bad AS ({VULNERABLE}), e AS ({fx.DEP_EDGES}),"
    " c(node, cause) AS (SELECT e.src, e.dst FROM e JOIN bad ON e.dst = bad.node WHERE e.src NOT IN (SELECT node FROM bad)"
    " UNION SELECT e.src, c.cause FROM c JOIN e ON e.dst = c.node WHERE e.src NOT IN (SELECT node FROM bad))"
    " SELECT node, cause FROM c",
)
def vuln_propagate(spark, sf_dir):
    bad = fx.derive(spark, sf_dir, VULNERABLE)
    return graph.affected(fx.derive(spark, sf_dir, fx.DEP_EDGES), bad)


@case(
    "vuln_propagate_versions",
    _on_edges(
        "SELECT node, cause FROM c",
        ("bad", "SELECT name || '@' || version AS node FROM pkgs WHERE size = 1"),
        (
            "e",
            "SELECT DISTINCT e.name || '@' || e.version AS src, m.dep_name || '@' || m.dep_version AS dst"
            " FROM edges e JOIN matches m USING (dep_name, raw_constraint)",
        ),
        (
            "c(node, cause)",
            "SELECT e.src, e.dst FROM e JOIN bad ON e.dst = bad.node WHERE e.src NOT IN (SELECT node FROM bad)"
            " UNION SELECT e.src, c.cause FROM c JOIN e ON e.dst = c.node WHERE e.src NOT IN (SELECT node FROM bad)",
        ),
    ).replace("WITH ", "WITH RECURSIVE ", 1),
)
def vuln_propagate_versions(spark, sf_dir):
    packages, needs = nodes(spark, sf_dir), edges(spark, sf_dir)
    matches = versions.constraint_matches(needs, packages).withColumn(
        "dep_node", versions.package_id("dep_name", "dep_version")
    )
    named = needs.withColumn("node", versions.package_id("name", "version"))
    bad = packages.where("size = 1").select(versions.package_id("name", "version"))
    return graph.affected_versions(named, matches, bad)


_CYCLIC = f"SELECT src, dst FROM ({fx.DEP_EDGES}) AS a UNION SELECT src, dst FROM ({fx.CYCLE_EDGES}) AS b"


@case(
    "cycle_nodes",
    _CLOSURE.format(edges=_CYCLIC)
    + "SELECT a.root AS node, min(a.node) AS cycle FROM c a JOIN c b ON a.root = b.node AND a.node = b.root GROUP BY a.root",
)
def cycle_nodes(spark, sf_dir):
    links = fx.derive(spark, sf_dir, fx.DEP_EDGES).union(fx.derive(spark, sf_dir, fx.CYCLE_EDGES))
    return graph.cycle_groups(links)


# --- resolution ---------------------------------------------------------------------


@case(
    "rule_at_most_one",
    o.with_(_PKGS)
    + "SELECT a.name, count(DISTINCT a.version) AS candidates, count(b.version) AS excluded_pairs FROM pkgs a LEFT JOIN pkgs b"
    " ON a.name = b.name AND a.seq < b.seq GROUP BY a.name",
)
def rule_at_most_one(spark, sf_dir):
    return resolution.at_most_one(nodes(spark, sf_dir))


_REQS = ("reqs", fx.REQUIREMENTS)
_ROOT_WANTS = ("wants", "SELECT name AS dep_name, raw_constraint FROM reqs")
_ROOTS = (
    "SELECT r.name, r.raw_constraint, count(m.dep_version) AS candidates, count(m.dep_version) = 0 AS unsatisfiable"
    " FROM reqs r LEFT JOIN {matches} m ON m.dep_name = r.name AND m.raw_constraint = r.raw_constraint"
    " GROUP BY r.name, r.raw_constraint"
)


@case("rule_roots", o.with_(_PKGS, _REQS, _ROOT_WANTS, _MATCHES) + _ROOTS.format(matches="matches"))
def rule_roots(spark, sf_dir):
    return resolution.root_rules(requirements(spark, sf_dir), nodes(spark, sf_dir))


_DEPENDENCY = (
    "SELECT e.name, e.version, e.dep_name, e.raw_constraint, count(m.dep_version) AS candidates,"
    " count(m.dep_version) = 0 AS impossible FROM edges e LEFT JOIN matches m USING (dep_name, raw_constraint)"
    " GROUP BY e.name, e.version, e.dep_name, e.raw_constraint"
)


@case("rule_dependencies", _on_edges(_DEPENDENCY))
def rule_dependencies(spark, sf_dir):
    return resolution.dependency_rules(edges(spark, sf_dir), nodes(spark, sf_dir))


_CONFLICTS = ("conflicts", fx.CONFLICTS)
_CONFLICT_WANTS = ("wants", "SELECT dep_name, raw_constraint FROM conflicts")


@case(
    "rule_conflicts",
    o.with_(_PKGS, _CONFLICTS, _CONFLICT_WANTS, _MATCHES)
    + "SELECT m.dep_name, m.raw_constraint, m.dep_version AS excluded_version, c.n AS holders FROM matches m JOIN"
    " (SELECT dep_name, raw_constraint, count(*) AS n FROM conflicts GROUP BY ALL) c USING (dep_name, raw_constraint)",
)
def rule_conflicts(spark, sf_dir):
    return resolution.conflict_rules(conflicts(spark, sf_dir), nodes(spark, sf_dir))


@case(
    "conflict_pairs",
    o.with_(_PKGS, _CONFLICTS, _CONFLICT_WANTS, _MATCHES)
    + "SELECT DISTINCT c.name, c.version, m.dep_name, m.dep_version AS excluded_version FROM conflicts c JOIN matches m"
    " USING (dep_name, raw_constraint) WHERE NOT (c.name = m.dep_name AND c.version = m.dep_version)",
)
def conflict_pairs(spark, sf_dir):
    return resolution.conflict_pairs(conflicts(spark, sf_dir), nodes(spark, sf_dir))


@case(
    "rule_capabilities",
    o.with_(_PKGS)
    + "SELECT name, version, capability AS not_allowed FROM pkgs WHERE capability NOT IN ('network:READ', 'filesystem:READ')",
)
def rule_capabilities(spark, sf_dir):
    found = resolution.capability_rules(nodes(spark, sf_dir), ALLOWED)
    return found.withColumn("not_allowed", F.array_join("not_allowed", "|"))


_ALL_WANTS = (
    "wants",
    "SELECT dep_name, raw_constraint FROM edges UNION ALL SELECT dep_name, raw_constraint FROM conflicts"
    " UNION ALL SELECT name, raw_constraint FROM reqs",
)


def _on_all(body: str, *more: tuple[str, str]) -> str:
    return o.with_(_PKGS, _EDGES, _CONFLICTS, _REQS, _ALL_WANTS, _MATCHES, *more) + body


# Every version of a name, newest first.
_LISTED = (
    "SELECT name, string_agg(version, ', ' ORDER BY readable DESC, v[1] DESC NULLS FIRST, v[2] DESC NULLS FIRST,"
    " v[3] DESC NULLS FIRST, seq NULLS FIRST, version) AS available"
    f" FROM (SELECT name, version, min(seq) AS seq, regexp_matches(version, {_SEMVER}) AS readable, {triple('version')} AS v"
    " FROM pkgs GROUP BY name, version) GROUP BY name"
)
_REASONS = (
    "SELECT 'missing' AS reason, 'Skill ''' || name || ''' is not available in the graph' AS message FROM roots"
    " WHERE unsatisfiable AND name NOT IN (SELECT name FROM pkgs)"
    " UNION ALL SELECT 'no_version', 'No version of ''' || name || ''' satisfies constraint ''' || raw_constraint"
    " || ''' (available: ' || available || ')' FROM roots JOIN listed USING (name) WHERE unsatisfiable"
    " UNION ALL SELECT 'dead_end', name || '@' || version || ' requires ' || dep_name || ' ''' || raw_constraint"
    " || ''' but no satisfying version exists' FROM deps WHERE impossible"
    " UNION ALL SELECT 'conflict', name || '@' || version || ' conflicts with required skill ''' || dep_name || ''''"
    " FROM conflicts WHERE name IN (SELECT name FROM reqs) AND dep_name IN (SELECT name FROM reqs)"
)


@case(
    "resolve_diagnose",
    _on_all(
        "SELECT reason, message FROM reasons UNION ALL SELECT 'general', 'Resolution failed: no satisfying assignment exists"
        " (constraint system is unsatisfiable)' WHERE NOT EXISTS (SELECT 1 FROM reasons)",
        ("roots", _ROOTS.format(matches="matches")),
        ("deps", _DEPENDENCY),
        ("listed", _LISTED),
        ("reasons", _REASONS),
    ),
)
def resolve_diagnose(spark, sf_dir):
    inputs = [f(spark, sf_dir) for f in (requirements, nodes, edges, conflicts)]
    return resolution.diagnose(*inputs)


@case(
    "assignment_verify",
    _on_all(
        "SELECT 'requirement' AS rule, r.name, coalesce(g.version, '') AS version, r.raw_constraint AS detail FROM reqs r"
        " LEFT JOIN guess g USING (name) WHERE NOT EXISTS (SELECT 1 FROM matches m WHERE m.dep_name = r.name"
        " AND m.raw_constraint = r.raw_constraint AND m.dep_version = g.version)"
        " UNION ALL SELECT 'dependency', e.name, e.version, e.dep_name || ' ' || e.raw_constraint FROM edges e"
        " JOIN guess s ON s.name = e.name AND s.version = e.version LEFT JOIN guess g ON g.name = e.dep_name"
        " WHERE NOT EXISTS (SELECT 1 FROM matches m WHERE m.dep_name = e.dep_name"
        " AND m.raw_constraint = e.raw_constraint AND m.dep_version = g.version)"
        " UNION ALL SELECT 'conflict', c.name, c.version, c.dep_name || ' ' || c.raw_constraint FROM conflicts c"
        " JOIN guess s ON s.name = c.name AND s.version = c.version JOIN guess g ON g.name = c.dep_name"
        " JOIN matches m ON m.dep_name = c.dep_name AND m.raw_constraint = c.raw_constraint AND m.dep_version = g.version"
        " UNION ALL SELECT 'capability', p.name, p.version, p.capability FROM pkgs p JOIN guess g"
        " ON g.name = p.name AND g.version = p.version WHERE p.capability NOT IN ('network:READ', 'filesystem:READ')",
        ("guess", f"SELECT name, arg_max(version, row({triple('version')}, version)) AS version FROM pkgs GROUP BY name"),
    ),
)
def assignment_verify(spark, sf_dir):
    """Check the assignment that takes the newest version of everything."""
    packages = nodes(spark, sf_dir)
    newest = versions.with_semver(packages).groupBy("name").agg(F.max_by("version", F.struct("semver", "version")).alias("version"))
    return resolution.verify_assignment(
        newest, packages, edges(spark, sf_dir), conflicts(spark, sf_dir), requirements(spark, sf_dir), ALLOWED
    )


def _prune_rounds(rounds: int) -> str:
    """Removal unrolled: round k keeps versions whose every dependency has a survivor of round k-1."""
    parts = [("alive0", "SELECT DISTINCT name, version FROM pkgs WHERE capability <> 'shell:WRITE'")]
    for k in range(1, rounds + 1):
        parts.append(
            (
                f"alive{k}",
                f"SELECT name, version FROM alive{k - 1} a WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.name = a.name"
                " AND e.version = a.version AND NOT EXISTS (SELECT 1 FROM matches m JOIN alive"
                f"{k - 1} t ON t.name = m.dep_name AND t.version = m.dep_version"
                " WHERE m.dep_name = e.dep_name AND m.raw_constraint = e.raw_constraint))",
            )
        )
    return _on_edges(f"SELECT name, version FROM alive{rounds}", *parts)


@case("candidate_prune", _prune_rounds(12))
def candidate_prune(spark, sf_dir):
    return resolution.prune(nodes(spark, sf_dir), edges(spark, sf_dir), ("network:READ", "filesystem:READ"))
