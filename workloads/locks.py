"""Queries over lock tables and bills of materials."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.operators import lock, sbom, scan, trust, versions
from wardline.sources.lockfiles import lock_entries, lock_metadata
from wardline.sources.mcp import skills_from_configs
from workloads import fixtures as fx
from workloads import graphs, scores, skills
from workloads import oracle as o
from workloads.cases import case


def _lock(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    rows = fx.derive(spark, sf_dir, fx.spark_sql(sql))
    return rows.withColumn("capabilities", F.array("capability"))


_OLD, _NEW = ("old", fx.duck_sql(fx.LOCK_OLD)), ("new", fx.duck_sql(fx.LOCK_NEW))
_FIELD = (
    "SELECT name, 'changed' AS change, '{0}' AS field, CAST(old.{1} AS VARCHAR) AS old_value,"
    " CAST(new.{1} AS VARCHAR) AS new_value FROM old JOIN new USING (name) WHERE old.{1} IS DISTINCT FROM new.{1}"
)


@case(
    "lock_diff",
    o.with_(_OLD, _NEW)
    + "SELECT name, 'added' AS change, '' AS field, NULL AS old_value, NULL AS new_value FROM new ANTI JOIN old USING (name)"
    " UNION ALL SELECT name, 'removed', '', NULL, NULL FROM old ANTI JOIN new USING (name) UNION ALL "
    + " UNION ALL ".join(
        _FIELD.format(f, c)
        for f, c in (
            ("version", "version"),
            ("integrity", "integrity"),
            ("capabilities", "capability"),
            ("trust_score", "trust_score"),
        )
    ),
)
def lock_diff(spark, sf_dir):
    return lock.diff(_lock(spark, sf_dir, fx.LOCK_OLD), _lock(spark, sf_dir, fx.LOCK_NEW))


@case(
    "integrity_verify",
    o.with_(_OLD)
    + "SELECT d.name, coalesce(old.integrity = 'sha256:' || sha256(d.content), false) AS intact FROM"
    " (SELECT 'skill-' || doc_id AS name, CASE lang WHEN 'de' THEN text || '!' ELSE text END AS content FROM documents) d"
    " LEFT JOIN old USING (name)",
)
def integrity_verify(spark, sf_dir):
    contents = fx.derive(
        spark,
        sf_dir,
        "SELECT concat('skill-', doc_id) AS name, CASE lang WHEN 'de' THEN concat(text, '!') ELSE text END AS content FROM documents",
    )
    return lock.verify_integrity(_lock(spark, sf_dir, fx.LOCK_OLD), fx.spread(contents))


@case("lock_names", o.with_(("whole", fx.duck_sql(fx.LOCK_ALL))) + "SELECT name FROM whole")
def lock_names(spark, sf_dir):
    return _lock(spark, sf_dir, fx.LOCK_ALL).select("name").orderBy("name")


_CHECKED = ("checked", fx.duck_sql(fx.LOCK_CHECKED))


@case(
    "lock_validate",
    o.with_(
        _CHECKED,
        ("deps", "SELECT name, below AS dep FROM checked UNION SELECT name, above FROM checked WHERE above <> ''"),
        ("inside", "SELECT * FROM deps WHERE dep IN (SELECT name FROM checked)"),
        ("c(root, node)", "SELECT name, dep FROM inside UNION SELECT c.root, i.dep FROM c JOIN inside i ON c.node = i.name"),
    ).replace("WITH ", "WITH RECURSIVE ", 1)
    + "SELECT 'missing_dependency' AS \"check\", name, dep AS detail FROM deps WHERE dep NOT IN (SELECT name FROM checked)"
    " UNION ALL SELECT 'cycle', a.root, min(a.node) FROM c a JOIN c b ON a.root = b.node AND a.node = b.root GROUP BY a.root"
    " UNION ALL SELECT 'integrity_format', name, integrity FROM checked WHERE integrity = 'md5:abc'"
    " UNION ALL SELECT 'empty_version', name, '' FROM checked WHERE version = ''"
    " UNION ALL SELECT 'total_skills', '', CAST(count(*) AS VARCHAR) FROM checked HAVING count(*) <> 1",
)
def lock_validate(spark, sf_dir):
    rows = fx.derive(spark, sf_dir, fx.spark_sql(fx.LOCK_CHECKED), dealt=True)
    none = F.create_map().cast("map<string,string>")
    deps = F.map_concat(
        F.create_map("below", F.lit("*")),
        F.when((F.col("above") != "") & (F.col("above") != F.col("below")), F.create_map("above", F.lit("*"))).otherwise(none),
    )
    return lock.validate(rows.withColumn("dependencies", deps), total_skills=1)


@case(
    "lock_read",
    "SELECT p_partkey AS seq, 'a-' || p_partkey AS name, '1.' || p_size || '.0' AS version, 'sha256:00' AS integrity, '' AS format,"
    " 'network:READ|shell:WRITE' AS capabilities, 'b-' || p_partkey || '=2.0.0' AS dependencies,"
    " (p_size % 10) / 10.0 AS trust_score, 'SIGNED' AS trust_level FROM part UNION ALL"
    " SELECT p_partkey, 'b-' || p_partkey, '2.0.0', '', 'mcp', '', '', NULL, NULL FROM part",
)
def lock_read(spark, sf_dir):
    rows = lock_entries(fx.derive(spark, sf_dir, fx.LOCK_DOCUMENTS))
    return _flat(rows.drop("source_path"))


def _flat(rows: DataFrame) -> DataFrame:
    pairs = F.transform(F.array_sort(F.map_entries("dependencies")), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return rows.withColumns({"capabilities": F.array_join("capabilities", "|"), "dependencies": F.array_join(pairs, "|")})


@case(
    "lock_header",
    "SELECT p_partkey AS seq, CASE WHEN p_size > 25 THEN 3 ELSE 2 END AS total_skills, 'sat' AS resolution_strategy FROM part",
)
def lock_header(spark, sf_dir):
    return lock_metadata(fx.derive(spark, sf_dir, fx.LOCK_DOCUMENTS)).select("seq", "total_skills", "resolution_strategy")


@case(
    "lock_build",
    o.scan(
        "SELECT format AS name, version, integrity, caps AS capabilities FROM (SELECT r.format, r.version,"
        " 'sha256:' || sha256(r.raw_content) AS integrity, row_number() OVER (PARTITION BY r.format ORDER BY r.seq DESC) AS rn,"
        " array_to_string(list_concat(list_distinct_declared, list_filter(coalesce(i.caps, []), lambda c:"
        " NOT list_contains(list_distinct_declared, c))), '|') AS caps FROM"
        " (SELECT *, declared_capabilities AS list_distinct_declared FROM results) r LEFT JOIN"
        f" (SELECT seq, list(resource || ':' || {o.LEVEL_NAME.format('access')} ORDER BY"
        " list_position(['network','shell','environment','filesystem'], resource)) AS caps FROM inferred GROUP BY seq) i USING (seq))"
        " WHERE rn = 1"
    ),
)
def lock_build(spark, sf_dir):
    """Locks keyed by source, so that many skills share each name and the last one wins."""
    rows = skills.results(spark, sf_dir).withColumn("name", F.col("format"))
    built = lock.build(rows)
    return built.select("name", "version", "integrity", F.array_join("capabilities", "|").alias("capabilities"))


def _resolved(spark, sf_dir):
    packages = graphs.nodes(spark, sf_dir)
    installed = versions.with_semver(packages).groupBy("name").agg(F.max_by("version", F.struct("semver", "version")).alias("version"))
    texts = fx.derive(
        spark,
        sf_dir,
        "SELECT doc_id AS seq, concat('pkg-', doc_id) AS name, source AS format, concat(doc_id, '.md') AS source_path, text AS raw_content FROM documents",
    )
    known = scores.scored(spark, sf_dir).select(
        F.concat(F.lit("pkg-"), F.col("node")).alias("name"), F.round("intrinsic", 4).alias("trust_score")
    )
    return lock.from_resolution(installed, packages, graphs.edges(spark, sf_dir), texts, known)


_RESOLVED = (
    ("pkgs", fx.PKG_VERSIONS),
    ("edges", fx.DEP_CONSTRAINTS),
    ("signals", fx.PART_SIGNALS),
    ("guess", f"SELECT name, arg_max(version, row({graphs.triple('version')}, version)) AS version FROM pkgs GROUP BY name"),
    ("scored", f"SELECT 'pkg-' || node AS name, round({scores._OWN}, 4) AS trust_score FROM signals"),
    (
        "resolved",
        "SELECT g.name, g.version, coalesce('sha256:' || sha256(d.text), '') AS integrity, coalesce(d.source, '') AS format,"
        " p.capability AS capabilities, coalesce(e.deps, '') AS dependencies, s.trust_score,"
        f" CASE WHEN s.trust_score IS NOT NULL THEN {scores.LEVEL.format('s.trust_score')} END AS trust_level,"
        " CASE WHEN d.doc_id IS NULL THEN '' ELSE d.doc_id || '.md' END AS source_path FROM guess g"
        " JOIN pkgs p USING (name, version) LEFT JOIN documents d ON 'pkg-' || d.doc_id = g.name LEFT JOIN scored s ON s.name = g.name"
        " LEFT JOIN (SELECT e.name, string_agg(DISTINCT e.dep_name || '=' || t.version, '|') AS deps FROM edges e"
        " JOIN guess s ON s.name = e.name AND s.version = e.version JOIN guess t ON t.name = e.dep_name GROUP BY e.name) e ON e.name = g.name",
    ),
)


@case("lock_from_resolution", o.with_(*_RESOLVED) + "SELECT * FROM resolved")
def lock_from_resolution(spark, sf_dir):
    return _flat(_resolved(spark, sf_dir))


@case(
    "lock_doc",
    o.with_(*_RESOLVED)
    + "SELECT name, '{\"capabilities\":[\"' || capabilities || '\"],\"dependencies\":{' || CASE dependencies WHEN '' THEN '' ELSE"
    " '\"' || split_part(dependencies, '=', 1) || '\":\"' || split_part(dependencies, '=', 2) || '\"' END || '},\"format\":\"' || format"
    " || '\",\"integrity\":\"' || integrity || '\"' || CASE source_path WHEN '' THEN '' ELSE ',\"source_path\":\"' || source_path || '\"' END"
    " || CASE WHEN trust_level IS NULL THEN '' ELSE ',\"trust_level\":\"' || trust_level || '\",\"trust_score\":' || trust_score END"
    " || ',\"version\":\"' || version || '\"}' AS entry FROM resolved",
)
def lock_doc(spark, sf_dir):
    return lock.entry_json(_resolved(spark, sf_dir))


# --- bills of materials ------------------------------------------------------------------


def _components(spark, sf_dir):
    rated = trust.scan_scores(skills.results(spark, sf_dir))
    # Only skills with fewer than two findings are rated; the rest stay unscored.
    few = F.col("findings_count") < 2
    return sbom.components(rated.withColumns({c: F.when(few, F.col(c)) for c in ("trust_score", "trust_level")}))


_RATED = (
    "rated",
    "SELECT r.*, CASE WHEN r.findings_count < 2 THEN b.score END AS trust_score,"
    f" CASE WHEN r.findings_count < 2 THEN {scores.LEVEL.format('b.score')} END AS trust_level,"
    " 'pkg:agent-skill/' || r.name || '@' || r.version AS purl FROM results r JOIN"
    f" (SELECT seq, 0.35e0 + 0.3e0 * behavioral AS score FROM ({skills._BEHAVIORAL})) b USING (seq)",
)


@case(
    "sbom_components",
    o.scan(
        "SELECT seq, name, version, format, is_safe, findings_count, purl, round(trust_score, 4) AS trust_score, trust_level,"
        " array_to_string(declared_capabilities, '|') AS capabilities FROM rated",
        _RATED,
    ),
)
def sbom_components(spark, sf_dir):
    rows = _components(spark, sf_dir)
    return rows.select(
        "seq",
        "name",
        "version",
        "format",
        "is_safe",
        "findings_count",
        "purl",
        F.round("trust_score", 4).alias("trust_score"),
        "trust_level",
        F.array_join("capabilities", "|").alias("capabilities"),
    )


_PROPERTIES = (
    "props",
    "SELECT seq, 'agent-skill:format' AS name, format AS value FROM rated UNION ALL"
    " SELECT seq, 'agent-skill:is-safe', CAST(is_safe AS VARCHAR) FROM rated UNION ALL"
    " SELECT seq, 'agent-skill:findings-count', CAST(findings_count AS VARCHAR) FROM rated UNION ALL"
    " SELECT seq, 'agent-skill:capabilities', array_to_string(declared_capabilities, ',') FROM rated WHERE len(declared_capabilities) > 0 UNION ALL"
    " SELECT seq, 'agent-skill:trust-score', printf('%.2f', trust_score) FROM rated WHERE trust_score IS NOT NULL UNION ALL"
    " SELECT seq, 'agent-skill:trust-level', trust_level FROM rated WHERE trust_level IS NOT NULL UNION ALL"
    " SELECT seq, 'agent-skill:source-path', name || '.md' FROM rated",
)


@case("sbom_properties", o.scan("SELECT seq, name, value FROM props", _RATED, _PROPERTIES))
def sbom_properties(spark, sf_dir):
    rows = _components(spark, sf_dir).select("seq", F.explode(sbom.properties()).alias("p"))
    return rows.select("seq", "p.name", "p.value")


@case(
    "sbom_summary",
    o.scan(
        "SELECT 'total' AS kind, '' AS key, count(*) AS value FROM rated UNION ALL SELECT 'safe', '', count(*) FILTER (is_safe) FROM rated"
        " UNION ALL SELECT 'unsafe', '', count(*) FILTER (NOT is_safe) FROM rated"
        " UNION ALL SELECT 'total_findings', '', CAST(sum(findings_count) AS BIGINT) FROM rated"
        " UNION ALL SELECT 'format', format, count(*) FROM rated GROUP BY format"
        " UNION ALL SELECT 'trust_level', coalesce(trust_level, 'UNSCORED'), count(*) FROM rated GROUP BY trust_level",
        _RATED,
    ),
)
def sbom_summary(spark, sf_dir):
    return sbom.summary(_components(spark, sf_dir))


@case(
    "sbom_doc",
    o.scan(
        "SELECT seq, '{\"type\":\"library\",\"name\":\"' || r.name || '\",\"version\":\"' || version || '\",\"purl\":\"' || purl"
        " || '\",\"properties\":[' || p.listed || ']}' AS component, '{\"ref\":\"' || purl || '\"}' AS dependency FROM rated r JOIN"
        " (SELECT seq, string_agg('{\"name\":\"' || name || '\",\"value\":\"' || value || '\"}', ',' ORDER BY list_position("
        "['agent-skill:format','agent-skill:is-safe','agent-skill:findings-count','agent-skill:capabilities','agent-skill:trust-score',"
        "'agent-skill:trust-level','agent-skill:source-path'], name)) AS listed FROM props GROUP BY seq) p USING (seq)",
        _RATED,
        _PROPERTIES,
    ),
)
def sbom_doc(spark, sf_dir):
    return sbom.component_json(_components(spark, sf_dir))


@case(
    "sbom_dependencies",
    o.with_(("configs", fx.MCP_CONFIGS))
    + "SELECT 'pkg:agent-skill/srv-' || regexp_extract(content, '\"srv-([0-9]+)\":\\{\"command\":\"npx', 1) || '@unknown' AS ref,"
    " seq, 'pkg:agent-skill/' || regexp_extract(content, '@org/pkg-[0-9]+') || '@unknown' AS target FROM configs"
    " WHERE content LIKE '%@org%' AND regexp_extract(content, '\"srv-([0-9]+)\":\\{\"command\":\"npx', 1)"
    " <> regexp_extract(content, '\"srv-([0-9]+)\":\\{\"command\":\"serve', 1)",
)
def sbom_dependencies(spark, sf_dir):
    # Every file in a folder of its own, so that no server name is declared twice.
    configs = fx.spread(fx.derive(spark, sf_dir, fx.MCP_CONFIGS))
    apart = configs.withColumn("path", F.concat_ws("/", F.col("seq").cast("string"), F.split_part("path", F.lit("/"), F.lit(3))))
    rows = sbom.components(scan.analyze(skills_from_configs(apart)))
    targets = F.explode(sbom.depends_on(F.col("dependencies"))).alias("target")
    return rows.select(F.col("purl").alias("ref"), "seq", targets)
