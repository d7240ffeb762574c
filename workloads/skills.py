"""Queries over the skill corpus: extraction, detection, lattice, roll-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.functions import catalog as C
from wardline.functions import text as X
from wardline.operators import capabilities as caps
from wardline.operators import report, scan, trust
from wardline.plans.shape import unnest, unnest_values
from wardline.sources.skills import skills_from_markdown
from workloads import fixtures as fx
from workloads import oracle as o
from workloads.cases import case


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Skill files of the corpus, with the label and the declared capabilities."""
    rows = fx.derive(spark, sf_dir, fx.SKILL_CORPUS)
    files = rows.select(
        "seq",
        "version",
        "format",
        "malicious",
        F.concat("name", F.lit(".md")).alias("path"),
        F.col("raw_content").alias("content"),
        F.filter(F.split("declared", ","), lambda d: d != "").alias("declared_capabilities"),
    )
    return fx.spread(files)


def skills(spark: SparkSession, sf_dir: str) -> DataFrame:
    return skills_from_markdown(corpus(spark, sf_dir))


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.analyze(skills(spark, sf_dir))


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.findings_of(results(spark, sf_dir))


def shown(values) -> F.Column:
    return F.array_join(values, "|")


# --- extraction -----------------------------------------------------------------


@case("extract_urls", o.scan(f"SELECT seq, CAST(len(urls) AS INTEGER) AS n, {o.joined('urls')} AS urls FROM parsed"))
def extract_urls(spark, sf_dir):
    urls = X.urls(F.col("content"))
    return corpus(spark, sf_dir).select("seq", F.size(urls).alias("n"), shown(urls).alias("urls"))


@case("extract_env_prose", o.scan(f"SELECT seq, {o.joined('env_vars')} AS env_vars FROM parsed"))
def extract_env_prose(spark, sf_dir):
    return corpus(spark, sf_dir).select("seq", shown(X.env_in_prose(F.col("content"))).alias("env_vars"))


@case(
    "extract_env_manifest",
    o.scan(f"SELECT seq, {o.joined(o.env_names('raw_content', o.ENV_MANIFEST))} AS env_vars FROM parsed"),
)
def extract_env_manifest(spark, sf_dir):
    return corpus(spark, sf_dir).select("seq", shown(X.env_in_manifest(F.col("content"))).alias("env_vars"))


@case("extract_code_blocks", o.scan("SELECT seq, unnest(code_blocks) AS block FROM parsed"))
def extract_code_blocks(spark, sf_dir):
    blocks = X.code_blocks(X.fences(F.col("content")))
    return unnest_values(corpus(spark, sf_dir), blocks, ["seq"], "block")


@case("extract_shell_lines", o.scan("SELECT seq, unnest(shell_commands) AS command FROM parsed"))
def extract_shell_lines(spark, sf_dir):
    lines = X.shell_lines(X.fences(F.col("content")))
    return unnest_values(corpus(spark, sf_dir), lines, ["seq"], "command")


@case("frontmatter", o.scan("SELECT seq, name, description FROM parsed"))
def frontmatter(spark, sf_dir):
    return skills(spark, sf_dir).select("seq", "name", "description")


@case("integrity_hash", o.scan("SELECT seq, 'sha256:' || sha256(raw_content) AS integrity FROM skill_corpus"))
def integrity_hash(spark, sf_dir):
    return corpus(spark, sf_dir).select("seq", X.integrity(F.col("content")).alias("integrity"))


# --- detection ------------------------------------------------------------------


@case("infer_capabilities", o.scan("SELECT seq, name AS skill_name, resource, access FROM inferred"))
def infer_capabilities(spark, sf_dir):
    rows = skills(spark, sf_dir)
    found = rows.select("seq", F.col("name"), scan.inferred_capabilities(rows).alias("inferred"))
    return scan.capabilities_of(found)


def _hits(name: str) -> str:
    return o.scan(f"SELECT {o.HIT_COLUMNS} FROM {name}")


@case("detect_shell", _hits("shell_hits"))
def detect_shell(spark, sf_dir):
    rows = skills(spark, sf_dir)
    return scan.detect(rows, scan.shell_findings(rows))


@case("detect_code", _hits("code_hits"))
def detect_code(spark, sf_dir):
    rows = skills(spark, sf_dir)
    return scan.detect(rows, scan.code_findings(rows))


@case("detect_external_url", _hits("url_hits"))
def detect_external_url(spark, sf_dir):
    rows = skills(spark, sf_dir)
    return scan.detect(rows, scan.url_findings(rows))


@case("detect_sensitive_env", _hits("env_hits"))
def detect_sensitive_env(spark, sf_dir):
    rows = skills(spark, sf_dir)
    return scan.detect(rows, scan.env_findings(rows))


@case("detect_info_flow", _hits("flow_hits"))
def detect_info_flow(spark, sf_dir):
    rows = skills(spark, sf_dir)
    return scan.detect(rows, scan.flow_findings(rows))


@case("parse_declared_caps", o.scan("SELECT seq, name AS skill_name, resource, access FROM levels"))
def parse_declared_caps(spark, sf_dir):
    return declared(spark, sf_dir)


@case("detect_violations", _hits("violation_hits"))
def detect_violations(spark, sf_dir):
    rows = skills(spark, sf_dir)
    known = rows.withColumns(
        {
            "inferred": scan.inferred_capabilities(rows),
            "levels": scan.declared_levels(rows["declared_capabilities"]),
        }
    )
    found = scan.violation_findings(F.col("declared_capabilities"), F.col("levels"), F.col("inferred"))
    return scan.detect(known, found)


@case("scan_findings", _hits("findings"))
def scan_findings(spark, sf_dir):
    return findings(spark, sf_dir)


@case("max_severity", o.scan("SELECT seq, name, findings_count, is_safe, max_severity FROM results"))
def max_severity(spark, sf_dir):
    return results(spark, sf_dir).select("seq", "name", "findings_count", "is_safe", "max_severity")


@case(
    "severity_filter",
    o.scan(
        "SELECT p.seq, CAST(count(f.seq) AS INTEGER) AS findings_count, count(f.seq) = 0 AS is_safe FROM parsed p"
        " LEFT JOIN findings f ON f.seq = p.seq AND f.severity >= 4 GROUP BY p.seq"
    ),
)
def severity_filter(spark, sf_dir):
    return scan.keep_severity(results(spark, sf_dir), C.CRITICAL).select("seq", "findings_count", "is_safe")


USER_RULES = (
    C.Rule(r"\bpassword\b", C.HIGH, "credential_harvesting", "Mentions a password", "i"),
    C.Rule(r"###", C.LOW, "prompt_injection", "Heading marks inside prose"),
    C.Rule(r"<script\b", C.CRITICAL, "prompt_injection", "Script tag", "i"),
)


@case(
    "user_rules",
    r"""
SELECT 'documents' AS source, doc_id AS id, message, severity FROM documents JOIN (VALUES
  ('(?i)\bpassword\b', 3, 'Mentions a password'), ('###', 1, 'Heading marks inside prose'),
  ('(?i)<script\b', 4, 'Script tag')) AS r(pattern, severity, message) ON regexp_matches(text, pattern)
UNION ALL
SELECT 'pages', page_id, message, severity FROM pages JOIN (VALUES
  ('(?i)\bpassword\b', 3, 'Mentions a password'), ('###', 1, 'Heading marks inside prose'),
  ('(?i)<script\b', 4, 'Script tag')) AS r(pattern, severity, message) ON regexp_matches(html, pattern)
""",
)
def user_rules(spark, sf_dir):
    fx.load(spark, sf_dir, "documents", "pages")
    documents = fx.spread(spark.table("documents").select(F.lit("documents").alias("source"), F.col("doc_id").alias("id"), "text"))
    pages = fx.spread(spark.table("pages").select(F.lit("pages").alias("source"), F.col("page_id").alias("id"), F.col("html").alias("text")))
    hits = [scan.apply_rules(t, "text", USER_RULES, ["source", "id"]) for t in (documents, pages)]
    return hits[0].unionByName(hits[1]).select("source", "id", "message", "severity")


# --- URLs of real pages, hidden text, provenance -----------------------------------

_HOST = r"lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#]*@)?([^:/?#]*)', 1))"


@case("url_host", f"SELECT page_id, {_HOST} AS host FROM pages")
def url_host(spark, sf_dir):
    fx.load(spark, sf_dir, "pages")
    return spark.table("pages").select("page_id", X.url_host(F.col("url")).alias("host"))


@case("url_safe", f"SELECT page_id, url, {o.safe_url('url')} AS safe FROM pages")
def url_safe(spark, sf_dir):
    fx.load(spark, sf_dir, "pages")
    return spark.table("pages").select("page_id", "url", X.is_safe_url(F.col("url")).alias("safe"))


# The message is the document's language code, hidden as the published format writes it.
HIDDEN = """
SELECT doc_id, lang, concat(substr(text, 1, 10), CASE WHEN quality IS NULL THEN '' ELSE concat(chr(65279),
    replace(replace(bits, '0', chr(8203)), '1', chr(8205)), chr(65279)) END, text) AS text
FROM (SELECT d.doc_id, d.lang, d.text, l.quality,
    CASE d.lang WHEN 'en' THEN '0110010101101110' WHEN 'fr' THEN '0110011001110010' WHEN 'de' THEN '0110010001100101'
      ELSE '0110010101110011' END AS bits
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id) AS marked
"""


@case(
    "hidden_text",
    "SELECT d.doc_id, l.doc_id IS NOT NULL AS hidden, CASE WHEN l.doc_id IS NULL THEN '' ELSE d.lang END AS message"
    " FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id",
)
def hidden_text(spark, sf_dir):
    # chr() stops at 255 in Spark SQL; the marks are put in as literals.
    sql = HIDDEN.replace("chr(65279)", f"'{C.HIDDEN_MARK}'").replace("chr(8203)", f"'{C.HIDDEN_ZERO}'")
    sql = sql.replace("chr(8205)", "'‍'")
    rows = fx.spread(fx.derive(spark, sf_dir, sql))
    return rows.select(
        "doc_id",
        X.hidden_run(F.col("text")).isNotNull().alias("hidden"),
        X.hidden_text(F.col("text")).alias("message"),
    )


@case(
    "provenance_verify",
    "SELECT p_partkey, p_size <= 40 AS intact FROM part",
)
def provenance_verify(spark, sf_dir):
    """Stamp every part row, change the rows above a size, then check the stamps."""
    from wardline.operators import provenance

    fx.load(spark, sf_dir, "part")
    stamped = provenance.stamp(spark.table("part"))
    price = F.col("p_retailprice") + F.when(F.col("p_size") > 40, 1.0).otherwise(0.0)
    return provenance.verify(stamped.withColumn("p_retailprice", price)).select("p_partkey", "intact")


# --- capability lattice -------------------------------------------------------------


def declared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declared levels as a long table, highest per skill and resource."""
    rows = skills(spark, sf_dir).select(
        "seq", F.col("name").alias("skill_name"), scan.declared_levels(F.col("declared_capabilities")).alias("levels")
    )
    long = unnest(rows, "levels", ["seq", "skill_name"])
    return long.groupBy("seq", "skill_name", "resource").agg(F.max("access").alias("access"))


def _held(spark, sf_dir):
    return declared(spark, sf_dir).select("seq", "resource", "access")


def _wanted(spark, sf_dir):
    rows = skills(spark, sf_dir)
    found = rows.select("seq", "name", scan.inferred_capabilities(rows).alias("inferred"))
    return scan.capabilities_of(found).select("seq", "resource", "access")


@case(
    "cap_join_meet",
    o.scan(
        "SELECT seq, resource, greatest(coalesce(l.access, 0), coalesce(i.access, 0)) AS join_level,"
        " least(coalesce(l.access, 0), coalesce(i.access, 0)) AS meet_level"
        " FROM levels l FULL JOIN inferred i USING (seq, resource)"
    ),
)
def cap_join_meet(spark, sf_dir):
    return caps.join_and_meet(_held(spark, sf_dir), _wanted(spark, sf_dir), "seq")


@case(
    "cap_normalise",
    o.scan(
        "SELECT seq, resource, max(access) AS access FROM (SELECT seq, resource, access FROM levels UNION ALL"
        " SELECT seq, resource, access FROM inferred) GROUP BY ALL"
    ),
)
def cap_normalise(spark, sf_dir):
    return caps.normalise(_held(spark, sf_dir).unionByName(_wanted(spark, sf_dir)), "seq")


_PERMIT = (
    "SELECT i.seq, i.resource, i.access, coalesce(l.access >= i.access, false) AS permitted FROM inferred i"
    " LEFT JOIN levels l ON l.seq = i.seq AND l.resource = i.resource"
)


@case("cap_permits", o.scan(_PERMIT))
def cap_permits(spark, sf_dir):
    return caps.permits(_held(spark, sf_dir), _wanted(spark, sf_dir), "seq")


@case(
    "cap_subset",
    o.scan(
        "SELECT p.seq, coalesce(bool_and(t.permitted), true) AS is_subset FROM parsed p LEFT JOIN"
        f" ({_PERMIT}) t USING (seq) GROUP BY p.seq"
    ),
)
def cap_subset(spark, sf_dir):
    keys = corpus(spark, sf_dir).select("seq")
    return caps.subset_of(_held(spark, sf_dir), _wanted(spark, sf_dir), keys, "seq")


@case("cap_violations", o.scan(f"SELECT seq, resource, access FROM ({_PERMIT}) WHERE NOT permitted"))
def cap_violations(spark, sf_dir):
    return caps.violations(_held(spark, sf_dir), _wanted(spark, sf_dir), "seq")


@case("cap_contains", o.scan("SELECT seq, resource, access FROM inferred SEMI JOIN levels USING (seq, resource, access)"))
def cap_contains(spark, sf_dir):
    return caps.contained(_held(spark, sf_dir), _wanted(spark, sf_dir), "seq")


_MATRIX = ", ".join(
    f"coalesce(max(CASE WHEN resource = '{r}' THEN {o.LEVEL_NAME.format('access')} END), 'NONE') AS {r}"
    for r in C.RESOURCES
)


@case("cap_matrix", o.scan(f"SELECT seq, name AS skill_name, {_MATRIX} FROM inferred GROUP BY seq, name"))
def cap_matrix(spark, sf_dir):
    return report.capability_matrix(results(spark, sf_dir))


# --- roll-ups -------------------------------------------------------------------------

_SUMMARY = (
    "SELECT (SELECT count(*) FROM results) AS total_skills, (SELECT count(*) FROM results WHERE is_safe) AS safe_count,"
    " (SELECT count(*) FROM results WHERE NOT is_safe) AS unsafe_count,"
    " count(*) FILTER (severity = 4) AS critical_count, count(*) FILTER (severity = 3) AS high_count,"
    " count(*) FILTER (severity = 2) AS medium_count, count(*) FILTER (severity = 1) AS low_count,"
    " (SELECT string_agg(format, '|' ORDER BY format) FROM (SELECT DISTINCT format FROM results)) AS frameworks_detected"
    " FROM findings"
)


@case("exec_summary", o.scan(_SUMMARY))
def exec_summary(spark, sf_dir):
    summary = report.executive_summary(results(spark, sf_dir))
    return summary.withColumn("frameworks_detected", shown(F.col("frameworks_detected")))


_TABLE = f"""
SELECT f.name AS skill_name, m.format, {o.SEVERITY_NAME.format('f.severity')} AS severity, message, attack_class, finding_type,
  CASE WHEN length(evidence) > 120 THEN substr(evidence, 1, 117) || '...' ELSE evidence END AS evidence
FROM findings f LEFT JOIN (SELECT name, arg_max(format, seq) AS format FROM parsed GROUP BY name) m USING (name)
"""


@case("findings_table", o.scan(_TABLE))
def findings_table(spark, sf_dir):
    return report.findings_table(findings(spark, sf_dir), report.name_formats(skills(spark, sf_dir)))


@case("findings_filter", o.scan(f"SELECT * FROM ({_TABLE}) WHERE severity = 'HIGH' AND format = 'src3'"))
def findings_filter(spark, sf_dir):
    return report.findings_filter(findings_table(spark, sf_dir), "HIGH", "src3")


@case(
    "severity_share",
    o.scan(
        f"SELECT {o.SEVERITY_NAME.format('severity')} AS severity, count(*) AS findings,"
        " round(count(*) / sum(count(*)) OVER (), 6) AS share FROM findings GROUP BY findings.severity"
    ),
)
def severity_share(spark, sf_dir):
    return report.severity_share(findings(spark, sf_dir)).withColumn("share", F.round("share", 6))


@case("framework_coverage", "SELECT source AS framework, count(*) AS count FROM documents GROUP BY source")
def framework_coverage(spark, sf_dir):
    return report.framework_coverage(skills(spark, sf_dir))


@case(
    "scan_summary",
    o.scan(
        "SELECT seq, name AS skill_name, CASE WHEN is_safe THEN 'SAFE' ELSE 'UNSAFE' END AS status, findings_count,"
        f" coalesce({o.SEVERITY_NAME.format('max_severity')}, '-') AS max_severity FROM results"
    ),
)
def scan_summary(spark, sf_dir):
    return report.scan_table(results(spark, sf_dir))


@case(
    "scan_totals",
    o.scan(
        "SELECT count(*) AS skills, count(*) FILTER (is_safe) AS safe, count(*) FILTER (NOT is_safe) AS unsafe,"
        " CAST(sum(findings_count) AS BIGINT) AS findings FROM results"
    ),
)
def scan_totals(spark, sf_dir):
    return report.scan_summary(results(spark, sf_dir))


@case(
    "attack_phase_rollup",
    o.scan(
        "SELECT f.attack_class, p.phase, p.phase_order, f.findings FROM (SELECT attack_class, count(*) AS findings"
        " FROM findings GROUP BY attack_class) f LEFT JOIN (VALUES ('data_exfiltration','EXECUTE',4),"
        " ('data_exfiltration','PERSIST',5), ('privilege_escalation','CONFIGURE',3), ('privilege_escalation','EXECUTE',4),"
        " ('prompt_injection','LOAD',2), ('prompt_injection','CONFIGURE',3), ('prompt_injection','EXECUTE',4),"
        " ('dependency_confusion','INSTALL',1), ('typosquatting','INSTALL',1), ('namespace_squatting','INSTALL',1))"
        " AS p(attack_class, phase, phase_order) USING (attack_class)"
    ),
)
def attack_phase_rollup(spark, sf_dir):
    return report.phase_rollup(findings(spark, sf_dir)).select("attack_class", "phase", "phase_order", "findings")


@case(
    "finding_rollup",
    o.scan(
        "SELECT CASE WHEN grouping(attack_class) = 1 THEN 'ALL' ELSE attack_class END AS attack_class,"
        f" CASE WHEN grouping(severity) = 1 THEN 'ALL' ELSE {o.SEVERITY_NAME.format('severity')} END AS severity,"
        " count(*) AS findings FROM findings GROUP BY ROLLUP (attack_class, severity)"
    ),
)
def finding_rollup(spark, sf_dir):
    return report.finding_rollup(findings(spark, sf_dir))


@case(
    "detection_metrics",
    o.scan(
        "SELECT tp, fp, fn, tn, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall,"
        " round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM (SELECT"
        " count(*) FILTER (malicious = 1 AND bad) AS tp, count(*) FILTER (malicious = 0 AND bad) AS fp,"
        " count(*) FILTER (malicious = 1 AND NOT bad) AS fn, count(*) FILTER (malicious = 0 AND NOT bad) AS tn FROM"
        " (SELECT malicious, coalesce(max_severity, 0) = 4 AS bad FROM results))"
    ),
)
def detection_metrics(spark, sf_dir):
    files = corpus(spark, sf_dir)
    flagged = scan.analyze(skills_from_markdown(files)).select(
        "seq", (F.coalesce("max_severity", F.lit(0)) == C.CRITICAL).alias("flagged")
    )
    labelled = files.select("seq", "malicious").join(flagged, "seq")
    metrics = report.detection_metrics(labelled, "malicious", "flagged")
    return metrics.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


@case(
    "scan_results",
    o.scan(
        f"SELECT r.seq, r.name AS skill_name, is_safe, findings_count, {o.SEVERITY_NAME.format('max_severity')} AS max_severity,"
        " coalesce(f.listed, '') AS findings, coalesce(c.listed, '') AS inferred_capabilities FROM results r"
        f" LEFT JOIN (SELECT seq, string_agg({o.SEVERITY_NAME.format('severity')} || '~' || message, '|'"
        " ORDER BY severity, message, evidence) AS listed FROM findings GROUP BY seq) f USING (seq)"
        f" LEFT JOIN (SELECT seq, string_agg(resource || ':' || {o.LEVEL_NAME.format('access')}, '|' ORDER BY resource)"
        " AS listed FROM inferred GROUP BY seq) c USING (seq)"
    ),
)
def scan_results(spark, sf_dir):
    documents = report.scan_documents(results(spark, sf_dir))
    listed_caps = F.array_sort(
        F.transform("inferred_capabilities", lambda c: F.concat_ws(":", c["resource"], c["access"]))
    )
    plain = F.transform(
        "findings",
        lambda f: F.struct(
            level_of(f["severity"]).alias("rank"), f["message"].alias("message"), f["evidence"].alias("evidence"),
            f["severity"].alias("severity"),
        ),
    )
    return documents.select(
        "seq",
        "skill_name",
        "is_safe",
        "findings_count",
        "max_severity",
        shown(F.transform(F.array_sort(plain), lambda f: F.concat_ws("~", f["severity"], f["message"]))).alias("findings"),
        shown(listed_caps).alias("inferred_capabilities"),
    )


def level_of(name):
    value = F.when(name == "LOW", 1)
    for severity in (C.MEDIUM, C.HIGH, C.CRITICAL):
        value = value.when(name == C.SEVERITY_NAMES[severity], severity)
    return value


@case("report_payload")
def report_payload(spark, sf_dir):
    return report.payload(results(spark, sf_dir), report.name_formats(skills(spark, sf_dir)))


# --- trust of scanned skills ------------------------------------------------------------

_PENALTY = "CASE severity WHEN 1 THEN 0.05 WHEN 2 THEN 0.1 WHEN 3 THEN 0.2 ELSE 0.35 END"
_BEHAVIORAL = (
    "SELECT p.seq, p.name, greatest(0, 1 - coalesce(b.cost, 0)) AS behavioral FROM parsed p LEFT JOIN"
    f" (SELECT seq, CAST(sum({_PENALTY}) AS DOUBLE) AS cost FROM findings GROUP BY seq) b USING (seq)"
)


@case("trust_behavioral", o.scan(f"SELECT seq, round(behavioral, 6) AS behavioral FROM ({_BEHAVIORAL})"))
def trust_behavioral(spark, sf_dir):
    return results(spark, sf_dir).select("seq", F.round(trust.behavioral(F.col("findings")), 6).alias("behavioral"))


@case(
    "trust_scan",
    o.scan(
        "SELECT seq, name, round(score, 4) AS score, CASE WHEN score >= 0.75 THEN 'FORMALLY_VERIFIED'"
        " WHEN score >= 0.5 THEN 'COMMUNITY_VERIFIED' WHEN score >= 0.25 THEN 'SIGNED' ELSE 'UNSIGNED' END AS level FROM"
        f" (SELECT seq, name, 0.35e0 + 0.3e0 * behavioral AS score FROM ({_BEHAVIORAL}))"
    ),
)
def trust_scan(spark, sf_dir):
    scored = trust.scan_scores(results(spark, sf_dir))
    return scored.select("seq", "name", F.round("trust_score", 4).alias("score"), F.col("trust_level").alias("level"))
