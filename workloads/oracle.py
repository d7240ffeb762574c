"""Building blocks of the comparison SQL (DuckDB dialect).

The comparison SQL is written from the published rules on its own terms. Its
regex engine has no look-around, so a look-ahead is replaced by consuming the
following character after every possible delimiter has been doubled.
"""

from __future__ import annotations

from workloads import fixtures as fx

BLANKS = "chr(9)||chr(10)||chr(11)||chr(12)||chr(13)||' '||chr(133)||chr(160)||chr(8199)||chr(8239)||chr(12288)"


def q(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("'", "''") + "'"


def with_(*parts: tuple[str, str]) -> str:
    return "WITH " + ",\n".join(f"{name} AS ({sql})" for name, sql in parts) + "\n"


URL = r"""https?://[^\s"'`)\]>]+"""
URL_CODE = r"""https?://[^\s"'`,)\]}>]+"""
ENV_PROSE = (
    r"""(?m)(?:\$\{?[A-Z][A-Z0-9_]{1,}\}?|os\.environ\[["'][A-Z][A-Z0-9_]{1,}["']\]"""
    r"""|os\.getenv\(["'][A-Z][A-Z0-9_]{1,}["']\)|export\s+[A-Z][A-Z0-9_]{1,}"""
    r"""|(?:^|[\s=:`])[A-Z][A-Z_]{1,}[A-Z0-9_]*[=\s"'`])"""
)
ENV_MANIFEST = r"""(?m)(?:\$\{?[A-Z][A-Z0-9_]{1,}\}?|(?:^|[\s=:])[A-Z][A-Z_]{1,}[A-Z0-9_]*[=\s"'`])"""
ENV_PYTHON = (
    r"""(?m)(?:\$\{?[A-Z][A-Z0-9_]{1,}\}?|os\.environ\[["'][A-Z][A-Z0-9_]{1,}["']\]"""
    r"""|os\.getenv\(["'][A-Z][A-Z0-9_]{1,}["']\))"""
)


def find_all(text: str, pattern: str, group: int = 0) -> str:
    return f"regexp_extract_all({text}, {q(pattern)}, {group})"


def sorted_set(values: str) -> str:
    return f"list_sort(list_distinct({values}))"


def env_names(text: str, pattern: str) -> str:
    doubled = rf"regexp_replace({text}, '([\s=`])', '\1\1', 'g')"
    return sorted_set(
        f"list_transform({find_all(doubled, pattern)}, lambda m: regexp_extract(m, '[A-Z][A-Z0-9_]+'))"
    )


def fences(text: str) -> str:
    block = find_all(text, r"(?s)```\w*\n.*?```")
    return (
        f"list_transform({block}, lambda b: {{'tag': regexp_extract(b, '^```(\\w*)\\n', 1),"
        f" 'body': regexp_extract(b, '(?s)^```\\w*\\n(.*)```$', 1)}})"
    )


def shell_lines(fence: str) -> str:
    shell = f"list_filter({fence}, lambda b: lower(b.tag) IN ('bash','sh','shell','zsh',''))"
    lines = f"flatten(list_transform({shell}, lambda b: str_split(b.body, chr(10))))"
    trimmed = f"list_transform({lines}, lambda l: trim(l, {BLANKS}))"
    return f"list_filter({trimmed}, lambda l: l <> '' AND NOT starts_with(l, '#'))"


SKILLS = f"""
SELECT seq, name, version, format, malicious, raw_content, declared,
  list_filter(str_split(declared, ','), lambda x: x <> '') AS declared_capabilities,
  regexp_extract(raw_content, '(?m)^description:[ ]+(.*)$', 1) AS description,
  {find_all('raw_content', URL)} AS urls, {env_names('raw_content', ENV_PROSE)} AS env_vars,
  {fences('raw_content')} AS fences
FROM skill_corpus
"""
PARSED = f"""
SELECT *, list_transform(fences, lambda b: b.body) AS code_blocks, {shell_lines('fences')} AS shell_commands FROM skills
"""


def safe_url(url: str) -> str:
    host = f"lower(regexp_extract({url}, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#]*@)?([^:/?#]*)', 1))"
    exact = (
        "'github.com','www.github.com','pypi.org','www.pypi.org','npmjs.org','www.npmjs.org',"
        "'npmjs.com','www.npmjs.com'"
    )
    return (
        f"({host} IN ({exact}) OR {host} LIKE '%.github.com' OR {host} LIKE '%.pypi.org'"
        f" OR {host} LIKE '%.npmjs.org' OR {host} LIKE '%.npmjs.com' OR {host} LIKE 'docs.%')"
    )


INFERRED = r"""
SELECT seq, name, 'network' AS resource, CASE WHEN regexp_matches(array_to_string(shell_commands, ' '),
    '(?i)-X\s+POST|-X\s+PUT|-X\s+PATCH|-X\s+DELETE|--data\b|-d\s+["'']') THEN 2 ELSE 1 END AS access
  FROM parsed WHERE len(urls) > 0
UNION ALL SELECT seq, name, 'shell', 2 FROM parsed WHERE len(shell_commands) > 0
UNION ALL SELECT seq, name, 'environment', 1 FROM parsed WHERE len(env_vars) > 0
UNION ALL SELECT seq, name, 'filesystem', CASE WHEN w THEN 2 ELSE 1 END FROM (
  SELECT seq, name, regexp_matches(raw_content || ' ' || description,
      '(?i)\bwrite[s]?\s+to\s+|\bwrite[s]?\s+file|\bsave[s]?\s+to\s+|\bcreate[s]?\s+file') AS w,
    regexp_matches(raw_content || ' ' || description,
      '(?i)\bread[s]?\s+file|\bopen[s]?\s+file|\bload[s]?\s+file|\bread[s]?\s+from\s+') AS r FROM parsed) WHERE w OR r
"""
LEVELS = """
SELECT seq, name, resource, max(access) AS access FROM (
  SELECT seq, name, lower(trim(split_part(d, ':', 1))) AS resource,
    CASE upper(trim(substr(d, strpos(d, ':') + 1))) WHEN 'NONE' THEN 0 WHEN 'READ' THEN 1 WHEN 'WRITE' THEN 2
      WHEN 'ADMIN' THEN 3 END AS access
  FROM (SELECT seq, name, unnest(declared_capabilities) AS d FROM parsed) WHERE strpos(d, ':') > 0)
WHERE access IS NOT NULL GROUP BY ALL
"""
SHELL_HITS = r"""
SELECT seq, name, severity, message, attack_class, 'pattern_match' AS finding_type, c AS evidence FROM (
  SELECT seq, name, unnest(shell_commands) AS c FROM parsed) JOIN (VALUES
  ('(?i)curl\s+.*\|\s*(ba)?sh', 4, 'privilege_escalation', 'Remote code: curl piped to shell'),
  ('(?i)wget\s+.*\|\s*(ba)?sh', 4, 'privilege_escalation', 'Remote code: wget piped to shell'),
  ('rm\s+-[a-zA-Z]*r[a-zA-Z]*f|rm\s+-[a-zA-Z]*f[a-zA-Z]*r', 4, 'privilege_escalation',
   'Destructive operation: recursive forced removal (rm -rf)'),
  ('(?i)base64\s+-d.*\|\s*(ba)?sh', 4, 'privilege_escalation', 'Obfuscated code: base64 decode piped to shell'),
  ('(?i)nc\s+-l', 4, 'data_exfiltration',
   'Network listener detected: netcat in listen mode (potential reverse shell)'),
  ('chmod\s+777', 3, 'privilege_escalation', 'Excessive permissions: chmod 777 grants world read/write/execute'))
  AS r(pattern, severity, attack_class, message) ON regexp_matches(c, pattern)
"""
CODE_HITS = r"""
SELECT seq, name, 3 AS severity, message, 'privilege_escalation' AS attack_class, 'pattern_match' AS finding_type,
  b AS evidence FROM (SELECT seq, name, unnest(code_blocks) AS b FROM parsed) JOIN (VALUES
  ('\beval\s*\(', 'Dynamic code evaluation: eval() can run arbitrary code'),
  ('\bexec\s*\(', 'Dynamic code evaluation: exec() can run arbitrary code')) AS r(pattern, message)
  ON regexp_matches(b, pattern)
"""
URL_HITS = f"""
SELECT seq, name, 3 AS severity, 'External URL detected: ' || u AS message, 'data_exfiltration' AS attack_class,
  'pattern_match' AS finding_type, u AS evidence FROM (SELECT seq, name, unnest(urls) AS u FROM parsed)
WHERE NOT {safe_url('u')}
"""
ENV_HITS = """
SELECT seq, name, 3 AS severity, 'Sensitive environment variable accessed: ' || e AS message,
  'data_exfiltration' AS attack_class, 'pattern_match' AS finding_type, e AS evidence
FROM (SELECT seq, name, unnest(env_vars) AS e FROM parsed)
WHERE regexp_matches(e, '(?i)SECRET|PASSWORD|TOKEN|API[_-]?KEY|CREDENTIAL|PRIVATE[_-]?KEY|^AWS_ACCESS_KEY_ID$|^DATABASE_URL$')
"""
FLOW_HITS = rf"""
SELECT seq, name, 4 AS severity, 'Information flow concern: base64 encoding combined with external network access suggests data exfiltration' AS message,
  'data_exfiltration' AS attack_class, 'info_flow' AS finding_type, 'base64 + external URL' AS evidence
FROM parsed WHERE len(list_filter(urls, lambda u: NOT {safe_url('u')})) > 0
  AND len(list_filter(list_concat(shell_commands, code_blocks), lambda t: regexp_matches(t, '(?i)\bbase64\b'))) > 0
"""
LEVEL_NAME = "CASE {0} WHEN 0 THEN 'NONE' WHEN 1 THEN 'READ' WHEN 2 THEN 'WRITE' WHEN 3 THEN 'ADMIN' END"
SEVERITY_NAME = "CASE {0} WHEN 1 THEN 'LOW' WHEN 2 THEN 'MEDIUM' WHEN 3 THEN 'HIGH' WHEN 4 THEN 'CRITICAL' END"
VIOLATION_HITS = f"""
SELECT i.seq, i.name, 3 AS severity,
  'Capability violation: skill requires ' || i.resource || ':' || {LEVEL_NAME.format('i.access')}
    || ' but only declares up to ' || i.resource || ':' || coalesce({LEVEL_NAME.format('l.access')}, 'NONE (undeclared)') AS message,
  'privilege_escalation' AS attack_class, 'capability_violation' AS finding_type,
  'inferred=' || i.resource || ':' || {LEVEL_NAME.format('i.access')} AS evidence
FROM inferred i JOIN parsed p USING (seq) LEFT JOIN levels l ON l.seq = i.seq AND l.resource = i.resource
WHERE len(p.declared_capabilities) > 0 AND coalesce(l.access, -1) < i.access
"""
FINDINGS = " UNION ALL ".join(
    f"SELECT seq, name, severity, message, attack_class, finding_type, evidence FROM {t}"
    for t in ("shell_hits", "code_hits", "url_hits", "env_hits", "flow_hits", "violation_hits")
)
RESULTS = """
SELECT p.*, CAST(coalesce(f.n, 0) AS INTEGER) AS findings_count, coalesce(f.n, 0) = 0 AS is_safe, f.max_severity
FROM parsed p LEFT JOIN (SELECT seq, count(*) AS n, max(severity) AS max_severity FROM findings GROUP BY seq) f USING (seq)
"""

_SCAN = (
    ("skill_corpus", fx.SKILL_CORPUS),
    ("skills", SKILLS),
    ("parsed", PARSED),
    ("inferred", INFERRED),
    ("levels", LEVELS),
    ("shell_hits", SHELL_HITS),
    ("code_hits", CODE_HITS),
    ("url_hits", URL_HITS),
    ("env_hits", ENV_HITS),
    ("flow_hits", FLOW_HITS),
    ("violation_hits", VIOLATION_HITS),
    ("findings", FINDINGS),
    ("results", RESULTS),
)


def scan(body: str, *more: tuple[str, str]) -> str:
    """SQL over the skill scan: ``parsed``, ``inferred``, ``levels``, ``*_hits``, ``findings``, ``results``."""
    return with_(*_SCAN, *more) + body


def joined(values: str) -> str:
    return f"array_to_string({values}, '|')"


HIT_COLUMNS = "seq, name AS skill_name, severity, message, attack_class, finding_type, evidence"
