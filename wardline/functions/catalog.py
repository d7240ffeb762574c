"""Rule catalogues, word lists, thresholds and dimension rows.

Everything here is plain data. Patterns are written in the common regex
dialect; :func:`wardline.functions.text.rx` adds the flags that make Java's
engine read them the way the published rules mean them. Users extend a
catalogue by passing their own sequence of :class:`Rule` to the operators.
"""

from __future__ import annotations

from typing import NamedTuple

# --- severities and access levels (fixed values) -----------------------------

LOW, MEDIUM, HIGH, CRITICAL = 1, 2, 3, 4
SEVERITY_NAMES = {1: "LOW", 2: "MEDIUM", 3: "HIGH", 4: "CRITICAL"}
NONE, READ, WRITE, ADMIN = 0, 1, 2, 3
ACCESS_NAMES = {0: "NONE", 1: "READ", 2: "WRITE", 3: "ADMIN"}
RESOURCES = (
    "filesystem",
    "network",
    "environment",
    "shell",
    "skill_invoke",
    "clipboard",
    "browser",
    "database",
)


class Rule(NamedTuple):
    """One detection rule: a pattern and what a hit is reported as.

    ``leads``, where given, are ASCII texts in lower case of which every match holds at
    least one, whatever the case of its letters.
    """

    pattern: str
    severity: int
    attack_class: str
    message: str
    flags: str = ""
    leads: tuple[str, ...] = ()


# --- shell, code and information-flow rules (fixed values) -------------------

SHELL_RULES = (
    Rule(r"curl\s+.*\|\s*(ba)?sh", CRITICAL, "privilege_escalation", "Remote code: curl piped to shell", "i"),
    Rule(r"wget\s+.*\|\s*(ba)?sh", CRITICAL, "privilege_escalation", "Remote code: wget piped to shell", "i"),
    Rule(
        r"rm\s+-[a-zA-Z]*r[a-zA-Z]*f|rm\s+-[a-zA-Z]*f[a-zA-Z]*r",
        CRITICAL,
        "privilege_escalation",
        "Destructive operation: recursive forced removal (rm -rf)",
    ),
    Rule(
        r"base64\s+-d.*\|\s*(ba)?sh",
        CRITICAL,
        "privilege_escalation",
        "Obfuscated code: base64 decode piped to shell",
        "i",
    ),
    Rule(
        r"nc\s+-l",
        CRITICAL,
        "data_exfiltration",
        "Network listener detected: netcat in listen mode (potential reverse shell)",
        "i",
    ),
    Rule(
        r"chmod\s+777",
        HIGH,
        "privilege_escalation",
        "Excessive permissions: chmod 777 grants world read/write/execute",
    ),
)

CODE_RULES = (
    Rule(
        r"\beval\s*\(", HIGH, "privilege_escalation", "Dynamic code evaluation: eval() can run arbitrary code", leads=("eval",)
    ),
    Rule(
        r"\bexec\s*\(", HIGH, "privilege_escalation", "Dynamic code evaluation: exec() can run arbitrary code", leads=("exec",)
    ),
)

BASE64_WORD = r"\bbase64\b"
HTTP_WRITE_FLAGS = r"-X\s+(?:POST|PUT|PATCH|DELETE)|--data\b|-d\s+['\"]"
FILE_WRITE_PHRASES = r"\b(?:writes?\s+to\s+|writes?\s+file|saves?\s+to\s+|creates?\s+file)"
# Cheap superset of both phrase lists, tried first.
FILE_PHRASE_HINT = r"[WwSsCcRrOoLl\u017f](?<=\b.)(?i:rite|ave|reate|ead|pen|oad)s?\s+(?i:to\s|file|from\s)"
FILE_READ_PHRASES = r"\b(?:reads?\s+file|opens?\s+file|loads?\s+file|reads?\s+from\s+)"

# --- trusted hosts and sensitive names (fixed values) ------------------------

SAFE_HOSTS = (
    "github.com",
    "www.github.com",
    "pypi.org",
    "www.pypi.org",
    "npmjs.org",
    "www.npmjs.org",
    "npmjs.com",
    "www.npmjs.com",
)
SAFE_HOST_SUFFIXES = (".github.com", ".pypi.org", ".npmjs.org", ".npmjs.com")
SAFE_HOST_PREFIX = "docs."
SENSITIVE_ENV = (
    r"SECRET|PASSWORD|TOKEN|API[_-]?KEY|CREDENTIAL|PRIVATE[_-]?KEY|^AWS_ACCESS_KEY_ID$|^DATABASE_URL$"
)
SENSITIVE_CODE_ENV = r"SECRET|KEY|TOKEN|PASSWORD|CREDENTIAL|PRIVATE"

# --- extraction patterns (fixed values) --------------------------------------

URL = r"https?://[^\s\"'`)\]>]+"
URL_IN_CODE = r"https?://[^\s\"'`,)\]}>]+"
ENV_NAME = r"[A-Z][A-Z0-9_]+"
ENV_DOLLAR = r"\$\{?[A-Z][A-Z0-9_]+"
ENV_PYTHON_CALL = (
    r"os\.(?:environ\[[\"'][A-Z][A-Z0-9_]+[\"']\]|getenv\([\"'][A-Z][A-Z0-9_]+[\"']\))"
)
ENV_EXPORT = r"export\s+[A-Z][A-Z0-9_]+"
# A bare upper-case word after a blank, "=", ":" or backtick and before "=", a blank or a quote.
ENV_BARE = r"[A-Z](?<![^\s=:`].)[A-Z_]+[A-Z0-9_]*(?=[=\s\"'`])"
ENV_BARE_MANIFEST = r"[A-Z](?<![^\s=:].)[A-Z_]+[A-Z0-9_]*(?=[=\s\"'`])"
ENV_JS_DOT = r"process\.env\.(\w+)"
ENV_JS_BRACKET = r"process\.env\[[\"'](\w+)[\"']\]"
ENV_JS_UPPER = r"process\.env\.([A-Z_][A-Z0-9_]*)"
ENV_SECRET_CALL = r"Secret\.from_env_var\(\s*[\"']([A-Z][A-Z0-9_]*)[\"']\s*\)"
ENV_STRING_REF = r"[\"']env:([A-Z][A-Z0-9_]+)[\"']"
FENCE = r"```\w*\n.*?```"
SHELL_TAGS = ("bash", "sh", "shell", "zsh", "")
SHELL_CALL = (
    r"(?:subprocess\.(?:run|call|check_call|check_output|Popen)|os\.(?:system|popen))"
    r"\s*\(\s*[\"']([^\"']+)[\"']"
)
SHELL_VERB_LINE = (
    r"(?:curl|wget|bash|sh|rm|chmod|chown|pip|npm|apt-get|yum|docker|kubectl|ssh|scp|nc|ncat)\s+[^\n]{3,}"
)
SHELL_VERB_QUOTED = (
    r"(?:curl|wget|bash|sh|rm|chmod|chown|pip|npm|apt-get|yum|docker|kubectl|ssh|scp|nc|ncat)\s+[^\n'\"]{3,}"
)
JS_EXEC_LITERAL = r"(?:execSync|exec|spawn|execFile|execFileSync)\s*\(\s*['\"]([^'\"]+)['\"]"
JS_EXEC_MARKERS = (
    r"\bchild_process\b",
    r"\bexec\s*\(",
    r"\bexecSync\s*\(",
    r"\bspawn\s*\(",
    r"\bspawnSync\s*\(",
)
JS_EXEC_MARKERS_SERVER = (r"\bchild_process\b", r"\bexec\s*\(", r"\bspawn\s*\(")
JS_NETWORK = r"\bfetch\s*\(|\baxios\b|\bhttp\.\w+"
JS_FILES = r"\bfs\.\w+"
JS_REQUIRE = r"require\s*\(\s*['\"]([^'\"]+)['\"]\s*\)"
ACTION_REF = r"\bAction\.([A-Z][A-Z0-9_]+)\b"
APP_REF = r"\bApp\.([A-Z][A-Z0-9_]+)\b"
URL_HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#]*@)?([^:/?#]*)"
PY_NETWORK_MODULES = ("httpx", "requests", "aiohttp", "urllib")
PY_FILE_MODULES = ("shutil",)
HIDDEN_MARK = "\ufeff"
HIDDEN_ZERO = "\u200b"

# --- registry rules (fixed values) -------------------------------------------

_EXFIL = ("data_exfiltration", "Potential data exfiltration pattern detected", CRITICAL)
_SYSTEM = ("privilege_escalation", "Dangerous system access pattern detected", CRITICAL)
_SECRETS = ("credential_harvesting", "Credential or secret access pattern detected", HIGH)
_BROAD = ("excessive_permissions", "Overly broad permission request detected", HIGH)


def _content(kind: tuple[str, str, int], pattern: str, *leads: str) -> Rule:
    attack_class, message, severity = kind
    return Rule(pattern, severity, attack_class, message, "i", leads)


CONTENT_RULES = (
    _content(
        _EXFIL, r"(requests\.post|httpx\.post|fetch\()\s*\(?\s*['\"]https?://", "requests.post", "httpx.post", "fetch("
    ),
    _content(
        _EXFIL,
        r"(webhook|exfil|phone[_\-]?home|beacon)",
        "webhook",
        "exfil",
        "phonehome",
        "phone_home",
        "phone-home",
        "beacon",
    ),
    _content(_EXFIL, r"base64\.(b64encode|encode)", "base64."),
    _content(_EXFIL, r"socket\.connect", "socket.connect"),
    _content(_SYSTEM, r"(sudo|chmod\s+[0-7]{3,4}|chown)\b", "sudo", "chmod", "chown"),
    _content(_SYSTEM, r"(os\.system|subprocess\.(run|call|Popen))", "os.system", "subprocess."),
    _content(_SYSTEM, r"exec\s*\(|eval\s*\(", "exec", "eval"),
    _content(_SYSTEM, r"__import__\s*\(", "__import__"),
    _content(
        _SECRETS,
        r"(API_KEY|SECRET|TOKEN|PASSWORD|CREDENTIAL)",
        "api_key",
        "secret",
        "token",
        "password",
        "credential",
    ),
    _content(_SECRETS, r"os\.environ\[", "os.environ["),
    _content(_SECRETS, r"\.(aws|gcp|azure).*credential", ".aws", ".gcp", ".azure"),
    _content(_SECRETS, r"keyring\.|keychain", "keyring.", "keychain"),
    _content(
        _BROAD,
        r"(full[_\s]?access|admin|root|superuser|all[_\s]?permissions)",
        "access",
        "admin",
        "root",
        "superuser",
        "permissions",
    ),
    _content(_BROAD, r"\*\.\*|/\*\*/\*", "*.*", "/**/*"),
    _content(_BROAD, r"(read|write|execute)\s*(,\s*(read|write|execute)){2,}+", "read", "write", "execute"),
)

SCRIPT_RULES = tuple(
    Rule(p, CRITICAL, "malicious_lifecycle_script", "Suspicious npm lifecycle script detected", "i")
    for p in (
        r"(preinstall|postinstall|preuninstall)\s*:",
        r"curl\s+.*\|\s*(sh|bash)",
        r"wget\s+.*&&\s*(sh|bash|chmod)",
        r"node\s+-e\s+['\"]",
    )
)

TYPOSQUAT_FRAGMENTS = (
    "offical",
    "0fficial",
    "orginal",
    "modlecontext",
    "mcpp-",
    "servr",
    "sever-",
    "claud-",
    "cladue",
    "openaai",
)
NO_AUTH_PHRASES = ("no authentication", "authentication not required", "open access", "unauthenticated")
VULNERABLE_SDK = {
    "0.1.0": "CVE-2026-25253 (RCE)",
    "0.1.1": "CVE-2026-25253 (RCE)",
    "0.2.0": "Session fixation vulnerability",
}
NPM_BLOCKLIST = ("mcp-server-malicious-test", "agent-skill-backdoor", "@fakemcp/server")
PYPI_BLOCKLIST = ("mcp-server-exploit", "langchain-malware", "agent-tool-backdoor")
SUSPICIOUS_DEPENDENCIES = ("pycryptoenv", "pycryptosys", "colorwin", "py-obfuscate", "stealer")
NPM_KEYWORDS = ("@modelcontextprotocol", "mcp-server", "agent-skill")
PYPI_KEYWORDS = ("mcp-server", "langchain-tool", "agent-tool", "crewai-tool")

# --- configuration files and node types (fixed values) -----------------------

MCP_CONFIG_FILES = (
    "mcp.json",
    "mcp_servers.json",
    "mcp_settings.json",
    "mcp_config.json",
    ".mcp.json",
    "claude_desktop_config.json",
)
MCP_SERVER_KEYS = ("mcpServers", "mcp", "servers")
N8N_PREFIX = "n8n-nodes-"
N8N_NODE_CAPABILITIES = {
    "n8n-nodes-base.code": "code_execution",
    "n8n-nodes-base.function": "code_execution",
    "n8n-nodes-base.functionItem": "code_execution",
    "n8n-nodes-base.executeCommand": "shell_access",
    "n8n-nodes-base.ssh": "shell_access",
    "n8n-nodes-base.httpRequest": "network_access",
    "n8n-nodes-base.webhook": "webhook_endpoint",
    "n8n-nodes-base.respondToWebhook": "webhook_endpoint",
    "n8n-nodes-base.postgres": "database_access",
    "n8n-nodes-base.mySql": "database_access",
    "n8n-nodes-base.mongoDb": "database_access",
    "n8n-nodes-base.redis": "database_access",
    "n8n-nodes-base.microsoftSql": "database_access",
}
FLOWISE_NODE_TYPES = (
    "ChatOpenAI",
    "ChatAnthropic",
    "ChatGoogleGenerativeAI",
    "ChatHuggingFace",
    "ChatLocalAI",
    "ChatOllama",
    "CustomTool",
    "ToolAgent",
    "ConversationChain",
    "ConversationalRetrievalQAChain",
    "RetrievalQAChain",
    "VectorStoreAgent",
    "OpenAIAssistant",
    "BufferMemory",
    "ConversationSummaryMemory",
    "ZepMemory",
    "RedisBackedChatMemory",
    "Pinecone",
    "Chroma",
    "Weaviate",
    "QdrantVectorStore",
    "SupabaseVectorStore",
    "OpenAIEmbedding",
    "HuggingFaceEmbedding",
    "CohereEmbedding",
    "PDFLoader",
    "CSVLoader",
    "WebBrowser",
    "SerpAPI",
    "Calculator",
    "RequestsGet",
    "RequestsPost",
)
FLOWISE_CREDENTIAL_INPUTS = (
    "openAIApiKey",
    "anthropicApiKey",
    "googleApiKey",
    "cohereApiKey",
    "huggingFaceApiKey",
    "pineconeApiKey",
    "weaviateApiKey",
    "qdrantApiKey",
    "supabaseApiKey",
    "serpApiKey",
    "zapierApiKey",
    "azureOpenAIApiKey",
    "awsAccessKeyId",
    "awsSecretAccessKey",
    "redisUrl",
    "zepApiKey",
    "apiKey",
)
DIFY_TYPES = ("tool", "model", "extension", "bundle")

# --- frameworks (fixed values) -----------------------------------------------

FRAMEWORKS = (
    "claude",
    "mcp_config",
    "mcp_server",
    "openclaw",
    "openai_agents",
    "google_adk",
    "langchain",
    "crewai",
    "autogen",
    "dify",
    "composio",
    "semantic_kernel",
    "llamaindex",
    "n8n",
    "flowise",
    "mastra",
    "pydanticai",
    "agno",
    "camel",
    "metagpt",
    "haystack",
    "anthropic_sdk",
)

# (format, path pattern, content pattern): a file belongs to a format when any of
# the format's rows fits both its path and its content ("" fits everything). Texts after the
# content pattern are its leads: whatever it matches holds one of them.
FRAMEWORK_MARKERS: tuple[tuple[str, ...], ...] = (
    ("claude", r"(^|/)\.claude/skills/[^/]*\.md$", ""),
    (
        "mcp",
        r"(^|/)(mcp\.json|mcp_servers\.json|mcp_settings\.json|mcp_config\.json|\.mcp\.json"
        r"|claude_desktop_config\.json)$",
        "",
    ),
    ("openclaw", r"(^|/)\.(claw|openclaw)/[^/]*\.ya?ml$", ""),
    ("mcp_server", r"\.py$", r"from\s+mcp\.server\s+import|from\s+mcp\s+import\s+Server", "mcp"),
    (
        "mcp_server",
        r"\.(ts|js)$",
        r"import\s+\{[^}]*Server[^}]*\}\s+from\s+[\"']@modelcontextprotocol/sdk"
        r"|require\s*\(\s*[\"']@modelcontextprotocol/sdk",
        "@modelcontextprotocol/sdk",
    ),
    (
        "openai_agents",
        r"\.py$",
        r"from agents import|from agents\.|from agents |import agents|from openai\.agents",
        "agents",
    ),
    ("google_adk", r"\.py$", r"from google\.adk|import google\.adk|from google import adk", "google"),
    (
        "langchain",
        r"\.py$",
        r"from langchain|import langchain|@tool\b|class\s+\w+\s*\(\s*BaseTool\s*\)",
        "langchain",
        "@tool",
        "BaseTool",
    ),
    ("crewai", r"\.py$", r"from crewai|import crewai", "crewai"),
    ("crewai", r"(^|/)(crew|agents)\.ya?ml$", ""),
    ("autogen", r"\.py$", r"from autogen|import autogen|from pyautogen|import pyautogen", "autogen"),
    ("dify", r"(^|/)\.dify/[^/]*\.(ya?ml|json)$", ""),
    ("dify", r"(^|/)(provider|tools)/[^/]*\.ya?ml$", r"(?i)\b(tool|provider)_?(type|name)?\s*:|\bidentity\s*:"),
    ("dify", r"(^|/)manifest\.(ya?ml|json)$", r"(?i)\btype[\"']?\s*:\s*[\"']?(tool|model|extension|bundle)\b"),
    ("composio", r"\.py$", r"from composio|import composio", "composio"),
    ("semantic_kernel", r"\.py$", r"from semantic_kernel|import semantic_kernel|@kernel_function", "semantic_kernel", "@kernel_function"),
    ("llamaindex", r"\.py$", r"from llama_index|import llama_index", "llama_index"),
    ("n8n", r"\.json$", r"\"type\"\s*:\s*\"n8n-nodes-", "n8n-nodes-"),
    ("flowise", r"\.json$", r"\"type\"\s*:\s*\"(?:" + "|".join(FLOWISE_NODE_TYPES) + r")\"", '"type"'),
    (
        "mastra",
        r"\.(ts|js|tsx|jsx)$",
        r"import\s+.*from\s+[\"']@mastra/core|require\s*\(\s*[\"']@mastra/core",
        "@mastra/core",
    ),
    ("pydanticai", r"\.py$", r"from pydantic_ai|import pydantic_ai", "pydantic_ai"),
    ("agno", r"\.py$", r"from agno|import agno|from phi|import phi", "agno", "from phi", "import phi"),
    ("camel", r"\.py$", r"from camel|import camel", "camel"),
    ("metagpt", r"\.py$", r"from metagpt|import metagpt", "metagpt"),
    ("haystack", r"\.py$", r"from haystack|import haystack", "haystack"),
    ("anthropic_sdk", r"\.py$", r"from claude_agent_sdk|import claude_agent_sdk", "claude_agent_sdk"),
)

CAMEL_TOOLKITS = {
    "SearchToolkit": ("network:read",),
    "CodeExecutionToolkit": ("code:execute", "filesystem:write"),
    "MathToolkit": ("compute",),
    "GoogleMapsToolkit": ("network:read", "location:read"),
    "WeatherToolkit": ("network:read",),
    "SlackToolkit": ("network:read", "network:write"),
    "TwitterToolkit": ("network:read", "network:write"),
    "GithubToolkit": ("network:read", "network:write"),
    "GoogleScholarToolkit": ("network:read",),
    "HuggingFaceToolkit": ("network:read", "compute"),
    "RetrievalToolkit": ("filesystem:read",),
    "DalleToolkit": ("network:read", "network:write"),
}
CAMEL_AGENTS = ("ChatAgent", "RolePlaying", "Workforce", "CriticAgent", "TaskSpecifyAgent", "EmbodiedAgent")
ADK_BUILTIN_TOOLS = ("google_search", "code_execution", "built_in_code_execution")
HAYSTACK_NAME_CAPABILITIES = (
    ("generator", "llm:generate"),
    ("openapi", "network:external_api"),
    ("connector", "network:external_api"),
    ("tool", "tool:invoke"),
    ("retriever", "data:retrieve"),
    ("converter", "data:convert"),
)

SHOWN_SERVER_TOOLS = 5
HOSTED_TOOLS = ("WebSearchTool", "FileSearchTool", "CodeInterpreterTool", "ComputerTool")
AGENT_SERVERS = ("MCPServerStdio", "MCPServerHTTP", "MCPServerSse", "MCPServerStreamableHttp")
INDEX_AGENTS = ("ReActAgent", "FunctionCallingAgent", "OpenAIAgent", "CustomSimpleAgentWorker")
INDEX_READERS = (
    "SimpleWebPageReader", "SimpleDirectoryReader", "DatabaseReader", "WikipediaReader", "BeautifulSoupWebReader",
    "TrafilaturaWebReader", "SlackReader", "DiscordReader", "GithubRepositoryReader", "GoogleDocsReader",
    "NotionPageReader", "S3Reader",
)
#: Script objects of one format: how one begins, the key that names it, and the key that describes it.
MASTRA_OBJECTS = {
    "tool": (r"createTool\s*+\(\s*+\{", "id", "description"),
    "agent": (r"new\s++Agent\s*+\(\s*+\{", "name", "instructions"),
}
MASTRA_LEADS = {"tool": "createTool", "agent": "Agent"}
AGNO_BUILTIN_IMPORTS = r"from\s++(?:agno|phi)\.tools\.\w++\s++import\s++([^\n]++)"

# --- trust (fixed values) ----------------------------------------------------

TRUST_SIGNALS = ("provenance", "behavioral", "community", "historical")
TRUST_WEIGHTS = {"provenance": 0.3, "behavioral": 0.3, "community": 0.2, "historical": 0.2}
TRUST_LEVELS = ((0.75, 3, "FORMALLY_VERIFIED"), (0.50, 2, "COMMUNITY_VERIFIED"), (0.25, 1, "SIGNED"))
TRUST_FLOOR = (0, "UNSIGNED")
DECAY_PER_DAY = 0.01
NEUTRAL_SIGNAL = 0.5
FINDING_PENALTY = {LOW: 0.05, MEDIUM: 0.10, HIGH: 0.20, CRITICAL: 0.35}

# --- threat model (fixed values) ---------------------------------------------

PHASES = {"INSTALL": 1, "LOAD": 2, "CONFIGURE": 3, "EXECUTE": 4, "PERSIST": 5}
ATTACK_PHASES = {
    "data_exfiltration": ("EXECUTE", "PERSIST"),
    "privilege_escalation": ("CONFIGURE", "EXECUTE"),
    "prompt_injection": ("LOAD", "CONFIGURE", "EXECUTE"),
    "dependency_confusion": ("INSTALL",),
    "typosquatting": ("INSTALL",),
    "namespace_squatting": ("INSTALL",),
}

# --- tool profiles for fleet inventory (fixed values) ------------------------


class ToolProfile(NamedTuple):
    """Where one developer tool keeps its configuration, relative to home."""

    name: str
    short_name: str
    dot_dir: str
    config_paths: tuple[str, ...] = ()
    skill_paths: tuple[str, ...] = ()
    platform: str = "all"


TOOL_PROFILES = (
    ToolProfile("Claude Code", "claude", ".claude", (".claude/mcp_servers.json",), (".claude/skills",)),
    ToolProfile("Cursor", "cursor", ".cursor", (".cursor/mcp.json", ".cursor/mcp_settings.json")),
    ToolProfile(
        "VS Code", "vscode", ".vscode", ("Library/Application Support/Code/User/mcp.json",), (), "macos"
    ),
    ToolProfile("VS Code (Linux)", "vscode-linux", ".vscode", (".config/Code/User/mcp.json",), (), "linux"),
    ToolProfile("Windsurf/Codeium", "windsurf", ".codeium", (".codeium/windsurf/mcp_config.json",)),
    ToolProfile("Gemini CLI", "gemini", ".gemini", (".gemini/settings.json",)),
    ToolProfile("OpenCode", "opencode", ".opencode", (".opencode/mcp.json",)),
    ToolProfile("Cline", "cline", ".cline", (".cline/mcp_settings.json",)),
    ToolProfile("Continue", "continue", ".continue", (".continue/config.json",)),
    ToolProfile("GitHub Copilot", "copilot", ".copilot"),
    ToolProfile("n8n", "n8n", ".n8n"),
    ToolProfile("Roo Code", "roo", ".roo", (".roo/mcp.json",)),
    ToolProfile("Trae", "trae", ".trae"),
    ToolProfile("Kiro", "kiro", ".kiro"),
    ToolProfile("Kode", "kode", ".kode"),
    ToolProfile("Jules", "jules", ".jules"),
    ToolProfile("Junie", "junie", ".junie"),
    ToolProfile("Codex CLI", "codex", ".codex"),
    ToolProfile("SuperVS", "supervs", ".supervs"),
    ToolProfile("Zencoder", "zencoder", ".zencoder"),
    ToolProfile("CommandCode", "commandcode", ".commandcode"),
    ToolProfile("Factory", "factory", ".factory"),
    ToolProfile("Qoder", "qoder", ".qoder"),
)
FLEET_CONFIG_FILES = ("mcp.json", "mcp_config.json", "mcp_settings.json", "mcp_servers.json")
