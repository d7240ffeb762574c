"""Definitions in framework source files: what each one is called, says, may do, and its own text.

A definition's text is cut out by the pattern that finds it. A function or class takes the
lines below its head that are indented deeper, blank lines and comments only where such a
line follows; brackets of the head and triple-quoted strings may span lines of any indent.
A call takes the text up to its closing bracket, strings skipped. The text is captured by
looking ahead, so a definition inside another one is found as well.

Every repeat that holds a group is possessive, and none runs past the next place where its
pattern could begin: matching is linear in the file, and no text makes it recurse.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from wardline.functions import catalog as C
from wardline.functions import text as X

DEFINITION = (
    "array<struct<format:string,kind:string,name:string,description:string,capabilities:array<string>,body:string>>"
)

# --- parts of patterns --------------------------------------------------------

_TRIPLE = r"\"\"\"(?:[^\"]++|\"(?!\"\"))*+\"\"\"|'''(?:[^']++|'(?!''))*+'''"
_STRING = rf"{_TRIPLE}|\"(?:[^\"\\\n]++|\\.)*+\"|'(?:[^'\\\n]++|\\.)*+'"
_LINE = rf"(?:[^\n\"']++|{_TRIPLE}|[\"'])*+"


def inside(depth: int) -> str:
    """What may stand between two brackets that close, with ``depth`` levels of further ones."""
    nested = rf"|\({inside(depth - 1)}\)" if depth else ""
    return rf"(?:[^()\"']++|{_STRING}|[\"']{nested})*+"


_SKIPPED = r"(?:\n[^\S\n]*+(?:#[^\n]*+)?+(?=\n|\z))*+"
_BLOCK = rf"(?:{_SKIPPED}\n\k<indent>[ \t]++(?=[^\s#]){_LINE})*+"
_HEAD = rf"\s*+(?:\({inside(3)}\)?+)?+{_LINE}"
_DEF = rf"(?:async\s++)?+def\s++\w++{_HEAD}{_BLOCK}"
_CLASS = rf"class\s++\w++{_HEAD}{_BLOCK}"
ANY_FUNCTION = rf"(?<![^\n])(?<indent>[^\S\n]*+)(?=({_DEF}))(?:async|def)\b"


ANY_CLASS = rf"(?<![^\n])(?<indent>[^\S\n]*+)(?=({_CLASS}))class\b"


def decorated(marker: str) -> str:
    """Functions under a decorator; further decorators may stand between. Group 1 is decorator and function."""
    # a decorator's line ends where another one of the kind begins
    line = rf"(?:[^\n@]++|(?!{marker})@)*+\n"
    further = rf"(?:[^\S\n]*+(?!{marker})@[\w.]++(?:\({inside(2)}\))?+{line})*+"
    blank = r"(?:[^\S\n]*+\n)*+"
    own = rf"{marker}(?:\s*+\({inside(3)}\))?+{line}{further}{blank}(?<indent>[^\S\n]*+){_DEF}"
    return rf"(?=({own})){marker}"


def subclass(base: str) -> str:
    """Classes with a base. Group 2 is the class."""
    bases = rf"(?:(?!\b(?:{base})\b)[^()]|\([^()]*+\))*+\b(?:{base})\b"
    return rf"(?<![^\n])(?<indent>[^\S\n]*+)(?=class\s++\w++\s*+\({bases})(?=({_CLASS}))class\b"


def call(callee: str) -> str:
    """Calls. Group 1 is the call with its brackets."""
    return rf"(?=({callee}\s*+\({inside(4)}\)?+)){callee}\s*+\("


def _until(key: str, value: str) -> str:
    """The beginning of a call up to the value of a keyword of its own."""
    given = rf"\b{key}\s*+=\s*+{value}"
    return rf"\A[^(]*+\((?:(?!{given})(?:{_STRING}|[^()])|\({inside(3)}\))*+{given}"


_QUOTED = r"(?<quote>\"\"\"|'''|\"|')((?:(?!\k<quote>)[\s\S])*+)\k<quote>"

# --- reading a definition's text ----------------------------------------------


def _cut(text: Column, pattern: str, group: int = 1, flags: str = "") -> Column:
    return F.regexp_extract(text, X.rx(pattern, flags), group)


def keyword(text: Column, key: str, some: str = "+") -> Column:
    """String value of a call's keyword; empty when it has none."""
    return _cut(text, _until(key, rf"[\"']([^\"']{some})[\"']"))


def keyword_present(text: Column, key: str, value: str = "") -> Column:
    return X.matches(text, _until(key, value))


def listed_names(text: Column, key: str) -> Column:
    """Last names of the list a keyword holds: ``[a, b.c, D(1)]`` gives ``a, c, D``."""
    inner = _cut(text, _until(key, rf"\[((?:[^\[\]()\"']++|{_STRING}|\({inside(2)}\))*+)"))
    plain = F.split(F.regexp_replace(inner, X.rx(rf"\({inside(2)}\)|{_STRING}"), ""), ",")
    return F.filter(F.transform(plain, lambda n: _cut(n, r"(\w++)\s*+\z")), lambda n: n != "")


def decorator(text: Column) -> Column:
    """The call of the decorator a definition's text begins with; empty when it has no brackets."""
    return _cut(text, rf"\A@[\w.]++\s*+\({inside(3)}\)", 0)


def own_text(text: Column) -> Column:
    """A function without its decorators."""
    return _or(_cut(text, r"\A@[\s\S]*?\n[^\S\n]*+((?:async\s++)?+def\s[\s\S]*+)"), text)


def function_name(text: Column) -> Column:
    return _cut(text, r"\A(?:async\s++)?+def\s++(\w++)")


def class_name(text: Column) -> Column:
    return _cut(text, r"\Aclass\s++(\w++)")


def clean_doc(text: Column) -> Column:
    """A docstring without the margin its lines share, stripped."""
    lines = F.split(text, "\n")
    rest = F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0)))
    margins = F.transform(F.filter(rest, lambda r: F.trim(r) != ""), lambda r: F.length(r) - F.length(F.ltrim(r)))
    margin = F.coalesce(F.array_min(margins), F.lit(0))
    moved = F.transform(rest, lambda r: F.substr(r, margin + 1))
    return X.strip(F.array_join(F.concat(F.slice(lines, 1, 1), moved), "\n"))


def docstring(text: Column) -> Column:
    return clean_doc(_cut(text, rf"\A(?:async\s++)?+def\s++\w++\s*+\({inside(3)}\)[^\n:]*+:\s*+{_QUOTED}", 2))


def class_value(text: Column, attribute: str) -> Column:
    """String that a class gives to an attribute on its first level; empty when it does not."""
    level = _cut(text, rf"\Aclass\s++\w++{_HEAD}{_SKIPPED}\n([ \t]++)")
    value = rf"\A[ \t]*+{attribute}\s*+(?::[^=\n]++)?+=\s*+(?:\"\"\"|'''|[\"'])([^\"'\n]*+)[\"']"
    own = F.filter(F.split(text, "\n"), lambda line: line.startswith(F.concat(level, F.lit(attribute))) & X.matches(line, value))
    return F.when(level == "", "").otherwise(F.coalesce(_cut(F.get(own, F.lit(0)), value), F.lit("")))


def _or(first: Column, second: Column) -> Column:
    return F.when(first == "", second).otherwise(first)


def _given(condition: Column, value: str | Column) -> Column:
    return F.when(condition, F.lit(value) if isinstance(value, str) else value)


def _prefixed(prefix: str, names: Column) -> Column:
    return F.transform(names, lambda n: F.concat(F.lit(prefix), n))


def references(names: Column, builtins: Column) -> Column:
    """``builtin:x`` for names among the built-in ones, ``tool:x`` for the rest."""
    return F.transform(names, lambda n: F.concat(F.when(F.array_contains(builtins, n), "builtin:").otherwise("tool:"), n))


# --- kinds of definitions -----------------------------------------------------

Reader = Callable[[Column], Column]
_NO_TEXT: Reader = lambda text: F.lit("")
_NONE: Reader = lambda text: F.array().cast("array<string>")


class Kind(NamedTuple):
    """One kind of definition: a pattern, the group with its text, and how that text is read.

    Every match of the pattern holds one of the ``leads``. ``scans_body`` tells whether URLs, variables and commands come from the definition's own
    text alone or from its whole file. A definition without a name is none.
    """

    format: str
    kind: str
    pattern: str
    group: int
    name: Reader
    leads: tuple[str, ...]
    description: Reader = _NO_TEXT
    capabilities: Reader = _NONE
    scans_body: bool = True
    body: Reader = lambda text: text


def _function(format: str, kind: str, marker: str, *leads: str, **more) -> Kind:
    readers = {"name": lambda t: function_name(own_text(t)), "description": lambda t: docstring(own_text(t))}
    return Kind(format, kind, decorated(marker), 1, leads=leads, body=own_text, **readers | more)


def _class(format: str, kind: str, base: str, name: Reader, **more) -> Kind:
    return Kind(format, kind, subclass(base), 2, name, (base,), **more)


def _call(format: str, kind: str, callee: str, lead: str, name: Reader, **more) -> Kind:
    return Kind(format, kind, call(callee), 1, name, (lead,), **more)


def _fixed(value: str) -> Reader:
    return lambda text: F.lit(value)


def _named_or(default: str) -> Reader:
    return lambda text: _or(keyword(text, "name"), F.lit(default))


def _callee(text: Column) -> Column:
    return _cut(text, r"\A(\w++)")


def _own_class(text: Column) -> Column:
    return _or(class_value(text, "name"), class_name(text))


def _agent_caps(text: Column) -> Column:
    model = keyword(text, "model")
    return F.array_compact(
        F.array(
            _given(keyword_present(text, "handoffs", r"\["), "agent_handoff"),
            _given(keyword_present(text, "mcp_servers"), "mcp_access"),
            _given(keyword_present(text, "input_guardrails"), "input_guardrail"),
            _given(keyword_present(text, "output_guardrails"), "output_guardrail"),
            _given(model != "", F.concat(F.lit("model:"), model)),
        )
    )


def _adk_agent(text: Column) -> Column:
    model = F.concat(F.lit("Google ADK agent (model="), keyword(text, "model"), F.lit(")"))
    return _or(keyword(text, "instruction"), model)


def _server_parameters(text: Column) -> Column:
    """Values of ``command`` and ``args`` anywhere in a call, as keywords or dictionary entries."""
    given = X.find_all(text, r"\b(?:command|args)[\"']?+\s*+[=:]\s*+(\[[^\]]*+\]|[\"'][^\"'\n]*+[\"'])", 1)
    return F.filter(F.flatten(F.transform(given, lambda g: X.find_all(g, r"[\"']([^\"'\n]*+)[\"']", 1))), lambda v: v != "")


def _first_argument(text: Column) -> Column:
    return _cut(text, r"\A[^(]*+\(\s*+(\w++)\s*+[,)]")


def _index_function(text: Column) -> Column:
    return _or(_cut(text, _until("fn", r"(\w++)")), _first_argument(text))


def _index_tools(text: Column) -> Column:
    first = F.split(F.regexp_replace(_cut(text, r"\A[^(]*+\(\s*+\[([^\[\]]*+)"), X.rx(rf"\({inside(2)}\)"), ""), ",")
    plain = F.filter(F.transform(first, lambda n: _cut(n, r"(\w++)\s*+\z")), lambda n: n != "")
    named = listed_names(text, "tools")
    return F.when(F.size(named) > 0, named).otherwise(plain)


def _metadata(text: Column, key: str) -> Column:
    return keyword(_cut(text, rf"\bmetadata\s*+=\s*+([\w.]++\({inside(2)}\))"), key)


def _component(text: Column) -> Column:
    pattern = r"\A[^(]*+\(\s*+(?:name\s*+=\s*+)?+[\"'][^\"']*+[\"']\s*+,\s*+(?:instance\s*+=\s*+)?+(?:\w++\.)*+(\w++)"
    return _cut(text, pattern)


def component_capabilities(component: Column) -> Column:
    """Capabilities suggested by words inside a pipeline component's class name."""
    low = F.lower(component)
    hits = [F.when(low.contains(word), F.lit(cap)) for word, cap in C.HAYSTACK_NAME_CAPABILITIES]
    return F.array_distinct(F.array_compact(F.array(*hits)))


def _agno_instructions(text: Column) -> Column:
    listed = X.find_all(_cut(text, _until("instructions", r"\[([^\[\]]*+)")), r"[\"']([^\"']*+)[\"']", 1)
    model = keyword(text, "model")
    shown = F.when(model == "", "").otherwise(F.concat(F.lit("Agno agent (model="), model, F.lit(")")))
    return F.when(F.size(listed) > 0, F.array_join(listed, "; ")).otherwise(_or(keyword(text, "instructions"), shown))


def _registered(text: Column) -> Column:
    return _prefixed("function:", X.find_all(text, r"\.register\s*+\(\s*+(?:\w++\.)?+Function\s*+\([^()]*?\bname\s*+=\s*+[\"']([^\"']++)[\"']", 1))


def _model(text: Column) -> Column:
    return _or(_cut(text, r"\A\w++\s*+\(\s*+[\"']([^\"']++)[\"']\s*+[,)]"), keyword(text, "model"))


def _shown(label: str, value: Column, mark: str = "=") -> Column:
    return F.when(value == "", "").otherwise(F.concat(F.lit(label + mark), value))


def _present(*values: Column) -> Column:
    return F.filter(F.array(*values), lambda v: v != "")


def _joined(*values: Column) -> Column:
    return F.array_join(_present(*values), "; ")


def _role(text: Column) -> Column:
    said = _joined(*[_shown(k, class_value(text, k)) for k in ("profile", "goal")])
    return X.strip(F.concat(F.lit("[Role] "), said))


def _class_docstring(text: Column) -> Column:
    return clean_doc(_cut(text, rf"\Aclass\s++\w++\s*+(?:\({inside(2)}\))?+\s*+:\s*+{_QUOTED}", 2))


_SERVER = "(?:" + "|".join(C.AGENT_SERVERS) + ")"
_READERS = "(?:" + "|".join(C.INDEX_READERS) + ")"
_INDEX_AGENT = "(?:" + "|".join(C.INDEX_AGENTS) + ")"

KINDS: tuple[Kind, ...] = (
    _function("openai_agents", "function_tool", r"@(?:\w+\.)?function_tool\b", "function_tool"),
    _call(
        "openai_agents", "agent", r"\bAgent", "Agent", lambda t: keyword(t, "name"),
        description=lambda t: keyword(t, "handoff_description"), capabilities=_agent_caps,
    ),
    _call(
        "openai_agents", "mcp_server", rf"\b{_SERVER}", "MCPServer",
        lambda t: _or(_or(keyword(t, "command"), keyword(t, "url")), _callee(t)),
        description=lambda t: F.concat(F.lit("MCP server connection via "), _callee(t)),
        capabilities=lambda t: F.array(F.concat(F.lit("mcp:"), _callee(t))),
    ),
    *[
        Kind(
            "openai_agents", "hosted_tool",
            rf"(?<![^\n])[^\S\n]*+from[^\S\n]++[\w.]++[^\S\n]++import[^\S\n]++(?:\((?:(?!\b(?:{n}|import)\b)[^()])*+|[^\n(]*?)\b({n})\b",
            1, _fixed(n), (n,), _fixed(f"OpenAI hosted tool: {n}"), lambda t, n=n: F.array(F.lit(f"hosted:{n}")),
        )
        for n in C.HOSTED_TOOLS
    ],
    _call(
        "google_adk", "agent", "Agent", "Agent", _named_or("unnamed_agent"), description=_adk_agent,
        capabilities=lambda t: references(listed_names(t, "tools"), X.literals(C.ADK_BUILTIN_TOOLS)),
    ),
    Kind(
        "google_adk", "callback", r"\b((?:before|after)_(?:agent|model|tool)_callback\s*+=\s*+\w++)", 1,
        lambda t: _cut(t, r"(\w++)\z"), ("_callback",),
    ),
    _call(
        "google_adk", "mcp_toolset", r"\bMCPToolset", "MCPToolset", _fixed("MCPToolset"),
        description=lambda t: F.concat(F.lit("MCP connection: "), F.array_join(_server_parameters(t), " ")),
        capabilities=lambda t: _prefixed("mcp:", _server_parameters(t)),
    ),
    _call(
        "google_adk", "openapi_toolset", r"\bOpenAPIToolset", "OpenAPIToolset", _fixed("OpenAPIToolset"),
        description=lambda t: F.concat(
            F.lit("OpenAPI toolset (spec_type="), _or(keyword(t, "spec_str_type"), F.lit("unknown")), F.lit(")")
        ),
        capabilities=lambda t: F.array(F.lit("openapi:external_api")),
    ),
    *[
        kind
        for format in ("langchain", "crewai")
        for kind in (
            _class(format, "class", "BaseTool", _own_class, description=lambda t: class_value(t, "description")),
            _function(format, "function", r"@(?:\w+\.)?tool\b", "@tool", ".tool"),
        )
    ],
    _function("autogen", "function", r"@\w+\.register_for_llm\b", ".register_for_llm"),
    Kind(
        "autogen", "schema",
        r"([\"']type[\"']\s*+:\s*+[\"']function[\"']\s*+,\s*+[\"']function[\"']\s*+:\s*+\{\s*+[\"']name[\"']\s*+:\s*+[\"'][^\"']++[\"'])",
        1, lambda t: _cut(t, r"[\"']([^\"']++)[\"']\z"), ("function",),
    ),
    _function(
        "composio", "action", r"@(?:\w+\.)?action\b", "@action", ".action",
        name=lambda t: _or(keyword(decorator(t), "toolname"), function_name(own_text(t))),
    ),
    _call(
        "llamaindex", "function_tool", r"\bFunctionTool\.from_defaults", "FunctionTool.from_defaults",
        lambda t: _or(_or(keyword(t, "name"), _index_function(t)), F.lit("unnamed_function_tool")),
        description=lambda t: keyword(t, "description"),
        capabilities=lambda t: _prefixed("tool:", F.filter(F.array(_index_function(t)), lambda n: n != "")),
        scans_body=False,
    ),
    _call(
        "llamaindex", "query_engine_tool", r"\bQueryEngineTool", "QueryEngineTool",
        lambda t: _or(_metadata(t, "name"), F.lit("unnamed_query_tool")), description=lambda t: _metadata(t, "description"),
        capabilities=lambda t: F.array(F.lit("query_engine:read")), scans_body=False,
    ),
    _call(
        "llamaindex", "agent", rf"\b{_INDEX_AGENT}\.from_tools", ".from_tools", _callee,
        description=lambda t: F.concat(F.lit("LlamaIndex "), _callee(t), F.lit(" agent")),
        capabilities=lambda t: _prefixed("tool:", _index_tools(t)), scans_body=False,
    ),
    _call(
        "llamaindex", "reader", rf"\b{_READERS}", "Reader", _callee,
        description=lambda t: F.concat(F.lit("Data connector: "), _callee(t)),
        capabilities=lambda t: _prefixed("reader:", F.array(_callee(t))), scans_body=False,
    ),
    _call(
        "pydanticai", "agent", r"\bAgent", "Agent",
        lambda t: F.when(_model(t) == "", "unnamed_agent").otherwise(F.concat(F.lit("agent_"), F.translate(_model(t), ":", "_"))),
        description=lambda t: _or(
            _joined(keyword(t, "system_prompt"), _shown("model", _model(t)), _shown("deps_type", keyword(t, "deps_type"))),
            F.lit("PydanticAI Agent"),
        ),
        capabilities=lambda t: F.concat(_present(_shown("model", _model(t), ":")), _prefixed("mcp_server:", listed_names(t, "mcp_servers"))),
    ),
    _function(
        "pydanticai", "function", r"@\w+\.(?:tool_plain|tool)\b", ".tool",
        capabilities=lambda t: _prefixed("decorator:", F.array(_cut(t, r"\A@\w+\.(\w+)"))),
    ),
    # what its tools may do depends on the file's imports: see frameworks.py
    _call("agno", "agent", r"\bAgent", "Agent", _named_or("unnamed_agent"), description=_agno_instructions),
    _class("agno", "toolkit", "Toolkit", class_name, capabilities=_registered),
    _call("camel", "function_tool", r"\bFunctionTool", "FunctionTool", lambda t: _cut(t, r"\A\w++\s*+\(\s*+(?:func\s*+=\s*+)?+(\w++)"), scans_body=False),
    _class("metagpt", "class", "Role", _own_class, description=_role),
    _class("metagpt", "class", "Action", _own_class, description=_fixed("[Action]")),
    _function(
        "metagpt", "function", r"@(?:\w+\.)?register_tool\b", "register_tool",
        description=lambda t: X.strip(F.concat(F.lit("[Tool] "), docstring(own_text(t)))),
    ),
    _call(
        "haystack", "component", r"\.add_component", ".add_component", lambda t: _cut(t, r"\A[^(]*+\(\s*+(?:name\s*+=\s*+)?+[\"']([^\"']++)[\"']"),
        description=lambda t: F.concat(F.lit("Haystack component: "), _component(t)),
        capabilities=lambda t: component_capabilities(_component(t)),
    ),
    _function("anthropic_sdk", "function", r"@(?:\w+\.)?tool\b", "@tool", ".tool"),
    _call(
        "anthropic_sdk", "agent", r"\bAgent", "Agent", lambda t: keyword(t, "name"),
        description=lambda t: _or(
            keyword(t, "instructions"), F.concat(F.lit("Anthropic SDK agent (model="), keyword(t, "model"), F.lit(")"))
        ),
        capabilities=lambda t: F.concat(
            _present(_shown("model", keyword(t, "model"), ":")),
            F.array_compact(F.array(_given(keyword_present(t, "hooks"), "lifecycle_hooks"))),
            _prefixed("tool:", listed_names(t, "tools")),
        ),
    ),
    _call(
        "anthropic_sdk", "mcp_server", r"\bMCPServer", "MCPServer", lambda t: _or(keyword(t, "command"), F.lit("MCPServer")),
        description=lambda t: F.concat(F.lit("MCP server connection via MCPServer (command="), keyword(t, "command"), F.lit(")")),
        capabilities=lambda t: F.array(F.concat(F.lit("mcp:"), _or(keyword(t, "command"), F.lit("unknown")))),
    ),
    _class(
        "anthropic_sdk", "hook", "Hook", class_name, description=_class_docstring,
        capabilities=lambda t: _prefixed("hook:", F.array_remove(X.find_all(t, r"\bdef\s++(\w++)", 1), "__init__")),
    ),
    Kind(
        "anthropic_sdk", "agent", rf"[\"'](?=([\w-]++[\"']\s*+:\s*+AgentDefinition\s*+\({inside(4)}\)?+))", 1,
        lambda t: _cut(t, r"\A([\w-]++)"), ("AgentDefinition",),
    ),
    _call(
        "anthropic_sdk", "mcp_server", r"\bcreate_sdk_mcp_server", "create_sdk_mcp_server",
        lambda t: _cut(t, r"\A\w++\s*+\(\s*+(?:name\s*+=\s*+)?+[\"']([^\"']++)[\"']"),
    ),
    _call("anthropic_sdk", "hook", r"\bHookMatcher", "HookMatcher", _fixed("hook")),
    _function("mcp_server", "tool", r"@\w+\.tool\b", ".tool", scans_body=False),
    Kind("mcp_server", "tool", r"(?<![@\w.])\w++\.tool\s*+\(\s*+[\"']([^\"']++)[\"']", 1, lambda t: t, (".tool",), scans_body=False),
)


def record(
    format: str, kind: str, name: Column, description: Column, capabilities: Column | None = None, body: Column | None = None
) -> Column:
    return F.struct(
        F.lit(format).alias("format"),
        F.lit(kind).alias("kind"),
        name.alias("name"),
        description.alias("description"),
        (_NONE(name) if capabilities is None else capabilities).alias("capabilities"),
        (F.lit("") if body is None else body).alias("body"),
    )


def read(kind: Kind, content: Column) -> Column:
    """Definitions of one kind in a file, in text order."""
    found = F.transform(
        X.find_all(content, kind.pattern, kind.group, leads=kind.leads),
        lambda t: record(
            kind.format, kind.kind, kind.name(t), kind.description(t), kind.capabilities(t), F.rtrim(kind.body(t))
        ),
    )
    return F.filter(found, lambda d: d["name"] != "")


def plugin_functions(content: Column) -> Column:
    """Kernel functions of the file's classes; the class stands in front of what they say."""

    def of_class(text: Column) -> Column:
        def entry(t: Column) -> Column:
            own = own_text(t)
            said = _or(keyword(decorator(t), "description"), docstring(own))
            shown = F.concat(F.lit("["), class_name(text), F.lit("] "), said)
            return record("semantic_kernel", "function", function_name(own), shown, None, F.rtrim(own))

        return F.transform(X.find_all(text, decorated(r"@(?:\w+\.)?kernel_function\b"), 1), entry)

    return F.flatten(F.transform(X.find_all(content, ANY_CLASS, 2, leads=("kernel_function",)), of_class))


def functions_named(format: str, kind: str, content: Column, names: Column) -> Column:
    """Functions of a file that are among some names."""
    named = F.when(F.size(names) > 0, X.find_all(content, ANY_FUNCTION, 2)).otherwise(F.array().cast("array<string>"))
    own = F.filter(named, lambda t: F.array_contains(names, function_name(t)))
    return F.transform(own, lambda t: record(format, kind, function_name(t), docstring(t), None, F.rtrim(t)))


def imported_names(content: Column, pattern: str, *leads: str) -> Column:
    """Names of the import lists that a pattern's first group gives."""
    lists = F.flatten(F.transform(X.find_all(content, pattern, 1, leads=leads), lambda names: F.split(names, ",")))
    return F.filter(F.transform(lists, lambda n: _cut(n, r"\A\s*+(\w++)")), lambda n: n != "")


def scanned_whole() -> Sequence[str]:
    """``format:kind`` of the definitions whose file is scanned instead of their own text."""
    return sorted({f"{k.format}:{k.kind}" for k in KINDS if not k.scans_body})
