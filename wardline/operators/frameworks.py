"""Which agent framework a source file uses, what it defines and what it can do.

Works on a ``seq, path, content`` table. Detection and extraction are regular
expressions over the whole file; what a definition looks like and where its own
text ends stands in ``functions/definitions.py``.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.functions import catalog as C
from wardline.functions import definitions as D
from wardline.functions import text as X
from wardline.plans.shape import unnest, unnest_values
from wardline.schemas import as_skills


def formats(path: Column, content: Column, head_chars: int | None = None) -> Column:
    """Array of the formats a file belongs to.

    The path is tested first, so a file's content is only searched for formats
    its name allows, by a rule of which a lead stands in it. ``head_chars`` limits the
    search to the file's beginning.
    """
    text = content if head_chars is None else F.substring(content, 1, head_chars)
    by_format: dict[str, Column] = {}
    for name, path_rule, content_rule, *leads in C.FRAMEWORK_MARKERS:
        fits = path.rlike(path_rule)
        if leads:
            fits = fits & X.any_of(text, leads)
        if content_rule:
            fits = fits & X.matches(text, content_rule)
        by_format[name] = by_format[name] | fits if name in by_format else fits
    return F.array_compact(F.array(*[F.when(fits, F.lit(name)) for name, fits in by_format.items()]))


def detect(files: DataFrame, head_chars: int | None = None) -> DataFrame:
    """``seq, path, format``: one row per format a file belongs to."""
    return unnest_values(files, formats(F.col("path"), F.col("content"), head_chars), ["seq", "path"], "format")


def _mastra_values(content: Column, kind: str, key: str) -> Column:
    """Value of a key in each object of a kind, up to the first closing brace."""
    begin = C.MASTRA_OBJECTS[kind][0]
    given = rf"{key}\s*+:\s*+[\"']"
    return X.find_all(content, rf"{begin}(?:(?!{given}|{begin})[^}}])*+{given}([^\"']++)[\"']", 1, leads=(C.MASTRA_LEADS[kind],))


def _mastra(content: Column, kind: str) -> Column:
    """Names paired by position with texts; a repeated name takes its last paired text."""
    _, name_key, text_key = C.MASTRA_OBJECTS[kind]
    names, texts = _mastra_values(content, kind, name_key), _mastra_values(content, kind, text_key)
    paired = F.least(F.size(names), F.size(texts))

    def entry(name: Column) -> Column:
        same = F.filter(F.sequence(F.lit(1), F.greatest(paired, F.lit(1))), lambda i: (i <= paired) & (F.get(names, i - 1) == name))
        found = F.coalesce(F.get(texts, F.array_max(same) - 1), F.lit(""))
        if kind == "agent":
            short = F.concat(F.lit("Mastra agent: "), F.substring(found, 1, 80))
            found = F.when(found != "", short).otherwise("")
        return D.record("mastra", kind, name, found)

    return F.transform(names, entry)


def _adk_functions(content: Column) -> Column:
    """Functions of the file that an agent's tools or a function tool name."""
    listed = F.array_join(X.find_all(content, r"\btools\s*+=\s*+\[((?:(?!\btools\s*+=)[^\]])*+)\]", 1, leads=("tools",)), " ")
    wrapped = X.find_all(content, r"\bFunctionTool\s*+\(\s*+(?:func\s*+=\s*+)?+(\w++)", 1, leads=("FunctionTool",))
    names = F.array_except(F.concat(F.split(listed, r"\W+"), wrapped), X.literals([*C.ADK_BUILTIN_TOOLS, ""]))
    return X.once(names, lambda n: D.functions_named("google_adk", "function_tool", content, n))


def _haystack_tools(content: Column) -> Column:
    """Functions made into tools; one that is not in the file is known by its name alone."""
    maker = "create_tool_from_function"
    made = F.array_distinct(X.find_all(content, rf"{maker}\s*+\(\s*+(?:function\s*+=\s*+)?+(\w++)", 1, leads=(maker,)))

    def with_absent(names: Column, own: Column) -> Column:
        absent = F.array_except(names, F.transform(own, lambda d: d["name"]))
        return F.concat(own, F.transform(absent, lambda n: D.record("haystack", "tool", n, F.lit(""))))

    return X.once(made, lambda names: X.once(D.functions_named("haystack", "tool", content, names), lambda own: with_absent(names, own)))


def _agno_tools(definitions: Column, content: Column) -> Column:
    """An agent's tools as capabilities: built-in where the file imports them from the kit."""
    def known(builtins: Column) -> Column:
        return F.transform(
            definitions,
            lambda d: F.when(
                d["kind"] == "agent",
                d.withField("capabilities", D.references(D.listed_names(d["body"], "tools"), builtins)),
            ).otherwise(d),
        )

    return X.once(D.imported_names(content, C.AGNO_BUILTIN_IMPORTS, "agno.tools", "phi.tools"), known)


def file_stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1)


def _with_server(found: Column, path: Column) -> Column:
    """A server file's tools, and the file itself as one definition that lists them."""

    def listed(tools: Column) -> Column:
        names = F.array_join(F.transform(F.slice(tools, 1, C.SHOWN_SERVER_TOOLS), lambda d: d["name"]), ", ")
        about = F.concat(F.lit("MCP server ("), F.size(tools).cast("string"), F.lit(" tools): "), names)
        return F.concat(tools, F.array(D.record("mcp_server", "server", file_stem(path), about)))

    return X.once(found, listed)


def _composio_module(content: Column, path: Column) -> Column:
    """A module that only refers to actions or applications."""
    action = next(k for k in D.KINDS if k.format == "composio")
    bare = ~(X.any_of(content, action.leads) & X.matches(content, action.pattern)) & (F.size(X.action_refs(content)) > 0)
    return F.filter(F.array(D.record("composio", "module", file_stem(path), F.lit(""))), lambda _: bare)


def _camel_words(content: Column) -> Column:
    hits = []
    for kind, names in (("toolkit", tuple(C.CAMEL_TOOLKITS)), ("agent", C.CAMEL_AGENTS)):
        for n in names:
            own = D.record("camel", kind, F.lit(n), F.lit(f"CAMEL-AI {n}"))
            hits.append(F.when(X.any_of(content, (n,)) & X.matches(content, rf"\b{n}\s*\("), own))
    return F.array_compact(F.array(*hits))


def definitions_column(content: Column, present: Column, path: Column) -> Column:
    """Array of definitions for the formats in ``present``; others are not searched for."""
    of_format: dict[str, list[Column]] = {}
    for kind in D.KINDS:
        of_format.setdefault(kind.format, []).append(D.read(kind, content))
    of_format["agno"] = [_agno_tools(found, content) for found in of_format["agno"]]
    of_format["mastra"] = [_mastra(content, "tool"), _mastra(content, "agent")]
    of_format["semantic_kernel"] = [D.plugin_functions(content)]
    of_format["google_adk"].append(_adk_functions(content))
    of_format["haystack"].append(_haystack_tools(content))
    of_format["mcp_server"] = [_with_server(F.concat(*of_format["mcp_server"]), path)]
    of_format["composio"].append(_composio_module(content, path))
    of_format["camel"].append(_camel_words(content))
    none = F.array().cast(D.DEFINITION)
    parts = [
        F.when(F.array_contains(present, format), F.concat(*[f.cast(D.DEFINITION) for f in found])).otherwise(none)
        for format, found in of_format.items()
    ]
    return F.concat(*parts)


def definitions(files: DataFrame) -> DataFrame:
    """``seq, path, format, kind, name, description``: one row per tool, agent or class."""
    known = files.select("seq", "path", "content", formats(F.col("path"), F.col("content")).alias("formats"))
    found = known.select("seq", "path", definitions_column(F.col("content"), F.col("formats"), F.col("path")).alias("found"))
    return unnest(found, "found", ["seq", "path"]).drop("capabilities", "body")


# --- capabilities of code -----------------------------------------------------


def _granted(*grants: tuple[Column, tuple[str, ...]]) -> Column:
    """Capabilities of the conditions that hold; each condition is tested once."""
    return X.sorted_set(F.flatten(F.array_compact(F.array(*[F.when(holds, X.literals(caps)) for holds, caps in grants]))))


_NETWORK, _FILES = ("network:read", "network:write"), ("filesystem:read", "filesystem:write")


def python_capabilities(content: Column, imports: Column, env: Column) -> Column:
    """Capabilities shown by a Python server's imports, file opens and secret names."""
    opens = X.any_of(content, ("open",)) & X.matches(content, r"(?<![\w.])open\s*\(")

    def shown(names: Column) -> Column:
        return _granted(
            (F.arrays_overlap(names, X.literals(C.PY_NETWORK_MODULES)), _NETWORK),
            (F.array_contains(names, "subprocess"), ("system:execute",)),
            (F.arrays_overlap(names, X.literals(C.PY_FILE_MODULES)) | opens, _FILES),
            (F.array_contains(names, "os"), ("env:read",)),
            (F.exists(env, X.is_sensitive_code_env), ("credentials:read",)),
        )

    return X.once(imports, shown)


def js_capabilities(content: Column, env: Column, markers: Sequence[str] = C.JS_EXEC_MARKERS_SERVER) -> Column:
    """Capabilities shown by TypeScript or JavaScript code."""
    network = X.matches(content, C.JS_NETWORK)
    files = X.matches(content, C.JS_FILES)
    runs = reduce(lambda a, b: a | b, [X.matches(content, m) for m in markers])

    def shown(names: Column) -> Column:
        return _granted(
            (F.size(names) > 0, ("env:read",)),
            (network, _NETWORK),
            (files, _FILES),
            (runs, ("system:execute",)),
            (F.exists(names, X.is_sensitive_code_env), ("credentials:read",)),
        )

    return X.once(env, shown)


def code_capabilities(files: DataFrame) -> DataFrame:
    """``seq, path, capabilities, sensitive_env`` of every Python and script file."""
    python = F.col("path").rlike(r"\.py$")
    read = files.where(F.col("path").rlike(r"\.(py|ts|js|tsx|jsx)$")).select(
        "seq",
        "path",
        "content",
        python.alias("_python"),
        F.when(python, X.env_in_python(F.col("content"))).otherwise(X.env_in_js(F.col("content"))).alias("_env"),
        F.when(python, X.python_imports(F.col("content"))).alias("_imports"),
    )
    text, env = F.col("content"), F.col("_env")
    caps = F.when(F.col("_python"), python_capabilities(text, F.col("_imports"), env)).otherwise(
        js_capabilities(text, env)
    )
    return read.select(
        "seq", "path", caps.alias("capabilities"), F.exists(env, X.is_sensitive_code_env).alias("sensitive_env")
    )


def toolkit_capabilities(name: Column) -> Column:
    """Capabilities that go with a toolkit name; empty for unknown toolkits."""
    found = F
    for toolkit, caps in C.CAMEL_TOOLKITS.items():
        found = found.when(name == toolkit, X.literals(caps))
    return found.otherwise(F.array().cast("array<string>"))


def tool_reference_capabilities(names: Column, builtins: Sequence[str] = C.ADK_BUILTIN_TOOLS) -> Column:
    """``builtin:x`` for known built-in tools, ``tool:x`` for the rest."""
    return D.references(names, X.literals(builtins))


def skills_from_source(files: DataFrame) -> DataFrame:
    """Skill rows, one per definition, ready for the analyser; a server file is one row, tools and all.

    URLs, variables and commands come from the definition's own text, so one bad function
    does not taint its neighbours. Where a definition only refers to code elsewhere in its
    file (see ``Kind.scans_body``), has no text, or is a script, they come from the file.
    """
    known = files.select("seq", "path", "content", formats(F.col("path"), F.col("content")).alias("formats"))
    found = unnest(
        known.select("seq", "path", "content", definitions_column(F.col("content"), F.col("formats"), F.col("path")).alias("found")),
        "found",
        ["seq", "path", "content"],
    ).where((F.col("format") != "mcp_server") | (F.col("kind") == "server"))
    script = F.col("format").isin("mastra", "mcp_server") & ~F.col("path").rlike(r"\.py$")
    content, body = F.col("content"), F.col("body")
    whole = F.concat_ws(":", "format", "kind").isin(*D.scanned_whole()) | (body == "")
    text = F.when(whole, content).otherwise(body)
    env_js = X.env_in_js(content)
    rows = found.select(
        "seq",
        "name",
        F.col("path").alias("source_path"),
        "format",
        "description",
        F.when(script, js_capabilities(content, env_js, C.JS_EXEC_MARKERS))
        .when(F.col("format") == "mcp_server", python_capabilities(content, X.python_imports(content), X.env_in_python(content)))
        .when(F.col("format") == "composio", X.action_refs(content))
        .when(F.col("format") == "camel", toolkit_capabilities(F.col("name")))
        .otherwise(F.col("capabilities"))
        .alias("declared_capabilities"),
        F.when(script, F.array().cast("array<string>")).otherwise(X.python_imports(content)).alias("dependencies"),
        F.array(F.when(body == "", content).otherwise(body)).alias("code_blocks"),
        F.when(script, X.urls_in_code(content)).otherwise(X.urls(text)).alias("urls"),
        F.when(script, env_js)
        .when(F.col("format") == "mcp_server", X.env_in_python(content))
        .otherwise(X.env_secret_refs(text))
        .alias("env_vars"),
        F.when(script, X.js_exec_markers(content)).otherwise(X.shell_call_strings(text)).alias("shell_commands"),
        content.alias("raw_content"),
    )
    return as_skills(rows)
