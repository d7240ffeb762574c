"""Low-code workflow and chatflow documents: one skill row per file.

A document's nodes are handled with array functions inside its own row, so
nothing is exploded and regrouped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.functions import catalog as C
from wardline.functions import text as X
from wardline.schemas import as_skills

_WORKFLOW = (
    "struct<name:string,versionId:string,nodes:array<struct<type:string,parameters:string,credentials:map<string,string>>>>"
)
_PARAMETERS = "struct<jsCode:string,pythonCode:string,functionCode:string,command:string>"
_CHATFLOW = "struct<nodes:array<struct<data:struct<type:string,label:string,inputs:map<string,string>>>>>"
_STRINGS = "array<string>"


def _texts(*candidates: Column) -> Column:
    kept = F.array_compact(F.array(*[F.when(X.strip(c) != "", c) for c in candidates]))
    return F.coalesce(kept, F.array().cast(_STRINGS))


def _stem(suffix: str = "") -> Column:
    return F.regexp_replace(F.regexp_extract("path", r"([^/]+)$", 1), rf"{suffix}\.json$", "")


def node_code(parameters: Column) -> Column:
    p = F.from_json(parameters, _PARAMETERS)
    return _texts(p["jsCode"], p["pythonCode"], p["functionCode"])


def node_commands(parameters: Column) -> Column:
    return _texts(F.from_json(parameters, _PARAMETERS)["command"])


def node_credentials(credentials: Column) -> Column:
    """Credential types and their names."""
    pairs = F.transform(
        F.map_entries(F.coalesce(credentials, F.create_map().cast("map<string,string>"))),
        lambda e: F.array_compact(F.array(e["key"], F.get_json_object(e["value"], "$.name"))),
    )
    return F.filter(F.flatten(pairs), lambda v: v != "")


def node_capability(node_type: Column) -> Column:
    """Capability of an n8n node type, NULL when it has none."""
    found = F
    for name, capability in C.N8N_NODE_CAPABILITIES.items():
        found = found.when(node_type == name, capability)
    return found.otherwise(F.lit(None).cast("string"))


def skills_from_workflows(files: DataFrame) -> DataFrame:
    """n8n workflows: documents with at least one ``n8n-nodes-`` node."""
    parsed = files.select("seq", "path", "content", F.from_json("content", _WORKFLOW).alias("d"))
    n8n = F.exists("d.nodes", lambda n: n["type"].startswith(C.N8N_PREFIX))
    nodes = F.filter("d.nodes", lambda n: n.isNotNull())
    flows = parsed.where(F.coalesce(n8n, F.lit(False))).withColumn("nodes", nodes)

    def per_node(pick) -> Column:
        return F.flatten(F.transform("nodes", pick))

    code = per_node(lambda n: node_code(n["parameters"]))
    flows = flows.withColumn("_code", code)
    name = F.coalesce("d.name", _stem())
    types = X.sorted_set(F.filter(F.transform("nodes", lambda n: n["type"]), lambda t: t.isNotNull() & (t != "")))
    listed = F.concat(F.lit("; Nodes: "), F.array_join(types, ", "))
    rows = flows.select(
        "seq",
        name.alias("name"),
        F.coalesce("d.versionId", F.lit("unknown")).alias("version"),
        F.col("path").alias("source_path"),
        F.lit("n8n").alias("format"),
        F.concat(F.lit("n8n workflow: "), name, F.when(F.size(types) > 0, listed).otherwise("")).alias("description"),
        F.array_distinct(
            F.array_compact(F.transform("nodes", lambda n: node_capability(n["type"])))
        ).alias("declared_capabilities"),
        types.alias("dependencies"),
        F.col("_code").alias("code_blocks"),
        per_node(lambda n: X.urls(F.coalesce(n["parameters"], F.lit("")))).alias("urls"),
        X.sorted_set(per_node(lambda n: node_credentials(n["credentials"]))).alias("env_vars"),
        per_node(
            lambda n: F.concat(
                node_commands(n["parameters"]),
                F.flatten(F.transform(node_code(n["parameters"]), lambda c: X.shell_verb_lines(c))),
            )
        ).alias("shell_commands"),
        F.col("content").alias("raw_content"),
    )
    return as_skills(rows)


def chatflow_credentials(nodes: Column) -> Column:
    """Credential input keys that are filled in, distinct and sorted."""

    def keys(node: Column) -> Column:
        inputs = F.coalesce(node["data"]["inputs"], F.create_map().cast("map<string,string>"))
        filled = F.map_filter(
            inputs, lambda k, v: k.isin(*C.FLOWISE_CREDENTIAL_INPUTS) & ~F.coalesce(v, F.lit("")).isin("", "false", "0", "{}", "[]")
        )
        return F.map_keys(filled)

    return X.sorted_set(F.flatten(F.transform(nodes, keys)))


def chatflow_types(nodes: Column) -> Column:
    return X.sorted_set(F.filter(F.transform(nodes, lambda n: n["data"]["type"]), lambda t: t.isNotNull() & (t != "")))


def parse_chatflows(files: DataFrame) -> DataFrame:
    """``seq, path, content, nodes`` of documents holding a known chatflow node type."""
    parsed = files.select("seq", "path", "content", F.from_json("content", _CHATFLOW).alias("d"))
    known = F.exists("d.nodes", lambda n: n["data"]["type"].isin(*C.FLOWISE_NODE_TYPES))
    nodes = F.filter("d.nodes", lambda n: n["data"].isNotNull())
    return parsed.where(F.coalesce(known, F.lit(False))).select("seq", "path", "content", nodes.alias("nodes"))


def skills_from_chatflows(files: DataFrame) -> DataFrame:
    flows = parse_chatflows(files)
    custom = F.filter("nodes", lambda n: n["data"]["type"] == "CustomTool")
    code = F.filter(
        F.transform(custom, lambda n: F.coalesce(n["data"]["inputs"]["javascriptFunction"], F.lit(""))),
        lambda c: c != "",
    )
    flows = flows.withColumn("_blocks", code).withColumn("_code", F.array_join("_blocks", "\n"))
    labels = F.filter(F.transform("nodes", lambda n: n["data"]["label"]), lambda v: v.isNotNull() & (v != ""))
    shown = F.concat(F.lit("Flowise chatflow: "), F.array_join(labels, ", "))
    rows = flows.select(
        "seq",
        _stem().alias("name"),
        F.col("path").alias("source_path"),
        F.lit("flowise").alias("format"),
        F.when(F.size(labels) > 0, shown).otherwise("Flowise chatflow").alias("description"),
        chatflow_types(F.col("nodes")).alias("declared_capabilities"),
        X.sorted_set(F.flatten(F.transform("_blocks", X.js_requires))).alias("dependencies"),
        F.col("_blocks").alias("code_blocks"),
        X.urls(F.col("content")).alias("urls"),
        X.sorted_set(F.concat(X.env_in_chatflow(F.col("_code")), chatflow_credentials(F.col("nodes")))).alias("env_vars"),
        F.concat(
            X.js_exec_strings(F.col("_code")), X.shell_verb_lines(F.col("_code"), stop_at_quotes=True)
        ).alias("shell_commands"),
        F.col("content").alias("raw_content"),
    )
    return as_skills(rows)


def npm_dependencies(content: Column) -> Column:
    """Names in the three dependency sections of a ``package.json``, distinct and sorted."""
    sections = ("dependencies", "devDependencies", "peerDependencies")
    schema = "struct<" + ",".join(f"{s}:map<string,string>" for s in sections) + ">"
    parsed = F.from_json(content, schema)
    keys = [F.coalesce(F.map_keys(parsed[s]), F.array().cast(_STRINGS)) for s in sections]
    return X.sorted_set(F.concat(*keys))


def quarantined(files: DataFrame) -> DataFrame:
    """``seq, path`` of documents that are not JSON objects; everything else is processed."""
    # Parsing to the variant type reads the whole text, unlike a path lookup.
    kind = F.schema_of_variant(F.try_parse_json("content"))
    return files.where(~F.coalesce(kind.startswith("OBJECT"), F.lit(False))).select("seq", "path")
