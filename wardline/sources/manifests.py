"""YAML manifests.

YAML has no built-in reader, so one Arrow-batched step turns each document into
JSON text (``mapInPandas``); schema, explosion and extraction are native after
that. Unreadable YAML becomes NULL and can be set aside by the caller.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardline.functions import catalog as C
from wardline.functions import text as X
from wardline.schemas import as_skills

_STRINGS = "array<string>"


def _yaml_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import json

    import yaml

    loader = getattr(yaml, "CSafeLoader", yaml.SafeLoader)

    def to_json(text: str) -> str | None:
        try:
            data = yaml.load(text, Loader=loader)
            return json.dumps(data, default=str) if isinstance(data, dict) else None
        except (yaml.YAMLError, ValueError, RecursionError):
            return None

    for batch in batches:
        yield batch.assign(doc=batch["content"].map(to_json))


def yaml_to_json(files: DataFrame) -> DataFrame:
    """Adds ``doc``: the document as JSON text, NULL unless it is a readable mapping."""
    schema = T.StructType([*files.schema.fields, T.StructField("doc", T.StringType())])
    return files.mapInPandas(_yaml_batches, schema)


def _stem() -> Column:
    return F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1)


def _list(value: Column) -> Column:
    return F.coalesce(value, F.array().cast(_STRINGS))


def skills_from_claw(files: DataFrame) -> DataFrame:
    """One skill row per manifest with ``commands`` and ``instructions``."""
    schema = (
        "struct<name:string,version:string,description:string,instructions:string,"
        "commands:array<struct<command:string>>,dependencies:array<string>>"
    )
    docs = yaml_to_json(files).where("doc IS NOT NULL").select("*", F.from_json("doc", schema).alias("d"))
    commands = F.filter(
        F.transform("d.commands", lambda c: c["command"]), lambda c: c.isNotNull() & (c != "")
    )
    docs = docs.withColumn("_commands", _list(commands))
    text = F.array_join(F.concat(F.array(F.coalesce("d.instructions", F.lit(""))), F.col("_commands")), "\n")
    docs = docs.withColumn("_text", text)
    rows = docs.select(
        "seq",
        F.coalesce("d.name", _stem()).alias("name"),
        F.coalesce("d.version", F.lit("unknown")).alias("version"),
        F.col("path").alias("source_path"),
        F.lit("openclaw").alias("format"),
        F.coalesce("d.description", F.lit("")).alias("description"),
        F.coalesce("d.instructions", F.lit("")).alias("instructions"),
        F.col("_commands").alias("shell_commands"),
        _list(F.col("d.dependencies")).alias("dependencies"),
        X.urls(F.col("_text")).alias("urls"),
        X.env_in_manifest(F.col("_text")).alias("env_vars"),
        F.col("content").alias("raw_content"),
    )
    return as_skills(rows)


def _leaf_texts(json_text: Column) -> Column:
    """Texts of a description given as a string, a map of languages or a nested map."""
    nested = F.from_json(json_text, "map<string,string>")
    values = F.flatten(
        F.transform(
            F.map_values(nested),
            lambda v: F.when(v.startswith("{"), F.map_values(F.from_json(v, "map<string,string>"))).otherwise(F.array(v)),
        )
    )
    return F.when(json_text.startswith("{"), values).when(json_text.isNotNull(), F.array(json_text))


def skills_from_plugins(files: DataFrame) -> DataFrame:
    """Dify manifests (by plugin type) and provider files (by credential list)."""
    creds = "credentials_for_provider:array<struct<variable:string>>"
    schema = (
        f"struct<type:string,name:string,version:string,description:string,dependencies:array<string>,{creds},"
        f"tool:struct<description:string,{creds}>,tools:array<struct<{creds}>>,"
        "identity:struct<name:string,description:string>>"
    )
    docs = yaml_to_json(files).where("doc IS NOT NULL").select("*", F.from_json("doc", schema).alias("d"))
    docs = docs.withColumns(
        {
            "_manifest": F.coalesce(F.lower("d.type").isin(*C.DIFY_TYPES), F.lit(False)),
            "_provider": F.get_json_object("doc", "$.credentials_for_provider").isNotNull(),
        }
    ).where("_manifest OR _provider")

    def variables(entries: Column) -> Column:
        named = F.transform(entries, lambda e: e["variable"])
        return _list(F.filter(named, lambda v: v.isNotNull() & (v != "")))

    own = variables(F.col("d.credentials_for_provider"))
    nested = F.concat(
        variables(F.col("d.tool.credentials_for_provider")),
        F.coalesce(
            F.flatten(F.transform("d.tools", lambda t: variables(t["credentials_for_provider"]))),
            F.array().cast(_STRINGS),
        ),
    )
    credentials = F.when(F.col("_manifest"), F.concat(own, nested)).otherwise(own)
    described = F.array_join(
        F.concat(_list(_leaf_texts(F.col("d.description"))), _list(_leaf_texts(F.col("d.tool.description")))), "\n"
    )
    identity = F.col("d.identity.description")
    english = F.get_json_object(identity, "$.en_US")
    provider_text = F.when(identity.startswith("{"), F.coalesce(english, F.get(_leaf_texts(identity), F.lit(0)))).otherwise(identity)
    text, manifest = F.col("content"), F.col("_manifest")
    rows = docs.select(
        "seq",
        F.coalesce(F.when(manifest, F.col("d.name")).otherwise(F.col("d.identity.name")), _stem()).alias("name"),
        F.coalesce(F.when(manifest, F.col("d.version")), F.lit("unknown")).alias("version"),
        F.col("path").alias("source_path"),
        F.lit("dify").alias("format"),
        F.when(manifest, described).otherwise(F.coalesce(provider_text, F.lit(""))).alias("description"),
        F.array(F.when(manifest, F.col("d.type")).otherwise("provider")).alias("declared_capabilities"),
        F.when(manifest, _list(F.col("d.dependencies"))).otherwise(F.array().cast(_STRINGS)).alias("dependencies"),
        X.urls(text).alias("urls"),
        X.sorted_set(F.concat(X.env_in_manifest(text), credentials)).alias("env_vars"),
        F.when(manifest, X.shell_verb_lines(text)).otherwise(F.array().cast(_STRINGS)).alias("shell_commands"),
        text.alias("raw_content"),
    )
    return as_skills(rows)


def skills_from_crews(files: DataFrame) -> DataFrame:
    """One skill row per agent and tool named in a crew file."""
    docs = yaml_to_json(files).where("doc IS NOT NULL")
    agents = F.from_json("doc", "struct<agents:map<string,string>>")["agents"]
    rows = docs.select("seq", "path", "content", F.explode(agents).alias("agent", "config"))
    tools = F.from_json("config", "struct<tools:array<string>>")["tools"]
    named = rows.select("seq", "path", "content", "agent", F.explode(tools).alias("name"))
    return as_skills(
        named.select(
            "seq",
            "name",
            F.col("path").alias("source_path"),
            F.lit("crewai").alias("format"),
            F.concat(F.lit("Tool referenced by agent '"), F.col("agent"), F.lit("'")).alias("description"),
            F.col("content").alias("raw_content"),
        )
    )
