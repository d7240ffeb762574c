"""Model-context server configurations: one skill row per declared server."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.functions import catalog as C
from wardline.functions import text as X
from wardline.plans.shape import pick
from wardline.schemas import as_skills

_TOP = "struct<" + ",".join(f"`{k}`:map<string,string>" for k in C.MCP_SERVER_KEYS) + ">"
_ENTRIES = "array<struct<key:string,value:string>>"
_SERVER = "struct<command:string,args:array<string>,env:map<string,string>>"


def servers(configs: DataFrame) -> DataFrame:
    """``seq, path, name, server``: every declared server of every file.

    The three alternative maps of a file are merged; of entries with one name the
    last counts. Files and entries that are not objects drop out.
    """
    top = F.from_json("content", _TOP)
    listed = F.concat(*[F.coalesce(F.map_entries(top[k]), F.array().cast(_ENTRIES)) for k in C.MCP_SERVER_KEYS])
    # entries, not maps: a name that one file gives twice is data, not an error
    entries = configs.select("seq", "path", listed.alias("_all"))
    last = F.filter(
        "_all",
        lambda e, i: ~F.exists(F.slice("_all", i + 2, F.size("_all")), lambda later: later["key"] == e["key"]),
    )
    rows = entries.select("seq", "path", F.explode_outer(last).alias("_entry"))
    named = rows.select("seq", "path", F.col("_entry.key").alias("name"), F.col("_entry.value").alias("server"))
    return named.where(F.col("name").isNotNull() & F.col("server").startswith("{"))


def server_packages(configs: DataFrame) -> DataFrame:
    """``seq, name, package``: npm packages among the arguments of each declared server."""
    args = F.from_json("server", _SERVER)["args"]
    rows = servers(configs).select("seq", "name", F.explode_outer(X.npm_packages(args)).alias("package"))
    return rows.where(F.col("package").isNotNull())


def skills_from_configs(configs: DataFrame) -> DataFrame:
    """Skill rows of ``seq, path, content`` configuration files.

    Within one folder a server name counts once; the file that comes first in
    the fixed file order wins.
    """
    # the winners are picked before anything is read from them, so that only short rows are sorted
    placed = servers(configs).select(
        "*",
        F.regexp_extract("path", r"^(.*?)[^/]*$", 1).alias("_folder"),
        F.array_position(X.literals(C.MCP_CONFIG_FILES), F.regexp_extract("path", r"([^/]+)$", 1)).alias("_rank"),
    )
    first = pick(placed.where(F.col("_rank") > 0), ["_folder", "name"], ["_rank", "seq"], last=False)
    parsed = first.select("seq", "path", "name", "server", F.from_json("server", _SERVER).alias("s"))
    args = F.coalesce("s.args", F.array().cast("array<string>"))
    command = F.coalesce("s.command", F.lit(""))
    line = F.array_join(F.concat(F.array(command), args), " ")
    has = command != ""
    rows = parsed.select(
        "seq",
        "name",
        F.col("path").alias("source_path"),
        F.lit("mcp").alias("format"),
        F.concat(F.lit("MCP server: "), F.when(has, line).otherwise(F.col("name"))).alias("description"),
        F.when(has, F.array(line)).otherwise(F.array().cast("array<string>")).alias("shell_commands"),
        F.coalesce(F.array_sort(F.map_keys("s.env")), F.array().cast("array<string>")).alias("env_vars"),
        X.npm_packages(args).alias("dependencies"),
        F.col("server").alias("raw_content"),
    )
    return as_skills(rows)
