"""Developer-tool inventory of a fleet from a table of paths.

Input rows are ``host, platform, path, kind`` (``kind`` is ``dir`` or ``file``),
paths relative to the home directory. Each path is matched to tools with
literal tests on its first segment, so paths never meet profiles in a loop.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.functions import catalog as C
from wardline.plans.shape import pick

_EVIDENCE = "array<struct<tool:string,short_name:string,platform_rule:string,role:string,inside:boolean>>"


def _evidence(tool: Column | str, short: Column | str, rule: str, role: Column, inside: Column) -> Column:
    value = [v if isinstance(v, Column) else F.lit(v) for v in (tool, short)]
    return F.struct(
        value[0].alias("tool"),
        value[1].alias("short_name"),
        F.lit(rule).alias("platform_rule"),
        role.alias("role"),
        inside.alias("inside"),
    )


#: How many segments a path may have to be taken for a configuration file or a skill folder.
CONFIG_DEPTH, SKILL_DEPTH = 4, 3


def _role(config_depth: int | None, skill_depth: int | None) -> Column:
    """What a path below a dot directory stands for: a config file, a skill folder or just its presence."""
    parts = F.split("path", "/")
    depth = F.size(parts)
    leaf = F.get(parts, depth - 1)

    def within(limit: int | None) -> Column:
        return (depth >= 2) if limit is None else (depth >= 2) & (depth <= limit)

    return (
        F.when(within(config_depth) & (F.col("kind") == "file") & leaf.isin(*C.FLEET_CONFIG_FILES), "config")
        .when(within(skill_depth) & (F.col("kind") == "dir") & (leaf == "skills"), "skills")
        .when((depth > 1) | (F.col("kind") == "dir"), "present")
    )


def evidence(paths: DataFrame, config_depth: int | None = CONFIG_DEPTH, skill_depth: int | None = SKILL_DEPTH) -> DataFrame:
    """``host, platform, path, tool, short_name, role``: what each path says about a tool.

    ``None`` takes configuration files or skill folders at any depth.
    """
    top = F.split_part("path", F.lit("/"), F.lit(1))
    role = _role(config_depth, skill_depth)
    hits = []
    for p in C.TOOL_PROFILES:
        listed = F.when(F.col("path").isin(*p.config_paths) & (F.col("kind") == "file"), "config") if p.config_paths else None
        skills = F.when(F.col("path").isin(*p.skill_paths) & (F.col("kind") == "dir"), "skills") if p.skill_paths else None
        inside = F.when(top == p.dot_dir, role)
        found = F.coalesce(*[c for c in (listed, skills, inside) if c is not None])
        fits = found.isNotNull() if p.platform == "all" else found.isNotNull() & (F.col("platform") == p.platform)
        hits.append(F.when(fits, _evidence(p.name, p.short_name, p.platform, found, top == p.dot_dir)))
    known_dirs = sorted({p.dot_dir for p in C.TOOL_PROFILES})
    unknown = top.startswith(".") & ~F.ltrim(top, F.lit(".")).isin(*[d.lstrip(".") for d in known_dirs])
    name = F.concat(F.lit("Unknown ("), top, F.lit(")"))
    hits.append(F.when(unknown & role.isNotNull(), _evidence(name, F.ltrim(top, F.lit(".")), "unknown", role, F.lit(True))))
    found = F.array_compact(F.array(*hits)).cast(_EVIDENCE)
    rows = paths.select("host", "platform", "path", F.explode_outer(found).alias("e")).where(F.col("e").isNotNull())
    return rows.select("host", "platform", "path", "e.*")


def unique_skills(skills: DataFrame) -> DataFrame:
    """Of skills of one name on one host and tool, the first by path; other columns stay with it."""
    return pick(skills, ["host", "tool", "name"], ["path"], last=False)


def inventory(paths: DataFrame, config_depth: int | None = CONFIG_DEPTH, skill_depth: int | None = SKILL_DEPTH) -> DataFrame:
    """``host, tool, short_name, config_files, skill_dirs``: tools found on each host.

    A known tool needs its dot directory; an unknown one needs at least one
    configuration file or skill folder. Counts replace path lists, which stay
    available as rows of :func:`evidence`.
    """
    grouped = (
        evidence(paths, config_depth, skill_depth)
        .select("host", "tool", "short_name", "platform_rule", "role", "inside", "path")
        .distinct()
        .groupBy("host", "tool", "short_name", "platform_rule")
        .agg(
            F.bool_or("inside").alias("_present"),
            F.count_if(F.col("role") == "config").alias("config_files"),
            F.count_if(F.col("role") == "skills").alias("skill_dirs"),
        )
    )
    known = (F.col("platform_rule") != "unknown") & F.col("_present")
    other = (F.col("platform_rule") == "unknown") & (F.col("config_files") + F.col("skill_dirs") > 0)
    return grouped.where(known | other).select("host", "tool", "short_name", "config_files", "skill_dirs")
