"""Lock tables: building, checking, comparing and serialising.

A lock is a table with one row per skill name, not one document: at corpus
scale a single JSON object cannot be built or read by one task, so documents
are written as JSON lines in name order (see ``sources.sinks``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.functions import text as X
from wardline.functions.rules import level_name
from wardline.operators import trust
from wardline.operators.graph import cycle_groups
from wardline.operators.versions import latest_nodes
from wardline.plans.shape import pick

INTEGRITY = r"^sha256:[0-9a-f]{64}$"
EMPTY_DEPENDENCIES = "map<string,string>"


def lock_columns() -> list[str]:
    return [
        "name",
        "version",
        "integrity",
        "format",
        "capabilities",
        "dependencies",
        "trust_score",
        "trust_level",
        "source_path",
    ]


def capability_strings(inferred: Column) -> Column:
    return F.transform(inferred, lambda c: F.concat_ws(":", c["resource"], level_name(c["access"])))


def build(results: DataFrame) -> DataFrame:
    """Lock rows of analysed skills; the last skill of a name wins.

    The text is hashed before anything is shuffled, so only short columns move.
    """
    rows = results.select(
        "seq",
        "name",
        "version",
        X.integrity(F.col("raw_content")).alias("integrity"),
        "format",
        F.array_union("declared_capabilities", capability_strings(F.col("inferred"))).alias("capabilities"),
        F.create_map().cast(EMPTY_DEPENDENCIES).alias("dependencies"),
        F.lit(None).cast("double").alias("trust_score"),
        F.lit(None).cast("string").alias("trust_level"),
        "source_path",
    )
    return pick(rows, ["name"], ["seq"], last=True).select(*lock_columns())


def from_resolution(
    installed: DataFrame, nodes: DataFrame, edges: DataFrame, skills: DataFrame, scores: DataFrame
) -> DataFrame:
    """Lock rows of a solved assignment (``name, version``).

    Dependencies are pinned only to installed names. ``nodes`` carry
    ``capabilities``, ``skills`` the text, ``scores`` a ``trust_score`` by name.
    """
    pins = installed.select(F.col("name").alias("dep_name"), F.col("version").alias("dep_version"))
    pinned = (
        edges.join(installed, ["name", "version"], "left_semi")
        .select("name", "dep_name")
        .distinct()
        .join(pins, "dep_name")
        .groupBy("name")
        .agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("dep_name", "dep_version")))).alias("dependencies"))
    )
    known = latest_nodes(nodes).select("name", "version", F.array_sort("capabilities").alias("capabilities"))
    texts = pick(
        skills.select(
            "seq", "name", "format", "source_path", X.integrity(F.col("raw_content")).alias("integrity")
        ),
        ["name"],
        ["seq"],
        last=True,
    ).drop("seq")
    joined = (
        installed.join(known, ["name", "version"], "left")
        .join(pinned, "name", "left")
        .join(texts, "name", "left")
        .join(scores.select("name", "trust_score"), "name", "left")
    )
    filled = {
        "integrity": F.coalesce("integrity", F.lit("")),
        "format": F.coalesce("format", F.lit("")),
        "source_path": F.coalesce("source_path", F.lit("")),
        "capabilities": F.coalesce("capabilities", F.array().cast("array<string>")),
        "dependencies": F.coalesce("dependencies", F.create_map().cast(EMPTY_DEPENDENCIES)),
        "trust_level": trust.level_name(F.col("trust_score")),
    }
    return joined.withColumns(filled).select(*lock_columns())


def verify_integrity(lock: DataFrame, contents: DataFrame) -> DataFrame:
    """``name, content`` rows with ``intact``; a name that is not locked is not intact."""
    hashed = contents.select("name", X.integrity(F.col("content")).alias("actual"))
    joined = hashed.join(lock.select("name", "integrity"), "name", "left")
    return joined.select("name", F.coalesce(F.col("actual") == F.col("integrity"), F.lit(False)).alias("intact"))


COMPARED = ("version", "integrity", "capabilities", "trust_score")


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """``name, change, field, old_value, new_value``: added, removed and changed entries."""

    def side(lock: DataFrame, prefix: str) -> DataFrame:
        values = []
        for field in COMPARED:
            if field not in lock.columns:
                value = F.lit(None)
            elif field == "capabilities":
                value = F.array_join(F.array_sort(field), ",")
            else:
                value = F.col(field)
            values.append(value.cast("string").alias(f"{prefix}_{field}"))
        return lock.select("name", F.lit(True).alias(f"_{prefix}"), *values)

    joined = side(old, "old").join(side(new, "new"), "name", "full")

    def change(field: str) -> Column:
        before, after = F.col(f"old_{field}"), F.col(f"new_{field}")
        both = F.col("_old").isNotNull() & F.col("_new").isNotNull()
        return F.when(both & ~before.eqNullSafe(after), _change("changed", field, before, after))

    empty = F.lit(None).cast("string")
    changes = F.array_compact(
        F.array(
            F.when(F.col("_old").isNull(), _change("added", "", empty, empty)),
            F.when(F.col("_new").isNull(), _change("removed", "", empty, empty)),
            *[change(field) for field in COMPARED],
        )
    )
    rows = joined.select("name", F.explode_outer(changes).alias("c")).where(F.col("c").isNotNull())
    return rows.select("name", "c.*")


def _change(kind: str, field: str, old: Column, new: Column) -> Column:
    return F.struct(
        F.lit(kind).alias("change"), F.lit(field).alias("field"), old.alias("old_value"), new.alias("new_value")
    )


def validate(lock: DataFrame, total_skills: int | None = None) -> DataFrame:
    """``check, name, detail`` for every inconsistency; no rows means the lock is sound.

    Only names on a dependency cycle are reported for the cycle check, not names
    that merely lead to one.
    """
    deps = lock.select("name", F.explode(F.map_keys("dependencies")).alias("dep"))
    names = lock.select("name")
    missing = deps.join(names.toDF("dep"), "dep", "left_anti").select(
        F.lit("missing_dependency").alias("check"), "name", F.col("dep").alias("detail")
    )
    inside = deps.join(names.toDF("dep"), "dep", "left_semi")
    cycles = cycle_groups(inside.select(F.col("name").alias("src"), F.col("dep").alias("dst"))).select(
        F.lit("cycle").alias("check"), F.col("node").alias("name"), F.col("cycle").alias("detail")
    )
    bad_hash = lock.where((F.col("integrity") != "") & ~F.col("integrity").rlike(INTEGRITY)).select(
        F.lit("integrity_format").alias("check"), "name", F.col("integrity").alias("detail")
    )
    blank = lock.where(F.coalesce("version", F.lit("")) == "").select(
        F.lit("empty_version").alias("check"), "name", F.lit("").alias("detail")
    )
    found = missing.unionByName(cycles).unionByName(bad_hash).unionByName(blank)
    if total_skills is None:
        return found
    count = lock.agg(F.count(F.lit(1)).alias("n")).where(F.col("n") != total_skills)
    return found.unionByName(
        count.select(F.lit("total_skills").alias("check"), F.lit("").alias("name"), F.col("n").cast("string").alias("detail"))
    )


def entry_json(lock: DataFrame) -> DataFrame:
    """``name, entry``: canonical JSON of each lock entry, absent trust left out."""
    pairs = F.array_sort(F.map_entries("dependencies"))
    entry = F.struct(
        F.array_sort("capabilities").alias("capabilities"),
        F.map_from_entries(pairs).alias("dependencies"),
        F.col("format"),
        F.col("integrity"),
        F.when(F.col("source_path") != "", F.col("source_path")).alias("source_path"),
        F.col("trust_level"),
        F.col("trust_score"),
        F.col("version"),
    )
    return lock.select("name", F.to_json(entry, {"ignoreNullFields": "true"}).alias("entry"))
