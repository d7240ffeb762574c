"""Bill-of-materials rows in the CycloneDX component shape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PURL_TYPE = "pkg:agent-skill"
PROPERTY_PREFIX = "agent-skill"


def purl(name: Column, version: Column) -> Column:
    return F.concat(F.lit(f"{PURL_TYPE}/"), name, F.lit("@"), version)


def components(results: DataFrame) -> DataFrame:
    """One component per analysed skill, repeats kept.

    ``trust_score`` and ``trust_level`` are taken along when the results carry them.
    """
    trust = {"trust_score": "double", "trust_level": "string"}
    known = [F.col(c) if c in results.columns else F.lit(None).cast(t).alias(c) for c, t in trust.items()]
    return results.select(
        "seq",
        "name",
        "version",
        "format",
        F.col("declared_capabilities").alias("capabilities"),
        F.coalesce("is_safe", F.lit(True)).alias("is_safe"),
        F.coalesce("findings_count", F.lit(0)).alias("findings_count"),
        "dependencies",
        "source_path",
        purl(F.col("name"), F.col("version")).alias("purl"),
        *known,
    )


def two_decimals(score: Column) -> Column:
    """``%.2f`` of a score in [0, 1], rounded by its exact binary value.

    The JVM formatter rounds the shortest decimal form instead (0.485 becomes
    0.49). Splitting the score into two short halves keeps every product exact.
    """
    high = score.cast("float").cast("double")
    low = score - high
    cents = F.floor(score * 100)
    over = (high * 200 - (cents * 2 + 1)) + low * 200
    rounded = cents + F.when(over > 0, 1).when(over == 0, cents % 2).otherwise(0)
    return F.format_string("%d.%02d", F.floor(rounded / 100), rounded % 100)


def properties(prefix: str = PROPERTY_PREFIX) -> Column:
    """Property list of a component row; entries without a value are left out."""

    def entry(name: str, value: Column, present: Column) -> Column:
        pair = F.struct(F.lit(f"{prefix}:{name}").alias("name"), value.alias("value"))
        return F.when(present, pair)

    always = F.lit(True)
    return F.array_compact(
        F.array(
            entry("format", F.col("format"), always),
            entry("is-safe", F.col("is_safe").cast("string"), always),
            entry("findings-count", F.col("findings_count").cast("string"), always),
            entry("capabilities", F.array_join("capabilities", ","), F.size("capabilities") > 0),
            entry("trust-score", two_decimals(F.col("trust_score")), F.col("trust_score").isNotNull()),
            entry("trust-level", F.col("trust_level"), F.col("trust_level").isNotNull()),
            entry("source-path", F.col("source_path"), F.col("source_path") != ""),
        )
    )


def depends_on(dependencies: Column) -> Column:
    """Targets carry the version ``unknown``; NULL when there are none."""
    targets = F.transform(dependencies, lambda d: purl(d, F.lit("unknown")))
    return F.when(F.size(dependencies) > 0, targets)


def component_json(rows: DataFrame) -> DataFrame:
    """``seq, component, dependency``: both CycloneDX entries of each row as JSON."""
    component = F.struct(
        F.lit("library").alias("type"),
        F.col("name"),
        F.col("version"),
        F.col("purl"),
        properties().alias("properties"),
    )
    dependency = F.struct(F.col("purl").alias("ref"), depends_on(F.col("dependencies")).alias("dependsOn"))
    return rows.select("seq", F.to_json(component).alias("component"), F.to_json(dependency).alias("dependency"))


def summary(rows: DataFrame) -> DataFrame:
    """``kind, key, value``: totals, components per format and per trust level.

    One scan feeds the three groupings through GROUPING SETS.
    """
    level = F.coalesce("trust_level", F.lit("UNSCORED"))
    grouped = rows.select("is_safe", "findings_count", "format", level.alias("trust_level")).groupingSets(
        [[], [F.col("format")], [F.col("trust_level")]], "format", "trust_level"
    ).agg(
        F.grouping_id().alias("_set"),
        F.count(F.lit(1)).alias("total"),
        F.count_if("is_safe").alias("safe"),
        F.coalesce(F.sum("findings_count"), F.lit(0)).alias("findings"),
    )
    total = F.array(
        _line("total", "", F.col("total")),
        _line("safe", "", F.col("safe")),
        _line("unsafe", "", F.col("total") - F.col("safe")),
        _line("total_findings", "", F.col("findings")),
    )
    lines = (
        F.when(F.col("_set") == 3, total)
        .when(F.col("_set") == 1, F.array(_line("format", F.col("format"), F.col("total"))))
        .otherwise(F.array(_line("trust_level", F.col("trust_level"), F.col("total"))))
    )
    return grouped.select(F.explode(lines).alias("line")).select("line.*")


def _line(kind: str, key: Column | str, value: Column) -> Column:
    shown = key if isinstance(key, Column) else F.lit(key)
    return F.struct(F.lit(kind).alias("kind"), shown.alias("key"), value.cast("long").alias("value"))
