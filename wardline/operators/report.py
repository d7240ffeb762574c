"""Roll-ups over analysed skills and their findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wardline.functions import catalog as C
from wardline.functions.rules import level_name, severity_name
from wardline.functions.text import clip
from wardline.plans.shape import pick, unnest


def executive_summary(results: DataFrame) -> DataFrame:
    """One row of totals. Severities are counted inside each row, then summed map-side."""

    def of(severity: int):
        return F.sum(F.size(F.filter("findings", lambda f: f["severity"] == severity)))

    return results.agg(
        F.count(F.lit(1)).alias("total_skills"),
        F.count_if("is_safe").alias("safe_count"),
        F.count_if(~F.col("is_safe")).alias("unsafe_count"),
        of(C.CRITICAL).alias("critical_count"),
        of(C.HIGH).alias("high_count"),
        of(C.MEDIUM).alias("medium_count"),
        of(C.LOW).alias("low_count"),
        F.array_sort(F.collect_set(F.when(F.col("format") != "", F.col("format")))).alias("frameworks_detected"),
    )


def name_formats(skills: DataFrame) -> DataFrame:
    """``skill_name, format``: the last format seen for each name."""
    rows = skills.select("seq", F.col("name").alias("skill_name"), "format")
    return pick(rows, ["skill_name"], ["seq"], last=True).drop("seq")


def findings_table(findings: DataFrame, formats: DataFrame) -> DataFrame:
    """Display rows of long findings: format by name, severity name, shortened evidence."""
    joined = findings.join(formats, "skill_name", "left")
    return joined.select(
        "skill_name",
        F.coalesce("format", F.lit("unknown")).alias("format"),
        severity_name(F.col("severity")).alias("severity"),
        "message",
        "attack_class",
        "finding_type",
        clip(F.col("evidence"), 120).alias("evidence"),
    )


def findings_filter(table: DataFrame, severity: str = "ALL", format: str = "ALL") -> DataFrame:
    kept = table
    if severity != "ALL":
        kept = kept.where(F.col("severity") == severity)
    if format != "ALL":
        kept = kept.where(F.col("format") == format)
    return kept


def capability_matrix(results: DataFrame) -> DataFrame:
    """Inferred access per skill and resource by name; skills without any are dropped.

    A skill's capabilities are in its own row, so the row is widened in place: no pivot.
    """

    def access(resource: str) -> Column:
        mine = F.filter("inferred", lambda c: c["resource"] == resource)
        return level_name(F.coalesce(F.array_max(F.transform(mine, lambda c: c["access"])), F.lit(C.NONE)))

    wide = F.array(F.struct(*[access(r).alias(r) for r in C.RESOURCES]))
    rows = results.select("seq", F.col("name").alias("skill_name"), F.when(F.size("inferred") > 0, wide).alias("row"))
    return unnest(rows, "row", ["seq", "skill_name"])


def severity_share(findings: DataFrame) -> DataFrame:
    """Findings per severity and their share; the window runs over at most four rows."""
    counts = findings.groupBy("severity").agg(F.count(F.lit(1)).alias("findings"))
    total = F.sum("findings").over(W.partitionBy(F.lit(1)))
    return counts.select(
        severity_name(F.col("severity")).alias("severity"), "findings", (F.col("findings") / total).alias("share")
    )


def framework_coverage(skills: DataFrame) -> DataFrame:
    """Skills per format, most frequent first, names breaking ties."""
    shown = F.when(F.coalesce("format", F.lit("")) == "", "unknown").otherwise(F.col("format"))
    counts = skills.groupBy(shown.alias("framework")).agg(F.count(F.lit(1)).alias("count"))
    return counts.orderBy(F.col("count").desc(), "framework")


def catalogue_coverage(spark: SparkSession, detected: DataFrame) -> DataFrame:
    """Files per known format, formats without any included."""
    known = spark.createDataFrame([(f,) for f in C.FRAMEWORKS], "framework string")
    shown = F.when(F.col("format") == "mcp", "mcp_config").otherwise(F.col("format"))
    counts = detected.groupBy(shown.alias("framework")).agg(F.count(F.lit(1)).alias("files"))
    return known.join(counts, "framework", "left").fillna(0, ["files"])


def scan_table(results: DataFrame) -> DataFrame:
    return results.select(
        "seq",
        F.col("name").alias("skill_name"),
        F.when(F.col("is_safe"), "SAFE").otherwise("UNSAFE").alias("status"),
        "findings_count",
        F.coalesce(severity_name(F.col("max_severity")), F.lit("-")).alias("max_severity"),
    )


def scan_summary(results: DataFrame) -> DataFrame:
    return results.agg(
        F.count(F.lit(1)).alias("skills"),
        F.count_if("is_safe").alias("safe"),
        F.count_if(~F.col("is_safe")).alias("unsafe"),
        F.sum("findings_count").alias("findings"),
    )


def attack_phases(spark: SparkSession) -> DataFrame:
    rows = [(a, p, C.PHASES[p]) for a, phases in C.ATTACK_PHASES.items() for p in phases]
    return spark.createDataFrame(rows, "attack_class string, phase string, phase_order int")


def phase_rollup(findings: DataFrame) -> DataFrame:
    """Findings per attack class and lifecycle phase.

    Findings are counted per class first; the phases meet a handful of rows.
    Classes outside the threat model keep one row without a phase.
    """
    counts = findings.groupBy("attack_class").agg(F.count(F.lit(1)).alias("findings"))
    return counts.join(attack_phases(findings.sparkSession), "attack_class", "left")


def finding_rollup(findings: DataFrame) -> DataFrame:
    """Counts by attack class and severity with subtotals and a grand total."""
    grouped = findings.rollup("attack_class", "severity").agg(
        F.grouping_id().alias("_level"), F.count(F.lit(1)).alias("findings")
    )
    return grouped.select(
        F.when(F.col("_level") == 3, "ALL").otherwise(F.col("attack_class")).alias("attack_class"),
        F.when(F.col("_level") > 0, "ALL").otherwise(severity_name(F.col("severity"))).alias("severity"),
        "findings",
    )


def detection_metrics(labelled: DataFrame, truth: str, flagged: str) -> DataFrame:
    """Confusion counts, precision, recall and F1 of a verdict against labels."""
    yes, hit = F.col(truth) == 1, F.col(flagged)
    counts = labelled.agg(
        F.count_if(yes & hit).alias("tp"),
        F.count_if(~yes & hit).alias("fp"),
        F.count_if(yes & ~hit).alias("fn"),
        F.count_if(~yes & ~hit).alias("tn"),
    )
    tp, fp, fn = (F.col(c).cast("double") for c in ("tp", "fp", "fn"))
    return counts.select(
        "*",
        F.try_divide(tp, tp + fp).alias("precision"),
        F.try_divide(tp, tp + fn).alias("recall"),
        F.try_divide(2 * tp, 2 * tp + fp + fn).alias("f1"),
    )


def scan_documents(results: DataFrame) -> DataFrame:
    """One nested result per skill, ready to be written as JSON lines."""
    findings = F.transform(
        "findings",
        lambda f: F.struct(
            severity_name(f["severity"]).alias("severity"),
            f["message"].alias("message"),
            f["attack_class"].alias("attack_class"),
            f["finding_type"].alias("finding_type"),
            f["evidence"].alias("evidence"),
        ),
    )
    caps = F.transform(
        "inferred", lambda c: F.struct(c["resource"].alias("resource"), level_name(c["access"]).alias("access"))
    )
    return results.select(
        "seq",
        F.col("name").alias("skill_name"),
        "is_safe",
        "findings_count",
        severity_name(F.col("max_severity")).alias("max_severity"),
        caps.alias("inferred_capabilities"),
        findings.alias("findings"),
    )


def payload(results: DataFrame, formats: DataFrame) -> DataFrame:
    """Report sections as ``section, body`` JSON rows; large sections stay many rows."""

    def section(name: str, frame: DataFrame) -> DataFrame:
        return frame.select(F.lit(name).alias("section"), F.to_json(F.struct("*")).alias("body"))

    long = unnest(results, "findings", ["seq", F.col("name").alias("skill_name")])
    return (
        section("summary", executive_summary(results))
        .unionByName(section("findings", findings_table(long, formats)))
        .unionByName(section("capabilities", capability_matrix(results)))
        .unionByName(section("framework_coverage", framework_coverage(results)))
    )
