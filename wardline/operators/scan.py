"""Skill analysis: inferred capabilities, findings and verdict.

Every step looks at one skill only, so the whole analysis is one projection
over the scan: no shuffle, no join, and any skew in names or texts is harmless.
The same function serves batch frames and streams.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.functions import catalog as C
from wardline.functions import rules as R
from wardline.functions import text as X
from wardline.plans.shape import unnest, unnest_values
from wardline.schemas import CAPABILITIES_TYPE

# --- inference and detection as Columns ---------------------------------------


def _cap(resource: str, access: int | Column) -> Column:
    level = access if isinstance(access, Column) else F.lit(access)
    return F.struct(F.lit(resource).alias("resource"), level.cast("int").alias("access"))


def inferred_capabilities(skills: DataFrame) -> Column:
    """What the skill's content needs, as ``array<struct<resource, access>>``."""
    urls, commands, env = skills["urls"], skills["shell_commands"], skills["env_vars"]
    prose = F.concat_ws(" ", skills["instructions"], skills["description"])
    network = F.when(
        X.matches(F.array_join(commands, " "), C.HTTP_WRITE_FLAGS, "i"), F.lit(C.WRITE)
    ).otherwise(F.lit(C.READ))
    caps = F.array(
        F.when(F.size(urls) > 0, _cap("network", network)),
        F.when(F.size(commands) > 0, _cap("shell", C.WRITE)),
        F.when(F.size(env) > 0, _cap("environment", C.READ)),
        F.when(
            X.matches(prose, C.FILE_PHRASE_HINT),
            F.when(X.matches(prose, C.FILE_WRITE_PHRASES, "i"), _cap("filesystem", C.WRITE)).when(
                X.matches(prose, C.FILE_READ_PHRASES, "i"), _cap("filesystem", C.READ)
            ),
        ),
    )
    return F.array_compact(caps).cast(CAPABILITIES_TYPE)


def shell_findings(skills: DataFrame, rules: Sequence[C.Rule] = C.SHELL_RULES) -> Column:
    return R.rule_hits_each(skills["shell_commands"], rules)


def code_findings(skills: DataFrame, rules: Sequence[C.Rule] = C.CODE_RULES) -> Column:
    return R.rule_hits_each(skills["code_blocks"], rules)


def url_findings(skills: DataFrame) -> Column:
    """One finding per URL outside the trusted hosts, repeats kept."""
    outside = F.filter(skills["urls"], lambda u: ~X.is_safe_url(u))
    return F.transform(
        outside,
        lambda u: R.finding(
            C.HIGH, F.concat(F.lit("External URL detected: "), u), "data_exfiltration", "pattern_match", u
        ),
    )


def env_findings(skills: DataFrame) -> Column:
    sensitive = F.filter(skills["env_vars"], X.is_sensitive_env)
    return F.transform(
        sensitive,
        lambda e: R.finding(
            C.HIGH,
            F.concat(F.lit("Sensitive environment variable accessed: "), e),
            "data_exfiltration",
            "pattern_match",
            e,
        ),
    )


def flow_findings(skills: DataFrame) -> Column:
    """Encoding words together with an outside URL."""

    def encodes(texts: Column) -> Column:
        return F.exists(texts, lambda t: X.matches(t, C.BASE64_WORD, "i"))

    both = F.exists(skills["urls"], lambda u: ~X.is_safe_url(u)) & (
        encodes(skills["shell_commands"]) | encodes(skills["code_blocks"])
    )
    message = (
        "Information flow concern: base64 encoding combined with external network access"
        " suggests data exfiltration"
    )
    return R.collect(
        F.when(both, R.finding(C.CRITICAL, message, "data_exfiltration", "info_flow", "base64 + external URL"))
    )


def declared_levels(declared: Column, aliases: Mapping[str, str] | None = None) -> Column:
    """``resource:LEVEL`` strings as ``array<struct<resource, access>>``.

    Entries without a colon or with an unknown level are ignored, as published.
    ``aliases`` optionally maps resource names (say ``env`` to ``environment``).
    """

    def parse(entry: Column) -> Column:
        parts = F.split(entry, ":", 2)
        resource = F.lower(X.strip(F.get(parts, F.lit(0))))
        for name, target in (aliases or {}).items():
            resource = F.when(resource == name, F.lit(target)).otherwise(resource)
        level = R.level_value(F.upper(X.strip(F.get(parts, F.lit(1)))))
        return F.struct(resource.alias("resource"), level.cast("int").alias("access"))

    parsed = F.transform(F.filter(declared, lambda d: d.contains(":")), parse)
    return F.filter(parsed, lambda c: c["access"].isNotNull()).cast(CAPABILITIES_TYPE)


def highest_declared(levels: Column, resource: Column) -> Column:
    """Highest declared access to a resource; NULL when it is not declared."""
    mine = F.filter(levels, lambda c: c["resource"] == resource)
    return F.array_max(F.transform(mine, lambda c: c["access"]))


def violation_findings(declared: Column, levels: Column, inferred: Column) -> Column:
    """Inferred capabilities above what is declared; skills declaring nothing are skipped."""
    over = F.filter(inferred, lambda c: F.coalesce(highest_declared(levels, c["resource"]), F.lit(-1)) < c["access"])

    def report(c: Column) -> Column:
        need = F.concat_ws(":", c["resource"], R.level_name(c["access"]))
        allowed = highest_declared(levels, c["resource"])
        limit = F.concat_ws(":", c["resource"], F.coalesce(R.level_name(allowed), F.lit("NONE (undeclared)")))
        return R.finding(
            C.HIGH,
            F.concat(
                F.lit("Capability violation: skill requires "), need, F.lit(" but only declares up to "), limit
            ),
            "privilege_escalation",
            "capability_violation",
            F.concat(F.lit("inferred="), need),
        )

    return F.when(F.size(declared) > 0, F.transform(over, report)).otherwise(R.none())


# --- frames ------------------------------------------------------------------


def analyze(
    skills: DataFrame,
    shell_rules: Sequence[C.Rule] = C.SHELL_RULES,
    code_rules: Sequence[C.Rule] = C.CODE_RULES,
    aliases: Mapping[str, str] | None = None,
) -> DataFrame:
    """Adds ``inferred``, ``findings``, ``findings_count``, ``is_safe`` and ``max_severity``.

    Works unchanged on a streaming frame.
    """
    known = skills.withColumns(
        {
            "inferred": inferred_capabilities(skills),
            "_levels": declared_levels(skills["declared_capabilities"], aliases),
        }
    )
    findings = F.concat(
        shell_findings(known, shell_rules),
        code_findings(known, code_rules),
        url_findings(known),
        env_findings(known),
        flow_findings(known),
        violation_findings(known["declared_capabilities"], known["_levels"], known["inferred"]),
    )
    found = known.withColumn("findings", findings).drop("_levels")
    return found.withColumns(verdict(found["findings"]))


def verdict(findings: Column) -> dict[str, Column]:
    return {
        "findings_count": F.size(findings),
        "is_safe": F.size(findings) == 0,
        "max_severity": F.array_max(F.transform(findings, lambda f: f["severity"])),
    }


def findings_of(results: DataFrame, keep: Sequence[str] = ("seq",)) -> DataFrame:
    """Long table, one row per finding, without the skill's text."""
    return unnest(results, "findings", [*keep, F.col("name").alias("skill_name")])


def detect(skills: DataFrame, findings: Column) -> DataFrame:
    """Long table of one detector's findings."""
    return findings_of(skills.select("seq", "name", findings.alias("findings")))


def capabilities_of(results: DataFrame) -> DataFrame:
    """Long table of inferred capabilities."""
    return unnest(results, "inferred", ["seq", F.col("name").alias("skill_name")])


def keep_severity(results: DataFrame, minimum: int) -> DataFrame:
    """Drop findings below a severity and redo the verdict; capabilities stay."""
    kept = results.withColumn("findings", F.filter("findings", lambda f: f["severity"] >= minimum))
    return kept.withColumns(verdict(kept["findings"]))


def apply_rules(texts: DataFrame, text: str, rules: Sequence[C.Rule], keep: Sequence[str]) -> DataFrame:
    """User rules over any text column, one row per match."""
    blocks = [rules[i : i + RULES_PER_ARRAY] for i in range(0, len(rules), RULES_PER_ARRAY)] or [rules]
    found = F.concat(*[R.rule_hits(F.col(text), block) for block in blocks])
    hits = texts.select(*keep, found.alias("findings"))
    return unnest(hits, "findings", list(keep))


RULES_PER_ARRAY = 200


def rules_from_table(rules: DataFrame) -> list[C.Rule]:
    """Read a rule table (pattern, severity, attack_class, message, flags).

    A catalogue is configuration, compiled into the plan, whatever its length.
    """
    rows = rules.select("pattern", "severity", "attack_class", "message", "flags").collect()
    return [C.Rule(*row) for row in rows]


def explode_texts(skills: DataFrame, column: str, name: str) -> DataFrame:
    return unnest_values(skills, F.col(column), ["seq", F.col("name").alias("skill_name")], name)
