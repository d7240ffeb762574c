"""Rule catalogues compiled to one projection.

Patterns are literals, so each is compiled once per task, and one pass over a
row yields an array of findings. Nothing is joined: rules never meet texts in a
nested loop, and the work stays in the stage that read the row.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from wardline.functions import catalog as C
from wardline.functions.text import any_of, literals, matches, rx
from wardline.schemas import FINDINGS_TYPE


def finding(
    severity: int, message: Column | str, attack_class: str, finding_type: str, evidence: Column | str
) -> Column:
    text = [v if isinstance(v, Column) else F.lit(v) for v in (message, evidence)]
    return F.struct(
        F.lit(severity).alias("severity"),
        text[0].alias("message"),
        F.lit(attack_class).alias("attack_class"),
        F.lit(finding_type).alias("finding_type"),
        text[1].alias("evidence"),
    )


def collect(*candidates: Column) -> Column:
    """Array of the candidates that are not NULL."""
    if not candidates:
        return none()
    return F.array_compact(F.array(*candidates)).cast(FINDINGS_TYPE)


def none() -> Column:
    return F.array().cast(FINDINGS_TYPE)


def rule_hits(text: Column, rules: Sequence[C.Rule]) -> Column:
    """One finding per rule that matches, with the whole text as evidence.

    A rule that heeds case runs only where one of its leads is in the text.
    """

    def test(rule: C.Rule) -> Column:
        found = matches(text, rule.pattern, rule.flags)
        return any_of(text, rule.leads) & found if rule.leads and "(?" not in rule.pattern and not rule.flags else found

    return collect(
        *[
            F.when(
                test(r),
                finding(r.severity, r.message, r.attack_class, "pattern_match", text),
            )
            for r in rules
        ]
    )


def rule_hits_each(texts: Column, rules: Sequence[C.Rule]) -> Column:
    """Rule hits of every element, in element order then rule order."""
    if not rules:
        return none()
    return F.flatten(F.transform(texts, lambda t: rule_hits(t, rules)))


# The letters beside A-Z and a-z that patterns blind to case take for ASCII ones.
_OTHER_CASES = "\u017f\u0130\u0131\u212a"


def first_match_hits(
    text: Column, rules: Sequence[C.Rule], finding_type: str = "pattern_match", limit: int = 120
) -> Column:
    """One finding per matching rule; evidence is the first match, cut for display.

    Patterns blind to case cost far more than looking for a fixed text. A text is lowered
    once, and a rule's pattern runs only where one of its leads is in it.
    """

    def hit(rule: C.Rule, low: Column) -> Column:
        found = F.substring(F.regexp_extract(text, rx(rule.pattern, rule.flags), 0), 1, limit)
        test = matches(text, rule.pattern, rule.flags)
        if rule.leads:
            test = F.coalesce(any_of(low, rule.leads), F.lit(True)) & test
        return F.when(test, finding(rule.severity, rule.message, rule.attack_class, finding_type, found))

    if not any(rule.leads for rule in rules):
        return collect(*[hit(r, text) for r in rules])
    # A lambda's parameter is evaluated once; NULL where lowering may hide a lead.
    other = (F.octet_length(text) > F.length(text)) & reduce(Column.__or__, [text.contains(c) for c in _OTHER_CASES])
    low = F.when(~other, F.lower(text))
    return F.flatten(F.transform(F.array(low), lambda one: collect(*[hit(r, one) for r in rules])))


_LEVELS = [C.ACCESS_NAMES[level] for level in sorted(C.ACCESS_NAMES)]
_SEVERITIES = [C.SEVERITY_NAMES[severity] for severity in sorted(C.SEVERITY_NAMES)]


def level_name(level: Column) -> Column:
    return F.get(literals(_LEVELS), level)


def level_value(name: Column) -> Column:
    """Access level of an upper-case name, NULL for an unknown one."""
    return F.nullif(F.array_position(literals(_LEVELS), name), F.lit(0)) - 1


def severity_name(severity: Column) -> Column:
    return F.get(literals(_SEVERITIES), severity - 1)
