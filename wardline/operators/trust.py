"""Trust scores: weighted signals, dependency chains, decay, evidence, levels."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.functions import catalog as C
from wardline.plans.shape import running_in_blocks


def check_weights(weights: Mapping[str, float]) -> None:
    if set(weights) != set(C.TRUST_SIGNALS) or any(w < 0 for w in weights.values()):
        raise ValueError(f"weights must be non-negative and name exactly {C.TRUST_SIGNALS}")
    if abs(sum(weights.values()) - 1.0) > 1e-6:
        raise ValueError("weights must sum to 1")


def clamp(score: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))


def valid_signals() -> Column:
    """True when all four signals are numbers in [0, 1]."""
    checks = [F.coalesce(F.col(s).between(0.0, 1.0) & ~F.isnan(F.col(s)), F.lit(False)) for s in C.TRUST_SIGNALS]
    return checks[0] & checks[1] & checks[2] & checks[3]


def intrinsic(weights: Mapping[str, float] = C.TRUST_WEIGHTS) -> Column:
    check_weights(weights)
    terms = [F.lit(float(weights[s])) * F.col(s) for s in C.TRUST_SIGNALS]
    return clamp(terms[0] + terms[1] + terms[2] + terms[3])


def level(score: Column) -> Column:
    named = F
    for floor, value, _ in C.TRUST_LEVELS:
        named = named.when(score >= floor, value)
    return named.otherwise(C.TRUST_FLOOR[0])


def level_name(score: Column) -> Column:
    named = F
    for floor, _, name in C.TRUST_LEVELS:
        named = named.when(score >= floor, name)
    return F.when(score.isNotNull(), named.otherwise(C.TRUST_FLOOR[1]))


def score(signals: DataFrame, weights: Mapping[str, float] = C.TRUST_WEIGHTS) -> DataFrame:
    """Adds ``intrinsic`` to the rows with valid signals."""
    return signals.where(valid_signals()).withColumn("intrinsic", intrinsic(weights))


def effective(nodes: DataFrame, edges: DataFrame, known: DataFrame) -> DataFrame:
    """One propagation step: own score times the lowest ``effective`` among direct dependencies.

    ``known`` holds ``node, effective`` of the dependencies. The lowest score is
    reduced before it meets the nodes, so a node with very many dependencies
    costs one partial aggregate, not one task.
    """
    scores = known.select(F.col("node").alias("dst"), F.col("effective").alias("_dep"))
    lowest = edges.join(scores, "dst").groupBy(F.col("src").alias("node")).agg(F.min("_dep").alias("_low"))
    joined = nodes.join(lowest, "node", "left")
    value = clamp(F.col("intrinsic") * F.coalesce(F.col("_low"), F.lit(1.0)))
    return joined.withColumn("effective", value).drop("_low")


CHAIN_BLOCK = 100_000


def chain(rows: DataFrame, key: str, position: str, block_rows: int = CHAIN_BLOCK) -> DataFrame:
    """Effective score along ordered chains, each link depending on all before it.

    No score exceeds an earlier one, so the lowest is always the one just
    before, and the effective score is the running product of ``intrinsic``.
    It is taken in blocks of positions, so a chain of any length stays parallel.
    """
    blocks = rows.withColumn("_slot", F.floor(F.col(position) / F.lit(block_rows)))
    run = running_in_blocks(
        blocks,
        keys=[key],
        block=["_slot"],
        order=[F.col(position)],
        block_order=[F.col("_slot")],
        per_row=F.product(F.col("intrinsic")),
        per_block=F.product(F.col("intrinsic")),
        across=F.product(F.col("_block")),
    )
    value = F.col("_within") * F.coalesce(F.col("_before"), F.lit(1.0))
    return run.select(*rows.columns, value.alias("effective"))


def decayed(effective: Column, last_update: Column, now: Column, rate: float = C.DECAY_PER_DAY) -> Column:
    """Exponential decay by days since the last update; updates in the future do not decay."""
    days = F.timestamp_diff("MICROSECOND", last_update, now).cast("double") / F.lit(86_400_000_000.0)
    return clamp(effective * F.exp(F.lit(-rate) * F.greatest(F.lit(0.0), days)))


def split_evidence(evidence: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Usable evidence rows, and rows with an unknown signal or a negative delta."""
    good = F.coalesce(F.col("signal").isin(*C.TRUST_SIGNALS) & (F.col("delta") >= 0), F.lit(False))
    return evidence.where(good), evidence.where(~good)


def evidence_totals(evidence: DataFrame, key: str = "node") -> DataFrame:
    """Summed delta per key and signal, one column per signal.

    Deltas are not negative, so clamping after every step equals clamping the
    sum: the order of evidence does not matter and sums combine map-side.
    """
    wide = evidence.groupBy(key).agg(
        *[F.coalesce(F.sum(F.when(F.col("signal") == s, F.col("delta"))), F.lit(0.0)).alias(s) for s in C.TRUST_SIGNALS]
    )
    return wide


def with_evidence(signals: DataFrame, evidence: DataFrame, key: str = "node") -> DataFrame:
    """Signals raised by their evidence, each held to 1."""
    good, _ = split_evidence(evidence)
    totals = evidence_totals(good, key).select(key, *[F.col(s).alias(f"_{s}") for s in C.TRUST_SIGNALS])
    joined = signals.join(totals, key, "left")
    raised = {s: F.least(F.lit(1.0), F.col(s) + F.coalesce(f"_{s}", F.lit(0.0))) for s in C.TRUST_SIGNALS}
    return joined.withColumns(raised).select(*signals.columns)


def behavioral(findings: Column) -> Column:
    """Signal from a skill's findings: 1 less a penalty per finding, not below 0."""

    def penalty(found: Column) -> Column:
        cost = F.when(found["severity"] == C.LOW, C.FINDING_PENALTY[C.LOW])
        for severity in (C.MEDIUM, C.HIGH, C.CRITICAL):
            cost = cost.when(found["severity"] == severity, C.FINDING_PENALTY[severity])
        return cost

    total = F.aggregate(findings, F.lit(0.0), lambda acc, f: acc + penalty(f))
    return F.greatest(F.lit(0.0), F.lit(1.0) - total)


def scan_scores(results: DataFrame, weights: Mapping[str, float] = C.TRUST_WEIGHTS) -> DataFrame:
    """Adds ``trust_score`` and ``trust_level`` to analysed skills; signals a scan cannot measure are neutral."""
    check_weights(weights)
    neutral = sum(weights[s] * C.NEUTRAL_SIGNAL for s in C.TRUST_SIGNALS if s != "behavioral")
    score = clamp(F.lit(neutral) + F.lit(float(weights["behavioral"])) * behavioral(F.col("findings")))
    scored = results.withColumn("trust_score", score)
    return scored.withColumn("trust_level", level_name(F.col("trust_score")))


def at_least(left: Sequence[str], right: Sequence[str]) -> Column:
    """Component-wise comparison of two signal vectors given as column names."""
    checks = [F.col(a) >= F.col(b) for a, b in zip(left, right, strict=True)]
    result = checks[0]
    for check in checks[1:]:
        result = result & check
    return result
