"""Queries over trust signals, evidence and chains."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardline.operators import graph, trust
from workloads import fixtures as fx
from workloads import oracle as o
from workloads.cases import case

_OWN = "least(1, greatest(0, 0.3e0*provenance + 0.3e0*behavioral + 0.2e0*community + 0.2e0*historical))"
_SIGNALS = ("signals", fx.PART_SIGNALS)
_SCORED = ("scored", f"SELECT *, {_OWN} AS intrinsic FROM signals")
LEVEL = (
    "CASE WHEN {0} >= 0.75 THEN 'FORMALLY_VERIFIED' WHEN {0} >= 0.5 THEN 'COMMUNITY_VERIFIED'"
    " WHEN {0} >= 0.25 THEN 'SIGNED' ELSE 'UNSIGNED' END"
)
LEVEL_NUMBER = "CASE WHEN {0} >= 0.75 THEN 3 WHEN {0} >= 0.5 THEN 2 WHEN {0} >= 0.25 THEN 1 ELSE 0 END"


def scored(spark, sf_dir):
    return trust.score(fx.derive(spark, sf_dir, fx.PART_SIGNALS))


@case("trust_intrinsic", o.with_(_SIGNALS, _SCORED) + "SELECT node, round(intrinsic, 6) AS intrinsic FROM scored")
def trust_intrinsic(spark, sf_dir):
    return scored(spark, sf_dir).select("node", F.round("intrinsic", 6).alias("intrinsic"))


@case(
    "trust_effective",
    o.with_(_SIGNALS, _SCORED, ("edges", fx.DEP_EDGES))
    + "SELECT s.node, round(s.intrinsic * coalesce(min(d.intrinsic), 1), 6) AS effective FROM scored s"
    " LEFT JOIN edges e ON e.src = s.node LEFT JOIN scored d ON d.node = e.dst GROUP BY s.node, s.intrinsic",
)
def trust_effective(spark, sf_dir):
    own = scored(spark, sf_dir)
    known = own.select("node", F.col("intrinsic").alias("effective"))
    found = trust.effective(own, fx.derive(spark, sf_dir, fx.DEP_EDGES), known)
    return found.select("node", F.round("effective", 6).alias("effective"))


@case(
    "trust_level",
    o.with_(_SIGNALS, _SCORED)
    + f"SELECT node, {LEVEL_NUMBER.format('intrinsic')} AS level, {LEVEL.format('intrinsic')} AS level_name FROM scored",
)
def trust_level(spark, sf_dir):
    score = F.col("intrinsic")
    return scored(spark, sf_dir).select("node", trust.level(score).alias("level"), trust.level_name(score).alias("level_name"))


@case(
    "trust_chain",
    o.with_(("signals", fx.CHAIN_SIGNALS), _SCORED)
    + "SELECT chain, position, round(product(intrinsic) OVER (PARTITION BY chain ORDER BY position), 6) AS effective FROM scored",
)
def trust_chain(spark, sf_dir):
    rows = trust.score(fx.derive(spark, sf_dir, fx.CHAIN_SIGNALS)).select("chain", "position", "intrinsic")
    # Small blocks, so that chains of this data set span several of them.
    found = trust.chain(rows, "chain", "position", block_rows=1000)
    return found.select("chain", "position", F.round("effective", 6).alias("effective"))


@case(
    "trust_dag",
    f"WITH RECURSIVE signals AS ({fx.PART_SIGNALS}), scored AS (SELECT *, {_OWN} AS intrinsic FROM signals),"
    f" edges AS ({fx.DEP_EDGES}), paths(node, effective) AS ("
    " SELECT node, intrinsic FROM scored WHERE node NOT IN (SELECT src FROM edges) UNION"
    " SELECT s.node, s.intrinsic * p.effective FROM paths p JOIN edges e ON e.dst = p.node JOIN scored s ON s.node = e.src)"
    f" SELECT node, round(min(effective), 6) AS effective, {LEVEL.format('min(effective)')} AS level FROM paths GROUP BY node",
)
def trust_dag(spark, sf_dir):
    found = graph.lowest_trust(scored(spark, sf_dir), fx.derive(spark, sf_dir, fx.DEP_EDGES))
    return found.select(
        "node", F.round("effective", 6).alias("effective"), trust.level_name(F.col("effective")).alias("level")
    )


@case(
    "trust_decay",
    o.with_(("signals", fx.TRUST_SIGNALS), _SCORED)
    + "SELECT node, round(effective, 6) AS effective, "
    + LEVEL.format("effective")
    + " AS level FROM (SELECT node, intrinsic * exp(-0.01e0 * greatest(0,"
    " (epoch_us(TIMESTAMP '2002-01-01 00:00:00') - epoch_us(last_update)) / 86400000000.0e0)) AS effective FROM scored)",
)
def trust_decay(spark, sf_dir):
    rows = trust.score(fx.derive(spark, sf_dir, fx.TRUST_SIGNALS))
    now = F.lit("2002-01-01 00:00:00").cast("timestamp_ntz")
    effective = trust.decayed(F.col("intrinsic"), F.col("last_update"), now)
    found = rows.select("node", effective.alias("effective"))
    return found.select(
        "node", F.round("effective", 6).alias("effective"), trust.level_name(F.col("effective")).alias("level")
    )


_GOOD = "signal IN ('provenance','behavioral','community','historical') AND delta >= 0"
_RAISED = ", ".join(
    f"round(least(1, 0.5e0 + coalesce(sum(delta) FILTER (signal = '{s}'), 0)), 6) AS {s}"
    for s in ("provenance", "behavioral", "community", "historical")
)


@case(
    "trust_evidence",
    o.with_(("evidence", fx.TRUST_EVIDENCE))
    + f"SELECT n.node, {_RAISED} FROM (SELECT DISTINCT node FROM evidence) n LEFT JOIN"
    f" (SELECT * FROM evidence WHERE {_GOOD}) g USING (node) GROUP BY n.node",
)
def trust_evidence(spark, sf_dir):
    evidence = fx.derive(spark, sf_dir, fx.TRUST_EVIDENCE)
    neutral = evidence.select("node").distinct().select("node", *[F.lit(0.5).alias(s) for s in trust.C.TRUST_SIGNALS])
    raised = trust.with_evidence(neutral, evidence)
    return raised.select("node", *[F.round(s, 6).alias(s) for s in trust.C.TRUST_SIGNALS])


@case(
    "evidence_quarantine",
    o.with_(("evidence", fx.TRUST_EVIDENCE))
    + f"SELECT seq, node, signal, round(delta, 6) AS delta FROM evidence WHERE NOT ({_GOOD})",
)
def evidence_quarantine(spark, sf_dir):
    _, rejected = trust.split_evidence(fx.derive(spark, sf_dir, fx.TRUST_EVIDENCE))
    return rejected.select("seq", "node", "signal", F.round("delta", 6).alias("delta"))


@case(
    "trust_validate",
    "SELECT c_custkey, c_acctbal BETWEEN 0 AND 10000 AS valid FROM customer",
)
def trust_validate(spark, sf_dir):
    """Account balances as a signal: negative ones are out of range."""
    fx.load(spark, sf_dir, "customer")
    half = F.lit(0.5)
    signals = spark.table("customer").select(
        "c_custkey",
        (F.col("c_acctbal") / 10000.0).alias("provenance"),
        half.alias("behavioral"),
        half.alias("community"),
        half.alias("historical"),
    )
    return signals.select("c_custkey", trust.valid_signals().alias("valid"))


@case(
    "trust_compare",
    o.with_(_SIGNALS, ("edges", fx.DEP_EDGES))
    + "SELECT e.src, e.dst, a.provenance >= b.provenance AND a.behavioral >= b.behavioral AND a.community >= b.community"
    " AND a.historical >= b.historical AS at_least FROM edges e JOIN signals a ON a.node = e.src JOIN signals b ON b.node = e.dst",
)
def trust_compare(spark, sf_dir):
    signals = fx.derive(spark, sf_dir, fx.PART_SIGNALS)
    names = trust.C.TRUST_SIGNALS
    left = signals.select(F.col("node").alias("src"), *[F.col(s).alias(f"a_{s}") for s in names])
    right = signals.select(F.col("node").alias("dst"), *[F.col(s).alias(f"b_{s}") for s in names])
    pairs = fx.derive(spark, sf_dir, fx.DEP_EDGES).join(left, "src").join(right, "dst")
    return pairs.select("src", "dst", trust.at_least([f"a_{s}" for s in names], [f"b_{s}" for s in names]).alias("at_least"))
