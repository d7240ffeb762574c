"""Graph operators against brute force, both cycle methods included."""

from __future__ import annotations

import random

import pytest

from wardline.operators import graph


def closure(edges):
    out = {}
    for a, b in edges:
        out.setdefault(a, set()).add(b)
    reached = {}
    for start in out:
        seen, todo = set(), list(out[start])
        while todo:
            node = todo.pop()
            if node not in seen:
                seen.add(node)
                todo += out.get(node, ())
        reached[start] = seen
    return reached


def cycles(edges):
    reached = closure(edges)
    on = {n for n in reached if n in reached[n]}
    return {n: min(m for m in on if m in reached[n] and n in reached[m]) for n in on}


def frame(spark, edges):
    return spark.createDataFrame(sorted(edges), "src long, dst long")


def random_edges(seed, nodes, count):
    rng = random.Random(seed)
    return {(rng.randrange(nodes), rng.randrange(nodes)) for _ in range(count)}


CASES = [
    {(1, 2), (2, 3), (3, 1), (3, 4), (4, 5)},
    {(1, 1), (2, 3)},
    {(1, 2), (2, 1), (2, 3), (3, 4), (4, 3), (4, 4), (9, 1), (4, 8)},
    {(1, 2), (2, 3)},
    random_edges(7, 60, 75),
]


@pytest.mark.parametrize("case", range(len(CASES)))
def test_cycles(spark, case):
    found = graph.cycle_groups(frame(spark, CASES[case])).collect()
    assert {r.node: r.cycle for r in found} == cycles(CASES[case])
    assert len(found) == len(cycles(CASES[case]))


def test_transitive_on_cyclic_graph(spark):
    edges = random_edges(3, 30, 45)
    got = {(r.root, r.node) for r in graph.transitive(frame(spark, edges)).collect()}
    assert got == {(a, b) for a, reached in closure(edges).items() for b in reached if a != b}


def test_transitive_from_given_roots(spark):
    roots = spark.createDataFrame([(1,)], "root long")
    got = graph.transitive(frame(spark, {(1, 2), (2, 3), (5, 6)}), roots).collect()
    assert {(r.root, r.node) for r in got} == {(1, 2), (1, 3)}


def test_affected_does_not_walk_through_vulnerable_nodes(spark):
    edges = {(1, 2), (2, 3), (4, 3), (5, 4), (6, 5)}
    bad = spark.createDataFrame([(3,), (4,)], "node long")
    got = {(r.node, r.cause) for r in graph.affected(frame(spark, edges), bad).collect()}
    assert got == {(2, 3), (1, 3), (5, 4), (6, 4)}


def test_trust_settles_bottom_up_and_reports_cycles(spark):
    nodes = spark.createDataFrame([(1, 0.5), (2, 0.8), (3, 1.0), (4, 0.9), (5, 0.7), (6, 0.6), (7, 0.4)], "node long, intrinsic double")
    edges = {(1, 2), (1, 3), (2, 3), (4, 5), (5, 4), (6, 4), (7, 99)}
    got = {r.node: r.effective for r in graph.lowest_trust(nodes, frame(spark, edges)).collect()}
    assert got == {3: 1.0, 2: 0.8, 1: pytest.approx(0.4), 4: None, 5: None, 6: None, 7: None}


def test_a_round_deals_out_its_candidates_alone(spark, monkeypatch):
    """What was seen is read in its buckets: neither exchanged nor sorted."""
    plans = []
    append = graph.Stages.append_bucketed

    def kept(self, df, *more):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return append(self, df, *more)

    monkeypatch.setattr(graph.Stages, "append_bucketed", kept)
    edges = {(i, i // 2) for i in range(1, 40)}
    found = {tuple(r) for r in graph.transitive(frame(spark, edges)).collect()}
    assert found == {(a, b) for a, reached in closure(edges).items() for b in reached if a != b}
    for plan in plans[1:]:
        assert "Sort " not in plan and plan.count("Exchange hashpartitioning(root") <= 2
        assert "Bucketed: true" in plan and "Bucketed: false" not in plan
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("transitive")]


def test_edges_with_a_null_end_lead_nowhere(spark):
    edges = spark.createDataFrame([(1, 2), (2, None), (None, 3), (2, 3)], "src long, dst long")
    assert {tuple(r) for r in graph.transitive(edges).collect()} == {(1, 2), (1, 3), (2, 3)}
