from __future__ import annotations

import numpy as np

from wardline.llm import pq_dedup as P


def brute(rows):
    """vec_id -> (links, component) by all pairs in double precision."""
    good = [
        (i, np.array(x, dtype=np.float32).astype(np.float64), label)
        for i, x, label in rows
        if x is not None and label is not None and len(x) and None not in x and np.isfinite(x).all() and np.any(x)
    ]
    links = {i: 0 for i, *_ in rows}
    parent = {i: i for i, *_ in rows}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for at, (i, x, label) in enumerate(good):
        for j, y, other in good[at + 1 :]:
            if label == other and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.93:
                links[i] += 1
                links[j] += 1
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: (links[i], root(i)) for i in links}


def got(df):
    return {r["vec_id"]: (r["n_links"], r["component_id"]) for r in P.classes(df).collect()}


def test_small_cases_against_all_pairs(spark):
    random = np.random.default_rng(2)
    rows = []
    for group in range(25):
        centre = random.normal(size=16)
        for noise in (0, 0, 0.03, 0.05, 0.08, 0.12, 0.2):
            rows.append((centre + random.normal(size=16) * noise).tolist())
    rows = [(x, int(random.integers(2))) for x in rows]
    rows += [(None, 1), ([], 1), ([0.0] * 16, 1), ([None, 1.0], 1), ([float("nan")] * 16, 1), ([float("inf")] * 16, 0)]
    rows += [([1.0, 2.0], 1), ([2.0, 4.0], 1), ([1.0, 2.0], None), ([1.0, 2.0], 0)]
    rows = [(i, x, label) for i, (x, label) in enumerate(rows)]
    df = spark.createDataFrame([(*r, "n") for r in rows], "vec_id long, embedding array<float>, label int, node string")
    assert got(df) == brute(rows)


def test_blocks_of_long_lists(spark, monkeypatch):
    monkeypatch.setattr(P, "STORED_BLOCK", 16)
    monkeypatch.setattr(P, "QUERY_BLOCK", 32)
    random = np.random.default_rng(3)
    centre = random.normal(size=(3, 16))
    rows = [(i, (centre[i % 3] + random.normal(size=16) * 0.1).tolist(), 0) for i in range(150)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    assert got(df) == brute(rows)


def planted(random, pairs: int, alone: int, size: int) -> np.ndarray:
    """Unit vectors: pairs at a cosine from 0.93 to 0.99, then unrelated ones."""
    x = random.normal(size=(pairs + alone, size))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    side = random.normal(size=(pairs, size))
    side -= (side * x[:pairs]).sum(axis=1, keepdims=True) * x[:pairs]
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    cosine = random.uniform(0.931, 0.99, pairs)[:, None]
    return np.vstack([x[:pairs], cosine * x[:pairs] + np.sqrt(1 - cosine**2) * side, x[pairs:]])


def test_recall_on_a_whole_table(spark):
    """Every link of a table of planted pairs, by brute force; vec_id twice stands for two vectors."""
    random = np.random.default_rng(6)
    x = planted(random, 1500, 3000, 32).astype(np.float32)
    label = np.r_[np.arange(1500) % 3, np.arange(1500) % 3, random.integers(0, 3, 3000)]
    frame = spark.createDataFrame([(i, v, int(c)) for i, (v, c) in enumerate(zip(x.tolist(), label))], "vec_id long, embedding array<float>, label int")
    wide = x.astype(np.float64)
    wide /= np.linalg.norm(wide, axis=1, keepdims=True)
    near = (wide @ wide.T >= 0.93) & (label[:, None] == label[None, :])
    true = near.sum() - len(x)
    found = sum(n for n, _ in got(frame).values())
    assert true >= 3000 and 0.97 * true <= found <= true


def test_probes_meet_with_as_many_lists_as_the_largest_tables_have():
    """A pair is compared if one's own list is probed by the other."""
    random = np.random.default_rng(7)
    x = planted(random, 3000, 9000, 64)
    index = P.Index(64, P.k_means(x[:12_000], P.MOST_LISTS, rounds=3), np.zeros((1, 1, 64)))
    probes = P.encode(index, x[:6000])[0]
    a, b = probes[:3000], probes[3000:]
    met = (a == b[:, :1]).any(axis=1) | (b == a[:, :1]).any(axis=1)
    assert len(index.lists) == 2048 and met.mean() >= 0.95


def test_empty_table(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert got(df) == {}
