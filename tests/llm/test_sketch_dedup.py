from __future__ import annotations

import re
from collections import defaultdict
from itertools import combinations

import numpy as np

from wardline.llm import sketch_dedup as S


def shingles(text: str | None, size: int) -> frozenset:
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1)))


def brute(rows, size: int):
    """doc_id -> (n_shingles, component): all pairs that share a shingle."""
    sets = {i: shingles(t, size) for i, t in rows}
    holders = defaultdict(list)
    for i, own in sets.items():
        for x in own:
            holders[x].append(i)
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for a, b in {p for held in holders.values() for p in combinations(held, 2)}:
        common = len(sets[a] & sets[b])
        if 100 * common >= 80 * (len(sets[a]) + len(sets[b]) - common):
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return {i: (len(own), root(i)) for i, own in sets.items()}


def near(random, words, share):
    return [w if random.random() > share else f"new{random.integers(1e9)}" for w in words]


def test_against_all_pairs(spark):
    random = np.random.default_rng(0)
    rows = []
    for group in range(12):
        base = [f"w{random.integers(400)}" for _ in range(int(random.integers(4, 150)))]
        rows += [" ".join(near(random, base, share)) for share in (0, 0, 0.01, 0.02, 0.03, 0.04, 0.05, 0.08)]
    chain = [f"c{i}" for i in range(400)]
    rows += [" ".join(chain[k * 15 : k * 15 + 200]) for k in range(12)]
    rows += [None, "", " \n", "one", "ONE", "One two", "one two"]
    rows = list(enumerate(rows))
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, node int")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in S.classes(df, 4).collect()}
    assert got == brute(rows, 4)


def test_one_bucket_of_many_distinct_copies(spark, monkeypatch):
    """Hundreds of texts alike between 0.6 and 1 share buckets and fall into many components; blocks are small."""
    monkeypatch.setattr(S, "BLOCK_NODES", 150)
    random = np.random.default_rng(5)
    base = [f"w{i}" for i in range(150)]
    rows = [" ".join(near(random, base, share)) for share in random.uniform(0, 0.08, 700)]
    rows += [" ".join(base[:140] + [f"end{k}", f"fin{k}"]) for k in range(60)]
    rows = list(enumerate(rows))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in S.classes(df, 4).collect()}
    want = brute(rows, 4)
    assert got == want and 20 < len({c for _, c in want.values()}) < 740


def test_a_very_long_text(spark):
    text = " ".join(f"w{i}" for i in range(200_000))
    df = spark.createDataFrame([(1, text), (2, text.replace("w777 ", "z ")), (3, text[: len(text) // 2])], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in S.classes(df, 4).collect()}
    assert got == {1: (199_997, 1), 2: (199_997, 1), 3: (got[3][0], 3)}


def test_whole_table_against_all_pairs(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
    got = S.classes(df, 4).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute(rows, 4)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_every_bin_fills_and_equal_bins_estimate_similarity():
    random = np.random.default_rng(1)
    values = random.integers(0, 2**63, 1500).astype(np.uint64)
    row = np.repeat([0, 1, 2], [900, 900, 1])
    elements = np.concatenate([values[:900], values[100:1000], values[:1]])
    bins = S.sketch(row, elements, 3)
    assert (bins != np.iinfo(np.uint64).max).all()
    assert abs((bins[0] == bins[1]).mean() - 0.8) < 0.08


def test_deduplicate_keeps_one_of_each_group(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(5, text), (3, text.upper()), (5, text), (None, text), (None, None), (None, None), (7, "a b"), (7, "c d"), (8, " ")]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, _key string")
    got = S.deduplicate(df).collect()
    assert sorted((r["doc_id"], r["text"]) for r in got if r["doc_id"]) == [(3, text.upper()), (7, "a b"), (7, "c d"), (8, " ")]
    assert sum(r["doc_id"] is None for r in got) == 2


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert S.classes(df).count() == 0 and S.deduplicate(df).count() == 0


def test_packed_sketches_count_equal_bins(spark):
    random = np.random.default_rng(4)
    row = np.repeat([0, 1], 500)
    values = random.integers(0, 2**63, 600).astype(np.uint64)
    bins = S.sketch(row, np.concatenate([values[:500], values[100:]]), 2)
    packed = S.packed_bands(bins)
    df = spark.createDataFrame([(packed[0].tolist(), packed[1].tolist())], "a array<long>, b array<long>")
    got = df.select(S.equal_bins(S.F.col("a"), S.F.col("b")).alias("n"), S.first_common(S.F.col("a"), S.F.col("b")).alias("i")).first()
    short = S.mix(bins) >> np.uint64(64 - S.BITS)
    assert got["n"] == (short[0] == short[1]).sum()
    common = np.flatnonzero(packed[0] == packed[1])
    assert got["i"] == (common[0] if len(common) else -1)
