from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import pytest

from wardline.llm import sharding


def check(rows, got, shards):
    assert Counter(r["text_crc32"] for r in got) == Counter(zlib.crc32((t or "").encode()) for _, t in rows)
    assert sum(r["size"] for r in got) == sum(len((t or "").encode()) + 1 for _, t in rows)
    slots, homes = defaultdict(list), defaultdict(set)
    for r in got:
        assert 0 <= r["shard"] < shards
        slots[r["shard"]].append(r["slot"])
        homes[r["text_crc32"], r["size"]].add(r["shard"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(h) == 1 for h in homes.values())


def loads(got):
    total = Counter()
    for r in got:
        total[r["shard"]] += r["size"]
    return total


@pytest.mark.parametrize("parts", [256, 2])
def test_groups_stay_together_and_sizes_are_near_equal(spark, parts):
    rows = [(i, "x" * (i * 7919 % 400)) for i in range(800)] + [(i, "same") for i in range(300)] + [(None, None), (None, "")]
    df = spark.createDataFrame([(i, t, "s", 1) for i, t in rows], "doc_id long, text string, shard string, _row int")
    result = sharding.shard(df, 4, parts=parts)
    assert result.columns == ["doc_id", "_row", "size", "text_crc32", "shard", "slot"]
    got = result.collect()
    check(rows, got, 4)
    assert max(loads(got).values()) - min(loads(got).values()) <= (1600 if parts == 256 else 20_000)


def test_scheduling_is_largest_first_to_the_least_loaded():
    sizes = [5, 5, 4, 4, 3, 3, 3]
    placed = sharding.schedule(sizes, 3)
    load = [sum(s for s, p in zip(sizes, placed) if p == k) for k in range(3)]
    assert sorted(load) == [8, 8, 11]


def test_slots_are_gapless_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(sharding, "ROWS_PER_BLOCK", 3)
    rows = [(i % 40, f"t{i % 25}") for i in range(1000)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), 3).collect()
    check(rows, got, 3)


def test_whole_table(spark):
    from wardline.llm import queries

    sf_dir = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = queries.op2(spark, sf_dir).collect()
    check(rows, got, 8)
    spread = loads(got)
    assert max(spread.values()) - min(spread.values()) <= max(len(t.encode()) + 1 for _, t in rows)
    assert {(r["law"], r["grown_shard"]) for r in got} == {("bytes", None)}


def test_empty_table(spark):
    assert sharding.shard(spark.createDataFrame([], "doc_id long, text string")).count() == 0
