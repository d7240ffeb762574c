from __future__ import annotations

import hashlib
import math
import re
from collections import defaultdict
from fractions import Fraction

from wardline.llm import mixing


def brute_mix(rows):
    """doc_id -> (size, source_size, target, taken), in plain Python with exact shares."""
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, _, t in rows}
    held = defaultdict(int)
    for i, source, _ in rows:
        held[source] += size[i]
    names = sorted(held, key=lambda s: (s is None, s or ""))
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    target, open_names = {}, list(names)
    total = Fraction(sum(held.values()))
    while True:
        rest = total - sum(target.values())
        parts = sum(weight[s] for s in open_names)
        above = [s for s in open_names if rest * weight[s] / parts > 3 * held[s]]
        if not above:
            break
        for s in above:
            target[s] = Fraction(3 * held[s])
        open_names = [s for s in open_names if s not in above]
    target |= {s: rest * weight[s] / parts for s in open_names}
    out = {}
    for source in names:
        own = [i for i, s, _ in rows if s == source]
        own.sort(key=lambda i: (hashlib.md5(f"{i}:{size[i]}".encode()).hexdigest(), i))
        goal, before = math.floor(target[source]), 0
        passes = goal // held[source] if held[source] else 0
        for i in own:
            extra = max(0, min(size[i], goal - passes * held[source] - before))
            out[i] = (size[i], held[source], float(target[source]), passes * size[i] + extra)
            before += size[i]
    return out


def words(n):
    return " ".join(["w"] * n)


def test_against_plain_version(spark):
    rows = [(i, f"s{i % 7}" if i % 9 else None, words(i * 37 % 101)) for i in range(120)]
    rows += [(200, "tiny", "one two"), (201, "none", None), (202, "none", " \n"), (203, "é", words(900))]
    df = spark.createDataFrame([(*r, 1, 2.0) for r in rows], "doc_id long, source string, text string, size int, target double")
    planned = mixing.plan(df, ["doc_id"])
    got = {r["doc_id"]: (r["size"], r["source_size"], r["target"], r["taken"]) for r in planned.collect()}
    want = brute_mix(rows)
    assert {i: (a, b, d) for i, (a, b, _, d) in got.items()} == {i: (a, b, d) for i, (a, b, _, d) in want.items()}
    assert all(abs(got[i][2] - want[i][2]) < 1e-6 for i in want)
    assert all(t <= 3 * s for s, _, _, t in got.values())


def test_positions_follow_the_schedules(spark):
    rows = [(i, f"s{i % 3}", words(50)) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    planned = mixing.plan(df, ["doc_id", "source"]).where("taken > 0").collect()
    middle = defaultdict(list)
    for r in planned:
        assert 0 <= r["position"] <= 1
        middle[r["source"]] += [c["position"] for c in r["_copies"]]
    mean = {s: sum(p) / len(p) for s, p in middle.items()}
    assert mean["s2"] < mean["s0"] < mean["s1"]
    assert mixing.mix(df).columns == df.columns


def test_repeated_rows_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "a", words(10))] * 3 + [(None, None, words(5))], "doc_id long, source string, text string")
    taken = [r["taken"] for r in mixing.plan(df, []).collect()]
    assert len(taken) == 4 and sum(taken) == 35
    none = spark.createDataFrame([], "doc_id long, source string, text string")
    assert mixing.plan(none, ["doc_id"]).count() == 0 and mixing.mix(none).count() == 0


def test_first_words(spark):
    df = spark.createDataFrame([(" a b\n\tc  d ", 3)], "text string, n int")
    assert df.select(mixing.first_words(mixing.F.col("text"), mixing.F.col("n"))).first()[0] == " a b\n\tc"
