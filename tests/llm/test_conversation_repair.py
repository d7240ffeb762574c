from __future__ import annotations

import hashlib
import itertools
import random
import re
import sys
import zlib
from functools import cache

import pytest

from wardline.llm import conversation_repair as cr

sys.setrecursionlimit(20_000)
WHITE = " \t\n\v\f\r"


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        key = ":".join(" " if x is None else str(x) for x in (conv, turn))
        slot = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if slot == 1:
            text = ""
        elif slot == 2:
            text = re.sub("[.!?]", "", text)
        elif slot == 4:
            role = "user"
        out += [(conv, turn, role, text)] * {0: 0, 3: 2}.get(slot, 1)
    return out


def faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        bare = text.strip(WHITE)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "" if bare[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def moves(role, fault):
    """Letter, cost and role left behind of every edit of one row."""
    more = fault == "truncated"
    yield "D", 3, None
    if fault not in ("blank", "duplicate"):
        yield "K", more, role
        yield "R", 2 + more, "user"
        yield "R", 2 + more, "assistant"


def cheapest(rows, found):
    """Least (cost, audit, lines) by trying every edit, with a few inserts in a row."""

    @cache
    def best(i, before, inserts):
        options = [(0, "", ())] if i == len(rows) and before in ("", "a") else []
        if inserts:
            options += [step("I", 2, role, "", i, before, inserts - 1) for role in ("user", "assistant")]
        if i < len(rows):
            for letter, cost, role in moves(rows[i][2], found[i]):
                options.append(step(letter, cost, role, rows[i][3], i + 1, before, 3))
        return min((o for o in options if o), default=None)

    def step(letter, cost, role, text, i, before, inserts):
        if role is not None:
            if (before, role[:1]) not in {("", "s"), ("", "u"), ("s", "u"), ("u", "a"), ("a", "u")}:
                return None
            before = role[:1]
        rest = best(i, before, inserts)
        if rest is None:
            return None
        return cost + rest[0], letter + rest[1], ((f"{role}:{text}",) if role is not None else ()) + rest[2]

    return best(0, "", 3)


def expected(rows):
    want = {}
    damaged_rows = damaged(rows)
    for conv in {r[0] for r in rows}:
        own = [r for r in damaged_rows if r[0] == conv]
        own.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        found = faults(own)
        cost, audit, lines = cheapest(tuple(own), tuple(found))
        turns = [r[1] for r in own if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        pairs = [a[2][:1] + b[2][:1] for a, b in zip(own, own[1:])]
        illegal = sum(p not in ("su", "ua", "au") for p in pairs)
        counts = [found.count(f) for f in ("blank", "duplicate", "truncated")]
        want[conv] = (gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return want


def conversations(n: int, seed: int):
    draw = random.Random(seed)
    rows = []
    for conv in range(n):
        for turn in range(draw.randrange(1, 10)):
            role = draw.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "Assistant"])
            text = draw.choice(["Yes.", "no", " \t\n", "", None, "Why? ", "é.\n", "x" * draw.randrange(1, 9) + ".", "​"])
            rows.append((None if conv == 3 else conv, None if draw.random() < 0.05 else turn * draw.choice([1, 1, 2]), role, text))
    return rows


def test_every_small_case_against_all_edits():
    kinds = [(r, f) for r in ("system", "user", "assistant", "x") for f in range(4)]
    names = ["", "blank", "duplicate", "truncated"]
    for n in range(4):
        for rows in itertools.product(kinds, repeat=n):
            own = [(0, i, r, str(i)) for i, (r, _) in enumerate(rows)]
            cost, audit, _ = cheapest(tuple(own), tuple(names[f] for _, f in rows))
            edits, state, got = cr.walk(cr._kinds([r for r, _ in rows], [f for _, f in rows]), cr.END, 0, True)
            assert (got, "".join(e[0] for e in edits)) == (cost, audit) and state in (0, 3)


def test_pieces_give_the_walk_of_the_whole():
    draw = random.Random(7)
    for _ in range(300):
        n = draw.randrange(0, 60)
        rows = cr._kinds([draw.choice(["system", "user", "assistant", "x"]) for _ in range(n)], [draw.randrange(4) for _ in range(n)])
        edits, _, cost = cr.walk(rows, cr.END, 0, True)
        cuts = sorted(draw.sample(range(n + 1), min(3, n + 1)))
        parts = [rows[a:b] for a, b in zip([0, *cuts], [*cuts, n])]
        ends = [list(cr.END)]
        for part in reversed(parts[1:]):
            table = cr.costs_between(part)
            ends.insert(0, [min(table[4 * s + e] + ends[0][e] for e in range(4)) for s in range(4)])
        state, letters = 0, ""
        for i, (part, end) in enumerate(zip(parts, ends)):
            own, state, to_go = cr.walk(part, end, state, i == len(parts) - 1)
            letters += "".join(e[0] for e in own)
            assert i or to_go == cost
        assert letters == "".join(e[0] for e in edits)


@pytest.mark.parametrize("limit, parts", [(20_000, 4), (2, 7)])
def test_equal_to_brute_force(spark, monkeypatch, limit, parts):
    monkeypatch.setattr(cr, "PIECE_ROWS", limit)
    rows = conversations(120, seed=limit)
    rows += [(900, t, "user" if t % 2 else "assistant", f"{t % 11}.") for t in range(150)]  # over many pieces
    rows += [(901, 5, "user", "again.")] * 40
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(parts)
    found = cr.repair(*cr.damaged(df)).collect()
    want = expected(rows)
    assert len(found) == len(want)
    for r in found:
        assert tuple(r[1:]) == want[r["conv_id"]], r["conv_id"]


def test_given_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    rows = [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in df.collect()]
    got = {r["conv_id"]: tuple(r[1:]) for r in cr.repair(*cr.damaged(df)).collect()}
    assert got == expected(rows)


def test_empty_dropped_clashing_and_long(spark):
    schema = "conv_id long, turn long, role string, text string, piece string, copies string"
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    fine = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 9)
    df = spark.createDataFrame([(gone, 0, "user", "x.", "p", "c"), (fine, 0, "user", "y" * 5_000_000, "p", "c")], schema)
    got = {r["conv_id"]: tuple(r[1:]) for r in cr.repair(*cr.damaged(df)).collect()}
    assert got[gone] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert got[fine] == (0, 0, 0, 1, 0, 3, "D", hashlib.sha256(b"").hexdigest())
    assert cr.repair(*cr.damaged(df.limit(0))).count() == 0
