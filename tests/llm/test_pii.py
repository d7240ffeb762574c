from __future__ import annotations

import hashlib
import re

from wardline.llm import pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits: str) -> bool:
    doubled = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
    return sum(d - 9 * (d > 9) for d in doubled) % 10 == 0


def valid(kind: str, match: str) -> bool:
    digits = re.sub("[^0-9]", "", match)
    if kind == "ip":
        return all(int(p) <= 255 for p in match.split("."))
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 9 <= len(digits) <= 15


def expected(text: str | None) -> list[str]:
    return [
        f"{kind}:{m.start()}:{m.end()}"
        for kind, pattern in PLAIN.items()
        for m in re.finditer(pattern, text or "")
        if valid(kind, m[0])
    ]


CASES = [
    None,
    "",
    "a@b.c@d.e and a@b.com_x@y.org, x@y, @z.w, a..b@c-d.e.f.",
    "é ü 1.2.3.4.5.6.7.8 001.0255.3.4 999.1.1.1 1.2.3",
    "4111 1111 1111 1111, 4111111111111112; 4111-1111-1111-1111 +1 (403) 555-9312. +49 30 1234",
    "+1 234 567 8901 +2 345 678 9012 tail +",
    "1" * 40 + " 4" + "1" * 14 + "0 " + "x" * 50 + "@y.zz",
    "\U0001f600 me@host.org \U0001f600 10.0.0.1",
]


CARDS = [c for c in (f"4000 0000 0000 {n}" for n in range(1000, 2000)) if luhn(c.replace(" ", ""))][:90]


def found(spark, texts, extra="lang string"):
    rows = [(i, t, None) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, f"doc_id long, text string, {extra}")
    got = pii.find(df).select("doc_id", pii.listing(pii.F.col("_base")).alias("base"), pii.listing(pii.F.col("_more")).alias("more"))
    return {r["doc_id"]: (r["base"], r["more"]) for r in got.collect()}


def test_base_spans_match_plain_patterns(spark):
    got = found(spark, CASES, "_key string")
    assert [got[i][0] for i in range(len(CASES))] == [",".join(expected(t)) for t in CASES]


def test_many_spans_and_long_runs(spark):
    emails = " ".join(f"u{i}@h{i}.org" for i in range(1200))
    dots = "a@" + "b." * 20_000 + "c"
    texts = [emails, "a" * 1_000_000, "1.2." * 8_000, dots, "+1" + " " * 300_000]
    addresses = ",".join(f"ip:{8 * i}:{8 * i + 7}" for i in range(4_000))
    got = found(spark, texts)
    # the plain patterns need quadratic time on the long runs
    assert [got[i][0] for i in range(5)] == [",".join(expected(emails)), "", addresses, f"email:0:{len(dots)}", ""]


def test_whole_table_against_plain_patterns(spark):
    sf_dir = "/root/testdata/sf0.001"
    from wardline.llm import queries

    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for row in queries.op1(spark, sf_dir).collect():
        want = expected(texts[row["doc_id"]])
        assert row["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert row["n_email"] == sum(w.startswith("email") for w in want)
        assert set(want) <= set(row["spans"].split(",")) | {""}


def test_patterns_discover_unseen_identifiers(spark):
    seeds = [f"some words here. phone: +1 (212) 555-{1000 + i} and the rest {i}" for i in range(12)]
    unseen = ["my phone: 212-555-7788 is new", "the year 2004-555-1234 stands alone", "phone: soon"]
    got = found(spark, seeds + unseen)
    assert got[12] == ("", "phone:10:22")
    assert got[13] == ("", "") and got[14] == ("", "")


def test_labels_side_by_side_become_patterns(spark):
    contacts = [
        f"email: u{i}@host.org phone: +1 (212) 555-{1000 + i} ip: 10.0.0.{i}\nphone: +1 (212) 555-{2000 + i}, phone: +1 (212) 555-{3000 + i}"
        for i in range(12)
    ]
    unseen = ["email: someone@intranet here", "so phone: 212-555-7788 it is", "ip: 999.1.1.1 now"]
    got = found(spark, contacts + unseen)
    assert [got[12 + i][1] for i in range(3)] == ["email:7:23", "phone:10:22", "ip:4:13"]


def test_uses_before_no_identifier_count_in_all_texts(spark):
    seeds = [f"so reach the +1 (212) 555-{1000 + i}" for i in range(12)]
    far = [f"{i} " + "the rest " * 2 + "x" * 200 for i in range(12)]
    unseen = ["it was the 2004-555-1234 again"]
    assert found(spark, seeds + far + unseen)[24] == ("", "")
    # copies of a text add nothing, to either side
    assert found(spark, seeds + ["the rest"] * 40 + unseen)[52] == ("", "phone:11:24")


def test_unseen_forms_after_labels(spark):
    labels = [f"phone: +1 (212) 555-{1000 + i}\ncard: {card}\nemail: u{i}@host.org" for i, card in enumerate(CARDS)]
    phones = ["(212) 555-7788", "212 555 7788", "2125557788", "212-555-7788", "212.555.7788", "212 - 555 - 7788", "(212)555-7788"]
    cards = ["4111-1111-1111-1112", "4111 1111 1111 1112", "4111111111111112"]
    unseen = [("phone", p) for p in phones] + [("card", c) for c in cards] + [("email", "me@hq")]
    texts = [f"my {kind}: {value}, 3rd floor" for kind, value in unseen]
    apart = ["phone: 212-555-7799 212-555-7700 x", "phone: (212-555-7711) 2nd", "id 2125557799x phone: 12345678.jpg", "phone: 646 555 1234 5th door"]
    got = found(spark, labels + texts + apart)
    want = [f"{kind}:{len(kind) + 5}:{len(kind) + 5 + len(value)}" for kind, value in unseen]
    assert [got[len(CARDS) + i][1] for i in range(len(texts))] == want
    assert [got[len(CARDS) + len(texts) + i][1] for i in range(4)] == ["phone:7:19", "phone:8:20", "", "phone:7:19"]


def test_candidates_of_long_runs(spark):
    texts = ["1 " * 300_000, "1)" * 300_000 + "x", "(1" * 300_000, "1 - " * 100_000 + "x", "." * 300_000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    sizes = pii.occurrences(df).select(pii.F.size("_seen").alias("n")).collect()
    assert [r["n"] for r in sizes] == [0] * len(texts)


def test_redaction_and_repeated_rows(spark):
    rows = [(1, "x a@b.org y 10.0.0.1", "s"), (1, "x a@b.org y 10.0.0.1", "s"), (None, "+1 403 555 9312é", None), (2, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _key string")
    got = sorted(map(tuple, pii.redact(df).collect()), key=repr)
    want = [(1, "x [EMAIL] y [IP]", "s"), (1, "x [EMAIL] y [IP]", "s"), (None, "[PHONE]é", None), (2, None, None)]
    assert got == sorted(want, key=repr)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert pii.find(df).count() == 0 and pii.redact(df).count() == 0
