from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from wardline.llm import align, bpe, piece_bpe

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def plain(texts: list[str | None]) -> list[tuple]:
    """The same results from the two libraries, token by token."""
    tokenizer = Tokenizer.from_file(A)
    tokenizer.encode_special_tokens = True
    pieces = sentencepiece.SentencePieceProcessor(model_file=B)
    bytes_a = bpe.load_vocabulary(A).id_bytes
    docs = []
    for text in texts:
        want = " " + (text or "")
        ids_a, ids_b = tokenizer.encode(want, add_special_tokens=False).ids, pieces.encode(text or "")
        b = [
            bytes([int(p[3:5], 16)]) if pieces.is_byte(i) else p.replace("▁", " ").encode()
            for i, p in ((i, pieces.id_to_piece(i)) for i in ids_b)
        ]
        a = [bytes_a[i] for i in ids_a]
        if not text or b"".join(a) != want.encode() or b"".join(b) != want.encode():
            docs.append(([], []))
            continue
        ends_a, ends_b = np.cumsum([len(x) for x in a]).tolist(), np.cumsum([len(x) for x in b]).tolist()
        groups, start_a, start_b = [], 0, 0
        at_a, at_b = ({end: i + 1 for i, end in enumerate(ends)} for ends in (ends_a, ends_b))
        for end in sorted(at_a.keys() & at_b.keys()):
            i, j = at_a[end], at_b[end]
            groups.append((ids_a[start_a:i], ids_b[start_b:j]))
            start_a, start_b = i, j
        docs.append((groups, [(x, y) for g in groups for x in g[0] for y in g[1]]))
    count = Counter(pair for _, links in docs for pair in set(links))
    highest: dict[int, int] = {}
    for (x, _), n in count.items():
        highest[x] = max(highest.get(x, 0), n)
    rows = []
    for groups, links in docs:
        shown = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        rows.append((
            sum(len(x) for x, _ in groups),
            sum(len(y) for _, y in groups),
            len(groups),
            len(links),
            sum(count[p] == highest[p[0]] for p in links),
            sum(count[p] for p in links),
            hashlib.sha256(shown.encode()).hexdigest() if groups else "",
        ))
    return rows


def texts() -> list[str | None]:
    draw = random.Random(5)
    anything = [chr(c) for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    some = "ab \t\n 　'sStTll1२é日本_!=*/<>|endoftext"
    words = "the and of tokenizer alignment über straße naïve 日本語 emoji😀 123456 don't https://a.b/c?d=e".split()
    out: list[str | None] = ["".join(draw.choices(anything, k=30)) for _ in range(60)]
    out += ["".join(draw.choices(some, k=60)) for _ in range(100)]
    out += [" ".join(draw.choices(words, k=draw.randrange(1, 50))) for _ in range(150)]
    out += [None, "", " ", "a▁b", "<|endoftext|>", "x<|endoftext|> y", "<s>", "\x00", "😀" * 200, " " * 300, "same", "same"]
    return [*out, *out[:40]]


@pytest.mark.parametrize("window, entries, links", [(100_000, 1_000_000, 2_000_000), (50, 200, 7)])
def test_equal_to_the_libraries(spark, monkeypatch, window, entries, links):
    given = texts()
    for name, value in (("WINDOW_CHARS", window), ("BLOCK_ENTRIES", entries), ("MOST_LINKS", links)):
        monkeypatch.setattr(align, name, value)
    if window > 50:
        df = spark.createDataFrame(list(enumerate(given)), "doc_id long, text string").repartition(3)
        got = [tuple(r[1:]) for r in sorted(align.align(df, A, B).collect())]
        assert got == plain(given)
        return
    aligner = align.Aligner(bpe.load_vocabulary(A), piece_bpe.load_model(B))
    results, text, pair, times = aligner.align([t or "" for t in given])
    want = plain(given)
    assert [r[:4] for r in results] == [w[:4] for w in want] and [r[4] for r in results] == [w[6] for w in want]
    assert np.bincount(text, weights=times, minlength=len(given)).tolist() == [w[3] for w in want]
    assert len(set(zip(text.tolist(), pair.tolist()))) == len(text)


def test_common_ends_in_any_order_of_widths():
    draw = random.Random(6)
    for _ in range(300):
        a_end, b_end, a_last, b_last, total = [], [], [], [], 0
        for _ in range(draw.randrange(1, 5)):
            size = draw.choice([1, 2, 5, 60, 400])
            share = draw.choice([0.02, 0.3, 0.9])
            for ends, last in ((a_end, a_last), (b_end, b_last)):
                ends += [total + i for i in range(1, size) if draw.random() < share] + [total + size]
                last.append(len(ends) - 1)
            total += size
        got = align.common_ends(*(np.array(x) for x in (a_end, b_end, a_last, b_last)))
        want = sorted(set(a_end) & set(b_end))
        assert [a_end[i] for i in got.last_a] == want and [b_end[i] for i in got.last_b] == want


def test_repeated_null_and_clashing_columns(spark):
    rows = [(None, "one two", 1), (7, "one two", 2), (7, "one two", 3), (8, None, 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, pair long")
    got = sorted(align.align(df, A, B).collect(), key=str)
    assert sorted(tuple(r[1:]) for r in got) == sorted(plain([t for _, t, _ in rows]))
    assert sorted(str(r["doc_id"]) for r in got) == ["7", "7", "8", "None"]
    assert align.align(df.limit(0), A, B).count() == 0
    assert align.align(df.where("text is null"), A, B).collect()[0][1:] == (0, 0, 0, 0, 0, 0, "")


def test_a_very_long_text(spark):
    text = "the straße 日本語 of tokens " * 20_000
    df = spark.createDataFrame([(1, text), (2, "x")], "doc_id long, text string")
    assert [tuple(r[1:]) for r in sorted(align.align(df, A, B).collect())] == plain([text, "x"])
