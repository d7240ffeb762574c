from __future__ import annotations

import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from wardline.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.load_vocabulary(PATH)


def texts() -> list[str]:
    draw = random.Random(1)
    anything = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    some = "ab \t\n 　'sStTll1२é\x1c\x85_!<|endoftext|>"
    out = ["a" + "".join(draw.choices(anything, k=60)) + "b" for _ in range(300)]
    out += ["".join(draw.choices(some, k=80)) for _ in range(600)]
    return [*out, "<|endoftext|>x <|endoftext|><|endoftext|> ", "", "a" * 500, "aaaaaaaaaaa aaaaaaaa", "    ", "\n\n x", "՘ \U00010940"]


@pytest.mark.parametrize("window", [400_000, 7])
def test_same_ids_and_text_as_the_library(library, vocabulary, monkeypatch, window):
    monkeypatch.setattr(bpe, "WINDOW_CHARS", window)
    given = texts()
    ids, offsets = bpe.Encoder(vocabulary).encode(given)
    want = [e.ids for e in library.encode_batch(given, add_special_tokens=False)]
    assert [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:])] == want
    decoded = bpe.Decoder(vocabulary.id_bytes).decode(ids, offsets)
    assert decoded == [library.decode(w, skip_special_tokens=False) for w in want] == given


def test_words_are_forgotten_without_changing_ids(library, vocabulary, monkeypatch):
    monkeypatch.setattr(bpe, "MOST_WORDS", 3)
    encoder = bpe.Encoder(vocabulary)
    for text in ("one two three four", "five six one", "two <|endoftext|> one"):
        assert encoder.encode([text])[0].tolist() == library.encode(text, add_special_tokens=False).ids


def test_ids_that_are_no_text(library, vocabulary):
    ids = library.encode("é", add_special_tokens=False).ids + [vocabulary.byte_id[0xC3], vocabulary.byte_id[0x41]]
    got = bpe.Decoder(vocabulary.id_bytes).decode(bpe.np.array(ids), bpe.np.array([0, len(ids)]))
    assert got == [library.decode([int(i) for i in ids], skip_special_tokens=False)]


def test_columns_nulls_and_empty_tables(spark, library):
    rows = [(1, "Hello world", "x"), (1, "Hello world", "x"), (None, None, None), (2, "", "y"), (3, "z" * 900_000, "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = bpe.decode(bpe.encode(df, PATH), PATH).collect()
    want = [tuple(library.encode(t or "", add_special_tokens=False).ids) for _, t, _ in rows]
    assert sorted(tuple(r["ids"]) for r in got) == sorted(want)
    assert sorted(r["decoded"] for r in got) == sorted(t or "" for _, t, _ in rows)
    assert bpe.encode(df.limit(0), PATH).count() == 0
    nothing = spark.createDataFrame([(None,)], "ids array<int>")
    assert bpe.decode(nothing, PATH).first()["decoded"] == ""
