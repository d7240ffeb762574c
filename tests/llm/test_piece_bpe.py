from __future__ import annotations

import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from wardline.llm import piece_bpe

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def model():
    return piece_bpe.load_model(PATH)


def texts(library) -> list[str]:
    draw = random.Random(2)
    anything = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    some = "ab \t\n 　'sStTll1२é\x1c\x85_!▁=*/<s>zhe"
    pieces = [library.id_to_piece(i) for i in range(259, library.get_piece_size())]
    touchy = ["the", "and", "ing", "ion", "to", "of", "zz", "==", "io", "an", "▁", "th", "i", "o", "n", "g", "e"]
    out = ["".join(draw.choices(anything, k=60)) for _ in range(200)]
    out += ["".join(draw.choices(some, k=80)) for _ in range(500)]
    out += ["".join(draw.choices(pieces, k=40)).replace("▁", draw.choice(["", " ", "▁"])) for _ in range(400)]
    out += ["".join(draw.choices(touchy, k=60)) for _ in range(500)]
    out += [c * n for c in " az=-\n▁é0" for n in (1, 2, 3, 5, 11, 16, 17, 33, 100, 500)]
    return [*out, "", " ", "  ", " a", "a ", "<s>x</s>", "<0x0A>", "﻿a", "\x00", "\r\n\r\n", "a▁ b"]


def split(ids: np.ndarray, offsets: np.ndarray) -> list[list[int]]:
    return [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:])]


@pytest.mark.parametrize("window, rounds", [(100_000, 48), (7, 48), (100_000, 0), (100_000, 3), (50, 10_000)])
def test_same_ids_and_text_as_the_library(library, model, monkeypatch, window, rounds):
    monkeypatch.setattr(piece_bpe, "WINDOW_CHARS", window)
    monkeypatch.setattr(piece_bpe, "MOST_ROUNDS", rounds)
    given = texts(library)
    ids, offsets = piece_bpe.Encoder(model).encode(given)
    want = library.encode(given, num_threads=1)
    assert split(ids, offsets) == want
    assert piece_bpe.Decoder(model.id_bytes, model.strips).decode(ids, offsets) == library.decode(want, num_threads=1)


def test_words_are_forgotten_without_changing_ids(library, model, monkeypatch):
    monkeypatch.setattr(piece_bpe, "MOST_WORDS", 3)
    encoder = piece_bpe.Encoder(model)
    for text in ("one two three four", "five six one", "two  seven one"):
        assert encoder.encode([text])[0].tolist() == library.encode(text)


def test_without_leading_space_rule(library, model):
    encoder = piece_bpe.Encoder(model._replace(spaces_lead=False))
    for text in ("one two  three", " a ", "x\ny z"):
        assert encoder.encode([text])[0].tolist() == library.encode(text)


def test_any_ids_decode_as_in_the_library(library, model):
    draw = random.Random(3)
    rows = [draw.choices(range(0, 320), k=draw.randrange(0, 12)) for _ in range(3000)]
    rows += [draw.choices(range(32000), k=9) for _ in range(500)]
    offsets = np.r_[0, np.cumsum([len(r) for r in rows])]
    got = piece_bpe.Decoder(model.id_bytes, model.strips).decode(np.array(sum(rows, []), dtype=np.int64), offsets)
    assert got == [library.decode(r) for r in rows]


def test_long_unbroken_text(library, model):
    draw = random.Random(4)
    for text in (" " * 60_000, "z" * 300_000, "".join(draw.choices("abcdefghijklmnop", k=60_000)), "日本語" * 30_000):
        assert piece_bpe.Encoder(model).encode([text])[0].tolist() == library.encode(text)


def test_columns_nulls_and_empty_tables(spark, library):
    rows = [(1, "Hello world", "x"), (1, "Hello world", "x"), (None, None, None), (2, "", "y"), (3, "ab cd\n" * 90_000, "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, decoded_text string")
    got = piece_bpe.decode(piece_bpe.encode(df, PATH), PATH).collect()
    assert sorted(tuple(r["ids"]) for r in got) == sorted(tuple(library.encode(t or "")) for _, t, _ in rows)
    assert sorted(r["decoded"] for r in got) == sorted(t or "" for _, t, _ in rows)
    assert piece_bpe.encode(df.limit(0), PATH).count() == 0
    nothing = spark.createDataFrame([(None,)], "ids array<int>")
    assert piece_bpe.decode(nothing, PATH).first()["decoded"] == ""


def test_other_kinds_of_models_are_refused(tmp_path):
    content = open(PATH, "rb").read().replace(b"identity\x12\x00\x18\x01\x20\x00", b"identity\x12\x00\x18\x01\x20\x01")
    path = tmp_path / "other.model"
    path.write_bytes(content)
    with pytest.raises(ValueError):
        piece_bpe.load_model(str(path))
