"""The pipeline against a plain one-machine version."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import public_tokenizers
import pytest
import regex
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.test_mixing import brute_mix
from tests.llm.test_pii import PLAIN, valid
from tests.llm.test_sketch_dedup import brute

SF_DIR = "/root/testdata/sf0.001"


def redacted(text: str) -> str:
    spans = sorted(
        (m.start(), m.end(), i, kind)
        for i, (kind, pattern) in enumerate(PLAIN.items())
        for m in re.finditer(pattern, text)
        if valid(kind, m[0])
    )
    out, at = "", 0
    for start, end, _, kind in spans:
        if start >= at:
            out += text[at:start] + f"[{kind.upper()}]"
        at = max(at, end)
    return out + text[at:]


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SF_DIR}/documents.parquet"), []
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        rows = [r.asDict() for r in stage(spark, docs, SF_DIR).collect()]
        out.append((docs, rows))
        if name != "tokens":
            schema = docs.schema
            docs = spark.createDataFrame([tuple(r[c] for c in columns) for r in rows], schema)
    return out


def test_language_keeps_texts_with_letters(stages):
    before, after = stages[0][0].collect(), stages[0][1]
    assert sorted(r["doc_id"] for r in after) == sorted(r["doc_id"] for r in before if regex.search(r"\p{L}", r["text"] or ""))


def test_one_document_of_each_group_stays(stages):
    before = [(r["doc_id"], r["text"]) for r in stages[1][0].collect()]
    assert sorted(r["doc_id"] for r in stages[1][1]) == sorted({c for _, c in brute(before, 5).values()})


def test_personal_data_is_replaced(stages):
    before = {r["doc_id"]: r["text"] for r in stages[2][0].collect()}
    for row in stages[2][1]:
        assert row["text"] == redacted(before[row["doc_id"]]) and row["n_chars"] == len(row["text"])


def test_mixture_takes_the_words_of_the_plan(stages):
    before = [(r["doc_id"], r["source"], r["text"]) for r in stages[3][0].collect()]
    taken = Counter()
    for row in stages[3][1]:
        taken[row["doc_id"]] += len(re.findall(r"[^\x20\x09-\x0D]+", row["text"]))
    want = {i: t for i, (*_, t) in brute_mix(before).items() if t}
    assert dict(taken) == want


def test_tokens_are_those_of_the_library(stages):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [r["text"] for r in stages[4][0].collect()]
    want = Counter(tuple(e.ids) for e in library.encode_batch(texts, add_special_tokens=False))
    assert Counter(tuple(r["ids"]) for r in stages[4][1]) == want
    digests = Counter(hashlib.sha256(t.encode()).hexdigest() for t in texts)
    assert Counter(r["decoded_sha256"] for r in stages[4][1]) == digests
