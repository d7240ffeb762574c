"""Held-out accuracy and defined results of the three classifiers."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pytest

from wardline.llm import langid, quality_knn, queries, sampling, toxicity
from wardline.llm.textops import blocks, count_blocks, runs, span_hashes, WHITE

SF_DIR = "/root/testdata/sf0.01"
ODD = [None, "", " \n\t", "123 !!", "Grüße", "x" * 2_500_000, "the cat " * 200_000]


def table(spark, texts=ODD):
    rows = [(i if i else None, t, None, "s", 1.5) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows + rows[:2], "doc_id long, text string, lang string, label string, score double")


def held(spark, query, truth, folds, fold):
    want = {r["doc_id"]: r[truth] for r in spark.read.parquet(f"{SF_DIR}/{'documents' if truth == 'lang' else 'labels'}.parquet").collect()}
    rows = query(spark, SF_DIR).collect()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % folds == fold) and 0 <= r["score"] <= 1
    return [(want[r["doc_id"]], r) for r in rows if r["held_out"] and want.get(r["doc_id"]) is not None]


def test_language_held_out(spark):
    rows = held(spark, queries.op3, "lang", 4, 2)
    assert np.mean([w == r["lang_pred"] for w, r in rows]) > 0.98


def test_quality_held_out(spark):
    rows = held(spark, queries.op5, "quality", 5, 0)
    assert np.mean([w == r["predicted"] for w, r in rows]) > 0.95


def test_toxicity_held_out(spark):
    rows = held(spark, queries.op8, "toxic", 4, 2)
    assert np.mean([w == r["predicted"] for w, r in rows]) > 0.9
    clean = [r["predicted"] for w, r in rows if not w]
    assert np.mean(clean) < 0.05


def test_language_of_odd_texts(spark):
    learn = spark.createDataFrame(
        [(i, t, l) for i, (t, l) in enumerate([("the cat and the dog were there", "en"), ("der Hund und die Katze", "de")] * 20)],
        "doc_id long, text string, lang string",
    )
    model = langid.train(learn, sampling.remainder("doc_id", 4) != 2)
    df = table(spark)
    got = df.select("doc_id", langid.identify(df, model).alias("f")).select("doc_id", "f.*").collect()
    named = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in got}
    assert named[None] == named[1] == named[2] == named[3] == ("und", 0.0)
    assert named[4][0] in ("en", "de") and named[6][0] == "en" and named[6][1] > 0.5
    assert len(got) == len(ODD) + 2
    assert langid.train(learn.limit(0), sampling.remainder("doc_id", 4) != 2) is None
    assert df.select(langid.identify(df, None)["lang_pred"].alias("l")).distinct().collect()[0]["l"] == "und"
    one = langid.train(learn.where("lang = 'en'"), sampling.remainder("doc_id", 4) != 2)
    assert df.where("doc_id = 6").select(langid.identify(df, one)["score"].alias("s")).first()["s"] == 1.0


def test_texts_that_fit_no_codeword_are_foreign(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    model = langid.train(docs, sampling.remainder("doc_id", 4) != 2)
    draw = np.random.default_rng(3)
    odd = ["".join(draw.choice(list(letters), 1500)) for letters in ("abcdefghijklmnopqrstuvwxyz ", "абвгдежзийклмнопрст ") for _ in range(20)]
    odd = spark.createDataFrame([(t,) for t in odd] + [("xq zv",)], "text string")
    flags = [r[0] for r in odd.select(langid.identify(odd, model)["foreign"]).collect()]
    assert sum(flags[:40]) > 30 and not flags[40]
    held = docs.where((sampling.remainder("doc_id", 4) == 2) & sampling.F.col("lang").isNotNull())
    assert held.where(langid.identify(held, model)["foreign"]).count() == 0


def test_decoding_is_the_least_weighted_loss():
    """Against a plain restatement, codeword by codeword."""
    draw = np.random.default_rng(4)
    features = langid.scaled(draw.integers(0, 5, (60, langid.BUCKETS)).astype(float))
    labels = [("a", "b", "c")[i % 3] for i in range(60)]
    features[np.arange(60), np.arange(60) % 3] += 1
    model = langid.fit(features, labels)
    best, score, _, least = langid.predict(model, features)
    for i, row in enumerate(features):
        loss = []
        for word, trust in zip(model.code, model.trust):
            loss.append(sum(t * np.exp(-w * float(row @ model.weights[:, b] + model.bias[b])) for b, (w, t) in enumerate(zip(word, trust))))
        assert best[i] == int(np.argmin(loss)) and abs(least[i] - min(loss)) < 1e-3
        assert abs(score[i] - 1 / sum(np.exp(-langid.SHARPNESS * (x - min(loss))) for x in loss)) < 1e-3


def test_scores_of_odd_texts(spark):
    docs = spark.createDataFrame([(i, "good words here. " * 9 if i % 2 else "bad *** bad *** bad") for i in range(60)], "doc_id long, text string")
    labels = docs.selectExpr("doc_id", "int(doc_id % 2) AS quality", "int(1 - doc_id % 2) AS toxic")
    df = table(spark)
    for module, label in ((quality_knn, "quality"), (toxicity, "toxic")):
        model = module.train(docs, labels, label, sampling.remainder("doc_id", 5) != 0)
        got = df.select("doc_id", module.score(df, model).alias("score")).collect()
        assert len(got) == len(ODD) + 2 and all(0 <= r["score"] <= 1 for r in got)
        assert len({r["score"] for r in got if r["doc_id"] in (None, 1)}) == 1
        own = docs.select("doc_id", module.score(docs, model).alias("score")).collect()
        right = [(r["score"] >= 0.3) == ((r["doc_id"] % 2 == 1) == (label == "quality")) for r in own]
        assert all(right)
        none = module.train(docs, labels.limit(0), label, sampling.remainder("doc_id", 5) != 0)
        assert none is None and docs.select(module.score(docs, none).alias("s")).distinct().count() == 1
        assert df.limit(0).select(module.score(df, model).alias("s")).count() == 0


def test_naming_a_group_does_not_move_the_score():
    def listed(text):
        (_, _, _, feature), = toxicity.text_features(pa.array([text]))
        return feature

    toxic = [f"stupid {g} go away {i}" for i in range(30) for g in ("muslims",)]
    clean = [f"the people of town {i} say hello" for i in range(30)] + ["christians say hello"] * 6
    lists = [listed(t) for t in toxic + clean]
    labels = np.array([1.0] * len(toxic) + [0.0] * len(clean), dtype=np.float32)
    pairs = [(listed(t), listed(toxicity.counterfactual(t))) for t in toxic + clean if toxicity.counterfactual(t)]

    def score(model, text):
        weights = dict(zip(model.features.tolist(), model.weights.tolist()))
        return model.bias + sum(weights.get(f, 0.0) for f in listed(text).tolist())

    plain = toxicity.fit(lists, labels, np.ones(len(labels)), [], fairness=0)
    fair = toxicity.fit(lists, labels, np.ones(len(labels)), pairs, fairness=20)
    gap = [abs(score(m, "muslims say hello") - score(m, "christians say hello")) for m in (plain, fair)]
    assert gap[1] < gap[0] / 3
    assert score(fair, "stupid people go away") > 0 > score(fair, "muslims say hello")


@pytest.mark.parametrize("size", [5, 64, 1 << 20])
def test_pieces_cover_whole_texts(monkeypatch, size):
    from wardline.llm import textops

    monkeypatch.setattr(textops, "PIECE_BYTES", size)
    texts = pa.array(["one two  three", None, "", "é" * 40 + " x", "a b " * 30]).slice(0)
    seen = {}
    for start, end, parts in blocks(texts):
        for content, offsets in parts:
            begins, ends = runs(~WHITE[content], offsets)
            (hashes,) = span_hashes(content, begins, ends)
            for row, word in zip(textops.rows_at(offsets, begins), hashes):
                seen.setdefault(start + row, []).append(int(word))
    assert [len(seen.get(i, [])) for i in range(5)] == [3, 0, 0, 2, 60]
    assert len(set(seen[4])) == 2


def test_counts_do_not_depend_on_pieces(monkeypatch):
    from wardline.llm import textops

    texts = pa.array(["the cat sat", "Ärger über Öl", "x" * 100])
    whole = [c.copy() for *_, c in count_blocks(texts, langid.BUCKETS, langid.ngrams)]
    assert sum(c.sum() for c in whole) > 0
    assert sum(c.shape[0] for c in whole) == 3
