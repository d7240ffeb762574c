"""Language identification by error-correcting output codes.

Every language has a codeword of +1 and -1. One linear classifier per bit, fitted by
ridge regression on hashed byte n-grams, predicts that bit of a whole text. Decoding
takes the language whose codeword has the smallest loss, each bit weighted by how well
its classifier knows that language; a small gap to the second best is flagged. A text that
fits no codeword is flagged as foreign: its smallest loss is more than ``FOREIGN_PART`` of
the way from that of the worst hundredth of the learning texts to 1, the loss of knowing
nothing. That is set so that texts in several of the languages are not foreign. Texts of fewer than
``LEAST_NGRAMS`` n-grams (about 300 bytes) are too short to be told foreign.

Defined results: null texts and texts without a letter are ``und`` with score 0 and
flagged; so is every text if nothing can be learned from. One learned language is
predicted with score 1, and nothing is foreign to it. Repeated rows get the same result. The language, source and id
of a row are not used in its prediction.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.llm import sampling
from wardline.llm.textops import LETTER, LOWER, count_blocks

UNKNOWN = "und"
BUCKETS = 4096
ORDERS = (2, 3, 4)
SAMPLE_ROWS = 2400
RIDGE = 0.3
SHARPNESS = 8.0
CLOSE = 0.04
LEAST_NGRAMS = 900
FOREIGN_PART = 0.7

_SHOWN = np.where(LETTER, LOWER, np.uint8(0x20))
_SHOWN[0xC3] = 0xC3


def ngrams(content: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text and bucket of every byte n-gram; whatever is no letter counts as a space."""
    shown = _SHOWN[content]
    wide = np.flatnonzero((content[:-1] == 0xC3) & (content[1:] >= 0x80) & (content[1:] <= 0x9E)) + 1
    shown[wide] |= 0x20  # the capitals of the Latin-1 letters
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    left = np.repeat(offsets[1:], np.diff(offsets)) - np.arange(len(content))
    key = shown.astype(np.uint64)
    rows, buckets = [], []
    for order in range(2, max(ORDERS) + 1):
        key = key[:-1] | (shown[order - 1 :].astype(np.uint64) << np.uint64(8 * (order - 1)))
        if order in ORDERS and len(key):
            whole = left[: len(key)] >= order
            hashed = (key + np.uint64(order)) * np.uint64(0x9E3779B97F4A7C15)
            rows.append(row[: len(key)][whole])
            buckets.append((hashed >> np.uint64(52)).astype(np.int64)[whole])
    empty = np.zeros(0, dtype=np.int64)
    return np.concatenate([empty, *rows]), np.concatenate([empty, *buckets])


def scaled(counts: np.ndarray) -> np.ndarray:
    roots = np.sqrt(counts).astype(np.float32)
    return roots / np.maximum(np.linalg.norm(roots, axis=1, keepdims=True), 1e-9)


def codewords(classes: int) -> np.ndarray:
    """Rows of +1 and -1: every split of few classes, the best of some random codes for many."""
    if classes < 2:
        return np.ones((classes, 1), dtype=np.float32)
    if classes <= 6:
        splits = np.arange(1, 2 ** (classes - 1))
        bits = (splits[None, :] >> np.arange(classes)[:, None]) & 1
        return (1 - 2 * bits).astype(np.float32)
    length, random = int(np.ceil(15 * np.log2(classes))), np.random.default_rng(7)
    drawn = [random.choice(np.array([-1.0, 1.0], dtype=np.float32), (classes, length)) for _ in range(50)]
    return max(drawn, key=lambda code: np.min((length - code @ code.T)[~np.eye(classes, dtype=bool)]))


class Model(NamedTuple):
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    trust: np.ndarray  # per language and bit, rows sum to 1
    limit: float  # smallest loss beyond which a text is foreign


def fit(features: np.ndarray, labels: list[str], ridge: float = RIDGE) -> Model:
    languages = sorted(set(labels))
    code = codewords(len(languages))
    target = code[[languages.index(x) for x in labels]]
    mean = target.mean(axis=0)
    kernel = features @ features.T
    kernel[np.diag_indices_from(kernel)] += ridge
    dual = np.linalg.solve(kernel, target - mean)
    fitted = target - ridge * dual  # the ridge fit of the sample itself, without a second product
    trust = np.zeros_like(code)
    for i, language in enumerate(languages):
        own = np.array(labels) == language
        trust[i] = np.clip((fitted[own] * code[i]).mean(axis=0), 0.05, 1)
    trust /= trust.sum(axis=1, keepdims=True)
    worst = np.quantile(losses(code, trust, fitted).min(axis=1), 0.99)
    limit = float(worst + FOREIGN_PART * (1 - worst)) if len(languages) > 1 and worst < 1 else float("inf")
    return Model(languages, code, (features.T @ dual).astype(np.float32), mean.astype(np.float32), trust, limit)


def losses(code: np.ndarray, trust: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Loss of every codeword for each text's bits."""
    return np.einsum("lb,nlb->nl", trust, np.exp(-bits[:, None, :] * code[None]))


def predict(model: Model, features: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Language number, score from 0 to 1, whether the choice is a close one, and the smallest loss."""
    loss = losses(model.code, model.trust, features @ model.weights + model.bias)
    best = loss.argmin(axis=1)
    chance = np.exp(-SHARPNESS * (loss - loss.min(axis=1, keepdims=True)))
    score = 1 / chance.sum(axis=1)
    ordered = np.sort(loss, axis=1)
    close = (ordered[:, 1] - ordered[:, 0]) < CLOSE if loss.shape[1] > 1 else np.zeros(len(best), dtype=bool)
    return best, score, close, loss.min(axis=1)


def train(docs: DataFrame, learn: Column, sample_rows: int = SAMPLE_ROWS) -> Model | None:
    """Fit on at most about ``sample_rows`` whole texts, spread evenly over the languages.

    ``docs`` needs doc_id, text and lang; ``learn`` says which rows may be used.
    """
    known = docs.where(learn & F.col("lang").isNotNull() & (F.col("lang") != UNKNOWN))
    languages = known.select("lang").distinct().count()
    if not languages:
        return None
    picked, _ = sampling.labelled_ids(known, "lang", max(1, sample_rows // languages))

    @F.arrow_udf("binary")
    def counted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            out = [row.tobytes() for *_, counts in count_blocks(batch, BUCKETS, ngrams) for row in scaled(counts)]
            yield pa.array(out, pa.binary())

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels: list[str] = []
        features = np.empty((most, BUCKETS), dtype=np.float32)
        for batch in batches:
            for label, value in zip(batch.column("label").to_pylist(), batch.column("features")):
                features[len(labels)] = np.frombuffer(value.as_buffer(), dtype=np.float32)
                labels.append(label)
        if labels:
            model = pickle.dumps(fit(features[: len(labels)], labels))
            yield pa.RecordBatch.from_arrays([pa.array([model], pa.binary())], ["model"])

    # texts are counted where they are read; the bounded sample of counts is fitted in one
    # task, and the driver only gets the model
    most = 2 * len(picked) + 1
    rows = sampling.labelled_rows(docs, picked, "string").where(F.col("text").isNotNull())
    few = rows.select("label", counted("text").alias("features")).limit(most)
    got = few.coalesce(1).mapInArrow(fitted, "model binary").collect()
    return pickle.loads(got[0]["model"]) if got else None


def identify(df: DataFrame, model: Model | None, text: str = "text") -> Column:
    """Struct of lang_pred, score, ambiguous and foreign for each whole text."""
    kind = "lang_pred string, score double, ambiguous boolean, foreign boolean"
    unknown = F.struct(F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("ambiguous"), F.lit(False).alias("foreign"))
    if model is None:
        return unknown
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf(kind)
    def identified(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            learned = shared.value
            names, scores, close, foreign = [], [np.zeros(0)], [np.zeros(0, dtype=bool)], [np.zeros(0, dtype=bool)]
            for *_, counts in count_blocks(batch, BUCKETS, ngrams):
                best, score, near, loss = predict(learned, scaled(counts))
                names += [learned.languages[i] for i in best]
                scores.append(score)
                close.append(near)
                foreign.append((loss > learned.limit) & (counts.sum(axis=1) >= LEAST_NGRAMS))
            columns = [pa.array(names, pa.string()), pa.array(np.concatenate(scores).astype(float))]
            columns += [pa.array(np.concatenate(flags)) for flags in (close, foreign)]
            yield pa.StructArray.from_arrays(columns, ["lang_pred", "score", "ambiguous", "foreign"])

    lettered = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    return F.when(lettered, identified(F.col(text))).otherwise(unknown)
