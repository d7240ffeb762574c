"""Toxicity: a linear classifier regularised with counterfactual sentences.

Features are the words of a text and the beginnings of its words, hashed, each counted
once per text. The classifier is a logistic regression over a chosen vocabulary. Of
every sampled text that names a group of people, a counterfactual is made by swapping
each identity term for another of its kind; the squared change of the score between the
two is part of the loss, so that naming a group does not move the score.

Defined results: null, empty and word-free texts get the score of a text without
features; without labelled rows every score is 0. Repeated rows get the same score.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.llm import sampling
from wardline.llm.textops import LETTER, LOWER, blocks, rows_at, runs, span_hashes

BITS = 20
BEGINNINGS = (4, 5, 6, 7, 8)
PER_CLASS = 2500
VOCABULARY = 3000
LEAST_TEXTS = 4
#: Groups of terms of one kind; any may stand for any other of its group.
IDENTITY = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "indigenous"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("immigrants", "refugees", "foreigners", "locals", "citizens"),
    ("disabled", "deaf", "blind", "autistic"),
    ("elderly", "young"),
)
_SWAP = {word: group[(i + 1) % len(group)] for group in IDENTITY for i, word in enumerate(group)}
_TERMS = regex.compile(r"\b(?:" + "|".join(sorted(_SWAP)) + r")\b", regex.IGNORECASE)


def counterfactual(text: str) -> str | None:
    """The text with every identity term swapped; None if it names none."""
    return _TERMS.sub(lambda m: _SWAP[m[0].lower()], text) if _TERMS.search(text) else None


def word_features(content: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text and hashed feature of every word and of every longer word's beginnings."""
    starts, ends = runs(LETTER[content], offsets)
    row = rows_at(offsets, starts)
    cuts = [np.minimum(starts + size, ends) for size in BEGINNINGS]
    whole, *parts = span_hashes(LOWER[content], starts, ends, *cuts)
    rows, hashes = [row], [whole]
    for cut, part in zip(cuts, parts):
        longer = cut < ends
        rows.append(row[longer])
        hashes.append(part[longer] ^ np.uint64(0x5BD1E995))
    return np.concatenate(rows), (np.concatenate(hashes) >> np.uint64(64 - BITS)).astype(np.int64)


def text_features(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Distinct (text, feature) pairs, block by block."""
    for start, end, parts in blocks(texts):
        seen = np.zeros(0, dtype=np.int64)
        for content, offsets in parts:
            if len(content):
                row, feature = word_features(content, offsets)
                seen = np.unique(np.r_[seen, row << BITS | feature])
        yield start, end, seen >> BITS, seen & ((1 << BITS) - 1)


class Model(NamedTuple):
    features: np.ndarray
    weights: np.ndarray
    bias: float


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def choose(lists: list[np.ndarray], labels: np.ndarray, size: int = VOCABULARY) -> np.ndarray:
    """The features that tell the labels apart most, among those of several texts."""
    total, of_one = np.zeros(1 << BITS), np.zeros(1 << BITS)
    for features, label in zip(lists, labels):
        total[features] += 1
        of_one[features] += label
    ones, rows = labels.sum(), len(labels)
    expected = total * ones / max(rows, 1)
    gain = (of_one - expected) ** 2 / np.maximum(expected, 0.5)
    gain[total < LEAST_TEXTS] = 0
    best = np.argsort(-gain, kind="stable")[:size]
    return np.sort(best[gain[best] > 0])


def _matrix(lists: list[np.ndarray], chosen: np.ndarray) -> np.ndarray:
    column = np.full(1 << BITS, -1, dtype=np.int32)
    column[chosen] = np.arange(len(chosen))
    out = np.zeros((len(lists), len(chosen)), dtype=np.float32)
    for i, features in enumerate(lists):
        at = column[features]
        out[i, at[at >= 0]] = 1
    return out


def fit(
    lists: list[np.ndarray],
    labels: np.ndarray,
    share: np.ndarray,
    pairs: list[tuple[np.ndarray, np.ndarray]],
    decay: float = 2e-4,
    fairness: float = 1.0,
    rounds: int = 300,
) -> Model:
    """Logistic regression by accelerated gradient steps.

    ``share`` weighs each row; ``pairs`` are features of texts and of their
    counterfactuals, whose difference in score is penalised by ``fairness``.
    """
    named = [w for a, b in pairs for w in np.setxor1d(a, b)]
    chosen = np.union1d(choose(lists, labels), np.unique(named).astype(np.int64))
    x = _matrix(lists, chosen)
    change = _matrix([b for _, b in pairs], chosen) - _matrix([a for a, _ in pairs], chosen)
    share = (share / share.sum()).astype(np.float32)
    prior = float((share * labels).sum())
    weights, bias = np.zeros(len(chosen), dtype=np.float32), np.log(max(prior, 1e-6) / max(1 - prior, 1e-6))
    momentum, square, m0, s0 = np.zeros_like(weights), np.zeros_like(weights), 0.0, 0.0
    for step in range(1, rounds + 1):
        error = (_sigmoid(x @ weights + bias) - labels).astype(np.float32) * share
        slope = x.T @ error + decay * weights
        if len(change):
            slope += fairness * change.T @ (change @ weights) / len(change)
        slope0 = float(error.sum())
        momentum, square = 0.9 * momentum + 0.1 * slope, 0.99 * square + 0.01 * slope**2
        m0, s0 = 0.9 * m0 + 0.1 * slope0, 0.99 * s0 + 0.01 * slope0**2
        rate = 0.05 * np.sqrt(1 - 0.99**step) / (1 - 0.9**step)
        weights = (weights - rate * momentum / (np.sqrt(square) + 1e-8)).astype(np.float32)
        bias -= rate * m0 / (np.sqrt(s0) + 1e-8)
    return Model(chosen, weights, float(bias))


def train(docs: DataFrame, labels: DataFrame, label: str, learn: Column, per_class: int = PER_CLASS) -> Model | None:
    """Fit on at most ``per_class`` labelled whole texts of either class."""
    picked, totals = sampling.labelled_ids(labels.where(learn), label, per_class)
    if not picked:
        return None

    @F.arrow_udf("struct<own: array<int>, swapped: array<int>>")
    def listed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            swapped = [counterfactual(t or "") for t in batch.to_pylist()]
            columns = []
            for texts in (batch, pa.array(swapped, pa.string())):
                out = []
                for start, end, row, feature in text_features(texts):
                    out += np.split(feature.astype(np.int32), np.searchsorted(row, np.arange(1, end - start)))
                columns.append(pa.array(out, pa.list_(pa.int32()), mask=None))
            none = pa.array([s is None for s in swapped])
            columns[1] = pc.if_else(none, pa.scalar(None, pa.list_(pa.int32())), columns[1])
            yield pa.StructArray.from_arrays(columns, ["own", "swapped"])

    rows = sampling.sampled(docs, picked, "int").select("label", listed("text").alias("f"))
    got = rows.select("label", "f.own", "f.swapped").toArrow()
    if not len(got):
        return None
    lists = [np.array(x.values, dtype=np.int64) for x in got["own"]]
    truth = got["label"].to_numpy().astype(np.float32)
    sampled = {value: max(1, int((truth == value).sum())) for value in totals}
    share = np.array([totals[v] / sampled[v] for v in got["label"].to_pylist()])
    pairs = [(a, np.array(b.values, dtype=np.int64)) for a, b in zip(lists, got["swapped"]) if b.is_valid]
    return fit(lists, truth, share, pairs)


def score(df: DataFrame, model: Model | None, text: str = "text") -> Column:
    """Score from 0 to 1 of every whole text; higher is likelier toxic."""
    if model is None:
        return F.lit(0.0)
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        learned = shared.value
        weight = np.zeros(1 << BITS, dtype=np.float32)
        weight[learned.features] = learned.weights
        for batch in batches:
            out = np.full(len(batch), learned.bias)
            for start, end, parts in blocks(batch):
                seen = np.zeros(0, dtype=np.int64)
                for content, offsets in parts:
                    if len(content):
                        row, feature = word_features(content, offsets)
                        known = weight[feature] != 0
                        seen = np.unique(np.r_[seen, row[known] << BITS | feature[known]])
                out[start:end] += np.bincount(seen >> BITS, weight[seen & ((1 << BITS) - 1)], end - start)
            yield pa.array(_sigmoid(out))

    return scored(F.coalesce(F.col(text), F.lit("")))
