"""Quality by nearest-neighbour voting among labelled latent-semantic vectors.

Terms are the shapes of a text's words, pairs of neighbouring shapes, and marks for
words that repeat. Labelled texts give a term weighting and a truncated singular value
decomposition; every text becomes a unit vector in that space. The labelled vectors are
broadcast, their exact cosines with each block of texts are one matrix product, and the
nearest ones vote with a weight that grows with their similarity.

Defined results: null, empty and white-space texts have no terms, hence no neighbours,
and get score 0; so does every text without labelled rows. Ties in similarity are
resolved by the order of the labelled rows. Repeated rows get the same score.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.llm import sampling
from wardline.llm.textops import LETTER, WHITE, count_blocks, mix, rows_at, runs, span_hashes

BUCKETS = 2048
RANK = 48
PER_CLASS = 1500
NEIGHBOURS = 15
POWER = 8
BLOCK_TEXTS = 256

_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[LETTER] = ord("a")
_SHAPE[ord("A") : ord("Z") + 1] = ord("A")
_SHAPE[ord("0") : ord("9") + 1] = ord("0")


def terms(content: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text and hashed term of every word shape, shape pair and repeat mark."""
    starts, ends = runs(~WHITE[content], offsets)
    if not len(starts):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    row = rows_at(offsets, starts)
    (word,) = span_hashes(content, starts, ends)
    shown = _SHAPE[content]
    keep = np.ones(len(shown), dtype=bool)
    keep[1:] = (shown[1:] != shown[:-1])  # a run of one kind of character counts as one
    keep[starts] = True
    before = np.r_[0, np.cumsum(keep)]
    (shape,) = span_hashes(shown[keep], before[starts], before[ends])
    next_own = row[1:] == row[:-1]
    pair = mix(shape[:-1] * np.uint64(3) + shape[1:])[next_own]
    again = next_own & (word[1:] == word[:-1])
    lined = np.zeros(len(content) + 1, dtype=np.int64)
    np.cumsum(content == 0x0A, out=lined[1:])
    opens = np.flatnonzero(np.r_[True, ~next_own | (lined[starts[1:]] != lined[starts[:-1]])])
    marks = [
        (row, shape),
        (row[1:][next_own], pair ^ np.uint64(1)),
        (row[1:][again], np.full(int(again.sum()), 7, dtype=np.uint64)),
        (row[opens], mix(shape[opens] + np.uint64(11))),
    ]
    rows = np.concatenate([r for r, _ in marks])
    hashes = mix(np.concatenate([h for _, h in marks]))
    return rows, (hashes >> np.uint64(64 - int(np.log2(BUCKETS)))).astype(np.int64)


class Model(NamedTuple):
    weight: np.ndarray  # per term
    axes: np.ndarray  # terms x rank
    vectors: np.ndarray  # labelled rows x rank, of length 1
    labels: np.ndarray
    share: np.ndarray


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def _latent(counts: np.ndarray, weight: np.ndarray, axes: np.ndarray) -> np.ndarray:
    rates = counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)
    return _unit((np.sqrt(rates).astype(np.float32) * weight) @ axes)


def fit(counts: np.ndarray, labels: np.ndarray, share: np.ndarray, rank: int = RANK) -> Model:
    """Truncated decomposition by power iterations on a random start of a few more directions."""
    rows = len(counts)
    present = (counts > 0).sum(axis=0)
    weight = np.where(present > 1, np.log((1 + rows) / (1 + present)) + 1, 0).astype(np.float32)
    rates = counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)
    x = _unit(np.sqrt(rates).astype(np.float32) * weight)
    random = np.random.default_rng(3)
    basis = np.linalg.qr(x.T @ random.standard_normal((rows, min(rank + 8, rows))).astype(np.float32))[0]
    for _ in range(4):
        basis = np.linalg.qr(x.T @ (x @ basis))[0]
    _, _, turned = np.linalg.svd(x @ basis, full_matrices=False)
    axes = (basis @ turned.T)[:, :rank].astype(np.float32)
    return Model(weight, axes, _latent(counts, weight, axes), labels.astype(np.float32), share.astype(np.float32))


def vote(model: Model, counts: np.ndarray) -> np.ndarray:
    """Share of the nearest labelled rows' weight that has label 1."""
    vectors = _latent(counts, model.weight, model.axes)
    cosine = vectors @ model.vectors.T
    size = min(NEIGHBOURS, cosine.shape[1])
    near = np.argpartition(-cosine, size - 1, axis=1)[:, :size]
    weight = np.maximum(np.take_along_axis(cosine, near, axis=1), 0) ** POWER * model.share[near]
    score = (weight * model.labels[near]).sum(axis=1) / np.maximum(weight.sum(axis=1), 1e-9)
    return np.where(counts.sum(axis=1) > 0, np.clip(score, 0, 1), 0.0)


def train(docs: DataFrame, labels: DataFrame, label: str, learn: Column, per_class: int = PER_CLASS) -> Model | None:
    """Fit on at most ``per_class`` labelled whole texts of either class; that bounds what is broadcast."""
    picked, totals = sampling.labelled_ids(labels.where(learn), label, per_class)
    if not picked:
        return None

    @F.arrow_udf("binary")
    def counted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            out = [row.astype(np.float32).tobytes() for *_, counts in count_blocks(batch, BUCKETS, terms, BLOCK_TEXTS) for row in counts]
            yield pa.array(out, pa.binary())

    rows = sampling.sampled(docs, picked, "int")
    got = rows.select("doc_id", "label", counted(F.coalesce("text", F.lit(""))).alias("terms")).toArrow().sort_by("doc_id")
    if not len(got):
        return None
    counts = np.frombuffer(b"".join(got["terms"].to_pylist()), dtype=np.float32).reshape(-1, BUCKETS)
    truth = got["label"].to_numpy()
    share = np.array([totals[v] / max(1, (truth == v).sum()) for v in truth])
    return fit(counts, truth, share / share.max())


def score(df: DataFrame, model: Model | None, text: str = "text") -> Column:
    """Score from 0 to 1 of every whole text; higher is likelier of label 1."""
    if model is None:
        return F.lit(0.0)
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            scores = [vote(shared.value, counts) for *_, counts in count_blocks(batch, BUCKETS, terms, BLOCK_TEXTS)]
            yield pa.array(np.concatenate([np.zeros(0), *scores]), pa.float64())

    return scored(F.coalesce(F.col(text), F.lit("")))
