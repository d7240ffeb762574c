"""Alignment of two tokenizers: groups of tokens between shared ends, and how id pairs link over a corpus.

Every text is encoded by a byte-level vocabulary (A) and a piece model (B). Byte offsets
where a token of A and one of B both end cut the text into groups. They are found by
divide and conquer: in each interval a common end near the middle is looked for by
bisection of B's ends, in windows around the middle that double in width, and both halves
go on; an interval without a common end inside is a group. The intervals of all texts of
a window are worked on together, level by level.

Within a group every token of A is linked with every token of B. A pair of ids counts as
many documents as hold it linked. Documents are worked on in blocks of bounded size: a
block has its distinct pairs once, with the number of its documents that hold each, so
that common pairs collapse before the shuffle; the counts come back to each block once
per distinct pair, and documents are never expanded into rows of links.

Defined results: null and empty texts, and texts whose tokens do not give back a space and
the text (those that hold a space mark), have no tokens: zeros and an empty digest.
Repeated rows are documents of their own. Long texts are aligned whole. Only the id and
text columns are read, so other columns may have any name. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardline.llm import bpe, piece_bpe
from wardline.llm.bpe import gather, item_groups
from wardline.plans.stages import Stages

WINDOW_CHARS = 250_000
_COUNTS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")
#: Distinct (document, pair) entries of a block, and links made at once.
BLOCK_ENTRIES = 1_000_000
MOST_LINKS = 2_000_000


class Groups(NamedTuple):
    """Groups in order: index of the last token of A and of B in each."""

    last_a: np.ndarray
    last_b: np.ndarray


def common_ends(a_end: np.ndarray, b_end: np.ndarray, a_last: np.ndarray, b_last: np.ndarray) -> Groups:
    """Groups of several texts at once.

    ``a_end`` and ``b_end`` hold the ends of all tokens, rising over all texts; ``a_last``
    and ``b_last`` the last token of each text, which end at the same byte.
    """
    low_a, low_b = np.r_[0, a_last[:-1] + 1][: len(a_last)], np.r_[0, b_last[:-1] + 1][: len(b_last)]
    high_a, high_b = a_last.copy(), b_last.copy()  # the last token, whose end is common already
    cut_a, cut_b = [a_last], [b_last]
    width = np.zeros(len(a_last), dtype=np.int64)
    while len(low_a):
        open_ = (high_a > low_a) & (high_b > low_b)
        low_a, high_a, low_b, high_b, width = (x[open_] for x in (low_a, high_a, low_b, high_b, width))
        if not len(low_a):
            break
        # ends low_a .. high_a - 1 are inside; the window is [middle - width, middle + width]
        middle = (low_a + high_a - 1) // 2
        first, last = np.maximum(middle - width, low_a), np.minimum(middle + width, high_a - 1)
        size = last - first + 1
        start = np.r_[0, np.cumsum(size)]
        owner = np.repeat(np.arange(len(size)), size)
        probe = np.arange(start[-1]) - np.repeat(start[:-1] - first, size)
        at = np.searchsorted(b_end, a_end[probe])
        hit = b_end[at] == a_end[probe]
        away = np.where(hit, np.abs(probe - middle[owner]), np.iinfo(np.int64).max)
        nearest = np.minimum.reduceat(away, start[:-1])
        found = nearest < np.iinfo(np.int64).max
        chosen = np.flatnonzero(hit & (away == nearest[owner]))
        chosen = chosen[np.r_[True, owner[chosen][1:] != owner[chosen][:-1]][: len(chosen)]]
        split_a, split_b = probe[chosen], at[chosen]
        cut_a.append(split_a)
        cut_b.append(split_b)
        wider = ~found & ((first > low_a) | (last < high_a - 1))
        low_a, high_a, low_b, high_b, width = (
            np.concatenate((low_a[found], split_a + 1, low_a[wider])),
            np.concatenate((split_a, high_a[found], high_a[wider])),
            np.concatenate((low_b[found], split_b + 1, low_b[wider])),
            np.concatenate((split_b, high_b[found], high_b[wider])),
            np.concatenate((np.zeros(2 * len(split_a), dtype=np.int64), 2 * width[wider] + 1)),
        )
    last_a = np.concatenate(cut_a)
    order = np.argsort(last_a)
    return Groups(last_a[order], np.concatenate(cut_b)[order])


class Aligner:
    """Aligns batches of texts; holds both encoders."""

    def __init__(self, vocabulary: bpe.Vocabulary, model: piece_bpe.Model):
        self.a = bpe.Encoder(vocabulary._replace(special={}))
        self.b = piece_bpe.Encoder(model)
        byte_id = {int(i): value for value, i in enumerate(model.byte_id)}
        self.bytes_a = _table(vocabulary.id_bytes)
        self.bytes_b = _table([bytes([byte_id[i]]) if i in byte_id else b for i, b in enumerate(model.id_bytes)])
        self.size_a, self.size_b = len(vocabulary.id_bytes), model.size
        self.digits = _table([b"%d," % i for i in [*range(self.size_a), *range(self.size_b)]])

    def align(self, texts: list[str]) -> tuple[list[tuple], np.ndarray, np.ndarray, np.ndarray]:
        """Per text ``n_a, n_b, n_groups, n_links, groups_sha256``; and entries as text, pair of ids and times linked."""
        whole = [" " + t for t in texts]
        ids_a, ends_a = self.a.encode(whole)
        ids_b, ends_b = self.b.encode(texts)
        content = [t.encode() for t in whole]
        same_a, same_b = _gives(ids_a, ends_a, self.bytes_a, content), _gives(ids_b, ends_b, self.bytes_b, content)
        good = np.array([bool(t) for t in texts]) & same_a & same_b
        count_a, count_b = np.diff(ends_a) * good, np.diff(ends_b) * good
        ids_a = ids_a[np.repeat(good, np.diff(ends_a))].astype(np.int64)
        ids_b = ids_b[np.repeat(good, np.diff(ends_b))].astype(np.int64)
        results = [(0, 0, 0, 0, "")] * len(texts)
        kept = np.flatnonzero(good)
        if not len(kept):
            none = np.zeros(0, dtype=np.int64)
            return results, none, none, none
        last_a, last_b = np.cumsum(count_a[kept]) - 1, np.cumsum(count_b[kept]) - 1
        groups = common_ends(
            np.cumsum(self.bytes_a[2][ids_a]), np.cumsum(self.bytes_b[2][ids_b]), last_a, last_b
        )
        n_a, n_b = np.diff(groups.last_a, prepend=-1), np.diff(groups.last_b, prepend=-1)
        text_of = np.searchsorted(last_a, groups.last_a)
        n_groups = np.bincount(text_of, minlength=len(kept))
        n_links = np.zeros(len(kept), dtype=np.int64)
        np.add.at(n_links, text_of, n_a * n_b)
        digests = self._digests(ids_a, ids_b, groups, n_a, n_b, count_a[kept], count_b[kept])
        for i, row in enumerate(kept.tolist()):
            results[row] = int(count_a[row]), int(count_b[row]), int(n_groups[i]), int(n_links[i]), digests[i]
        text, pair, times = self._entries(ids_a, ids_b, groups, n_a, n_b, kept[text_of], len(texts))
        return results, text, pair, times

    def _digests(self, ids_a, ids_b, groups, n_a, n_b, count_a, count_b) -> list[str]:
        group_a, group_b = np.repeat(np.arange(len(n_a)), n_a), np.repeat(np.arange(len(n_b)), n_b)
        place_a = np.arange(len(ids_a)) + (groups.last_b + 1 - n_b)[group_a]
        place_b = np.arange(len(ids_b)) + (groups.last_a + 1)[group_b]
        mixed = np.zeros(len(ids_a) + len(ids_b), dtype=np.int64)
        mixed[place_a], mixed[place_b] = ids_a, ids_b + self.size_a
        shown, before = gather(*self.digits, mixed)
        shown = shown.copy()
        shown[before[place_a[groups.last_a] + 1] - 1] = ord("|")
        shown[before[place_b[groups.last_b] + 1] - 1] = ord(";")
        ends = before[np.r_[0, np.cumsum(count_a + count_b)]].tolist()
        raw = shown.tobytes()
        return [hashlib.sha256(raw[a : b - 1]).hexdigest() for a, b in zip(ends[:-1], ends[1:])]

    def _entries(self, ids_a, ids_b, groups, n_a, n_b, text_of, texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct (text, pair) with how often it is linked, from bounded stretches of links."""
        group = np.repeat(np.arange(len(n_a)), n_a)
        begin_b = groups.last_b + 1 - n_b
        linked = np.r_[0, np.cumsum(n_b[group])]
        space = self.size_a * self.size_b
        if space * texts >= 1 << 62:
            raise ValueError("vocabularies too large for one 64-bit number per text and pair")
        done_key, done_times, start = [], [], 0
        while start < len(group):
            end = max(start + 1, int(np.searchsorted(linked, linked[start] + MOST_LINKS, side="right")) - 1)
            own, size = group[start:end], n_b[group[start:end]]
            first = np.repeat(begin_b[own] - (linked[start:end] - linked[start]), size)
            b = ids_b[first + np.arange(linked[end] - linked[start])]
            key = np.repeat(text_of[own] * space + ids_a[start:end] * self.size_b, size) + b
            values, times = np.unique(key, return_counts=True)
            done_key.append(values)
            done_times.append(times)
            start = end
        key, times = done_key[0], done_times[0]
        if len(done_key) > 1:
            key, where = np.unique(np.concatenate(done_key), return_inverse=True)
            times = np.bincount(where, weights=np.concatenate(done_times)).astype(np.int64)
        return key // space, key % space, times


def _table(items: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Flat bytes with the start and length of each item."""
    length = np.array([len(b) for b in items], dtype=np.int64)
    return np.frombuffer(b"".join(items), dtype=np.uint8), np.r_[0, np.cumsum(length)[:-1]], length


def _gives(ids: np.ndarray, ends: np.ndarray, table: tuple, content: list[bytes]) -> np.ndarray:
    """Whether the joined bytes of each text's tokens are the wanted ones."""
    joined, before = gather(*table, ids)
    raw, cuts = joined.tobytes(), before[ends].tolist()
    return np.array([raw[a:b] == c for a, b, c in zip(cuts[:-1], cuts[1:], content)], dtype=bool)


def _packed(numbers: np.ndarray) -> bytes:
    return zlib.compress(numbers.astype(np.int32).tobytes(), 1)


def _unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data), dtype=np.int32).astype(np.int64)


_BLOCK = {
    "block": pa.int64(),
    "n_a": pa.list_(pa.int64()),
    "n_b": pa.list_(pa.int64()),
    "n_groups": pa.list_(pa.int64()),
    "n_links": pa.list_(pa.int64()),
    "groups_sha256": pa.list_(pa.string()),
    "sizes": pa.binary(),
    "places": pa.binary(),
    "times": pa.binary(),
    "pair": pa.list_(pa.int64()),
    "docs": pa.list_(pa.int64()),
}


def _block(number: int, ids: list[pa.Array], results: list[tuple], entries: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    """One row for many documents: their own results, their entries, and the distinct pairs of them all."""
    text, pair, times = (np.concatenate(x) for x in zip(*entries))
    pairs, place, docs = np.unique(pair, return_inverse=True, return_counts=True)
    sizes = np.bincount(text, minlength=len(results))
    # entries are sorted by text and pair, so the places of a text rise: steps are small numbers
    step = np.diff(place, prepend=0)
    columns = [[x] for x in zip(*results)]
    own = pa.concat_arrays(ids)
    arrays = [pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own), pa.array([number], pa.int64())]
    arrays += [pa.array(c, schema.field(name).type) for c, name in zip(columns, list(_BLOCK)[1:6])]
    arrays += [pa.array([_packed(x)], pa.binary()) for x in (sizes, step, times)]
    arrays += [pa.array([x], pa.list_(pa.int64())) for x in (pairs, docs)]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def align(df: DataFrame, vocabulary_path: str, model_path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: id, ``n_a, n_b, n_groups, n_links, n_best, count_sum`` (long) and ``groups_sha256``."""
    spark = df.sparkSession
    vocabulary, model = bpe.load_vocabulary(vocabulary_path), piece_bpe.load_model(model_path)
    shared = spark.sparkContext.broadcast((vocabulary, model))
    id_type = df.schema[doc_id].dataType
    spark_types = {pa.int64(): T.LongType(), pa.binary(): T.BinaryType()}
    fields = [T.StructField("ids", T.ArrayType(id_type))]
    for name, kind in _BLOCK.items():
        plain = spark_types.get(kind) or T.ArrayType(T.StringType() if kind == pa.list_(pa.string()) else T.LongType())
        fields.append(T.StructField(name, plain))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(*shared.value)
        number = TaskContext.get().partitionId() << 32
        ids, results, entries, held, schema = [], [], [], 0, None
        for batch in batches:
            schema = schema or pa.schema([("ids", pa.list_(batch.column(0).type)), *_BLOCK.items()])
            sizes = [s or 0 for s in pc.binary_length(batch.column(1)).to_pylist()]
            for start, end in item_groups(sizes, WINDOW_CHARS):
                part = batch.slice(start, end - start)
                own, texts, pairs, times = aligner.align([t or "" for t in part.column(1).to_pylist()])
                ids.append(part.column(0))
                entries.append((texts + len(results), pairs, times))
                results += own
                held += len(pairs)
                if held >= BLOCK_ENTRIES:
                    yield _block(number, ids, results, entries, schema)
                    ids, results, entries, held, number = [], [], [], 0, number + 1
        if results:
            yield _block(number, ids, results, entries, schema)

    stages = Stages(spark, "align")
    made = stages.write(df.select(F.col(doc_id), F.col(text)).mapInArrow(blocks, T.StructType(fields)))
    base = model.size
    listed = made.select("block", F.posexplode(F.arrays_zip("pair", "docs")).alias("place", "entry"))
    listed = listed.select("block", "place", "entry.pair", "entry.docs")
    counts = listed.groupBy("pair").agg(F.sum("docs").alias("count"))
    # the pairs of one id of A are at most as many as B has ids
    highest = F.max("count").over(Window.partitionBy(F.floor(F.col("pair") / base)))
    counts = counts.select("pair", "count", (F.col("count") == highest).alias("best"))
    back = listed.select("block", "place", "pair").join(counts, "pair").select(F.col("block").alias("known_block"), F.col("place").alias("known_place"), "count", "best")
    out = T.StructType([T.StructField("_id", id_type), *[T.StructField(name, T.LongType()) for name in _COUNTS]])
    out.add("groups_sha256", T.StringType())
    own = made.drop("pair", "docs").groupBy("block")
    return own.cogroup(back.groupBy("known_block")).applyInArrow(_documents, out).withColumnRenamed("_id", doc_id)


def _documents(own: pa.Table, back: pa.Table) -> pa.Table:
    """The documents of one block, with their entries' counts summed."""
    value = {name: own.column(name).chunk(0)[0] for name in own.schema.names}
    sizes, steps, times = (_unpacked(value[name].as_py()) for name in ("sizes", "places", "times"))
    place, ends = np.cumsum(steps), np.r_[0, np.cumsum(sizes)]
    order = np.argsort(back.column("known_place").to_numpy())
    count = back.column("count").to_numpy()[order]
    best = back.column("best").to_numpy()[order].astype(np.int64)
    running = [np.r_[0, np.cumsum(times * x[place])] for x in (best, count)]
    columns = [value[name].values for name in ("ids", "n_a", "n_b", "n_groups", "n_links")]
    columns += [pa.array(np.diff(x[ends])) for x in running]
    return pa.table([*columns, value["groups_sha256"].values], ["_id", *_COUNTS, "groups_sha256"])
