"""Numpy helpers over the UTF-8 bytes of whole texts, in pieces of bounded size.

A batch of texts is one flat byte array with offsets, as Arrow holds it. Work is done
on short texts of about ``BLOCK_BYTES`` together, or on one text, a long one in stretches
of about ``PIECE_BYTES`` cut at white space, so that memory does not grow with the longest text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE_BYTES = 1 << 20
#: Bytes of the texts of one block together; a longer text is a block of its own.
BLOCK_BYTES = 1 << 18

WHITE = np.zeros(256, dtype=bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
#: ASCII letters, and every byte of a character beyond ASCII.
LETTER = np.zeros(256, dtype=bool)
LETTER[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1), *range(0x80, 256)]] = True

_STEP = 0x9E3779B97F4A7C15 | 1
_BACK = pow(_STEP, -1, 1 << 64)
_powers = {_STEP: np.ones(1, dtype=np.uint64), _BACK: np.ones(1, dtype=np.uint64)}


def _power_table(base: int, size: int) -> np.ndarray:
    """1, base, base**2, ... modulo 2**64."""
    table = _powers[base]
    if len(table) < size:
        table = np.full(max(size, BLOCK_BYTES), base, dtype=np.uint64)
        table[0] = 1
        _powers[base] = table = np.multiply.accumulate(table)
    return table


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values over all bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def span_hashes(values: np.ndarray, starts: np.ndarray, *ends: np.ndarray) -> list[np.ndarray]:
    """64-bit hashes of the stretches from ``starts`` to each of ``ends``, from one running sum."""
    running = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * _power_table(_STEP, len(values) + 1)[: len(values)], out=running[1:])
    first, scale = running[starts], _power_table(_BACK, len(values) + 1)[starts]
    return [mix((running[end] - first) * scale + (end - starts).astype(np.uint64)) for end in ends]


def runs(mask: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of set bytes, none across two texts."""
    before = np.zeros(len(mask) + 1, dtype=bool)
    before[1:] = mask
    after = before.copy()
    after[:-1] = mask
    after[-1] = False
    edge = np.zeros(len(mask) + 1, dtype=bool)
    edge[offsets] = True
    return np.flatnonzero(after & (~before | edge)), np.flatnonzero(before & (~after | edge))


def rows_at(offsets: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The text that each byte position belongs to."""
    return np.searchsorted(offsets, places, side="right") - 1


def _stretches(content: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """A long text in pieces that end at white space (a longer word stays whole)."""
    start = 0
    while start < len(content):
        end = min(start + PIECE_BYTES, len(content))
        if end < len(content):
            white = np.flatnonzero(WHITE[content[start:end]])
            if len(white):
                end = start + int(white[-1]) + 1
            else:
                ahead = np.flatnonzero(WHITE[content[end:]])
                end = end + int(ahead[0]) + 1 if len(ahead) else len(content)
        yield content[start:end], np.array([0, end - start])
        start = end


def blocks(
    texts: pa.Array, most_rows: int = 1 << 30
) -> Iterator[tuple[int, int, Iterator[tuple[np.ndarray, np.ndarray]]]]:
    """Consecutive texts as (first row, end row, pieces); a piece is bytes with the offsets of its texts.

    A block has one piece, but for a block of one long text. Null texts are empty.
    """
    texts = pc.fill_null(texts, "")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, places, data = texts.buffers()
    if not len(texts):
        return
    offsets = np.frombuffer(places, dtype=kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    content = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    row = 0
    while row < len(texts):
        fits = int(np.searchsorted(offsets, offsets[row] + min(BLOCK_BYTES, PIECE_BYTES), side="right")) - 1
        end = min(max(row + 1, fits), row + most_rows, len(texts))
        own = content[offsets[row] : offsets[end]]
        if len(own) > PIECE_BYTES:
            yield row, end, _stretches(own)
        else:
            yield row, end, iter([(own, offsets[row : end + 1] - offsets[row])])
        row = end


def count_blocks(
    texts: pa.Array, buckets: int, features: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]], most_rows: int = 64
) -> Iterator[tuple[int, int, np.ndarray]]:
    """Counts of hashed features per text, block by block; ``features`` gives (text, bucket) of a piece."""
    for start, end, parts in blocks(texts, most_rows):
        counts = np.zeros((end - start) * buckets)
        for content, offsets in parts:
            if len(content):
                row, bucket = features(content, offsets)
                counts += np.bincount(row * buckets + bucket, minlength=len(counts))
        yield start, end, counts.reshape(end - start, buckets)
