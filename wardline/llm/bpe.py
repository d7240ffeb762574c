"""Byte-level BPE: encoding and decoding of whole texts by batched numpy merge rounds.

Texts are cut into words by the vocabulary's split pattern. The distinct words of a
batch are laid out as one flat array of symbols. In each round the rank of every
adjacent pair is found by binary search over the sorted pair keys, every word takes
its lowest rank and merges that pair wherever it stands, until no pair is left.

Defined results: a null text counts as empty and has no ids; null ids decode to the
empty text. Long texts are worked on in windows of bounded size, cut only where the
split pattern always ends a word (before white space that follows other characters).
"""

from __future__ import annotations

import functools
import json
import unicodedata
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW_CHARS = 400_000
WINDOW_IDS = 150_000
MOST_WORDS = 200_000
#: Fixed values of byte-level vocabularies: how a text is cut into words.
SPLIT = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?LETTER+| ?NUMBER+| ?[^\p{White_Space}LETTERNUMBER]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
_CUT = regex.compile(r"(?<=\P{White_Space})(?=\p{White_Space})")
NO_RANK = np.iinfo(np.int64).max


class Vocabulary(NamedTuple):
    """Arrays of a byte-level vocabulary; its size is that of the vocabulary file."""

    pair_keys: np.ndarray  # sorted, left * base + right
    pair_rank: np.ndarray
    pair_id: np.ndarray
    base: int
    byte_id: np.ndarray
    id_bytes: list[bytes]
    special: dict[str, int]
    later: frozenset[str]


def _byte_characters() -> list[str]:
    """The printable character that stands for each byte in the vocabulary file."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    shown = {b: chr(b) for b in plain}
    shifted = (b for b in range(256) if b not in shown)
    shown |= {b: chr(256 + i) for i, b in enumerate(shifted)}
    return [shown[b] for b in range(256)]


@functools.cache
def later_characters() -> frozenset[str]:
    """Characters that the regex module takes for letters or numbers and Python's Unicode tables do not know yet."""
    later = regex.compile(r"[\p{L}\p{N}]")
    return frozenset(c for c in map(chr, range(0x110000)) if unicodedata.category(c) == "Cn" and later.match(c))


def split_pattern(without: frozenset[str] = frozenset()) -> regex.Pattern:
    """The split pattern, with some characters taken out of the letters and numbers.

    The regex module may know a later Unicode version than the common tokenizers.
    """
    points = "".join(f"\\U{ord(c):08x}" for c in sorted(without))
    pattern = SPLIT
    for name, known in {"LETTER": r"\p{L}", "NUMBER": r"\p{N}"}.items():
        pattern = pattern.replace(name, f"[{known}--[{points}]]" if points else known)
    return regex.compile(pattern, regex.V1 if points else 0)


def load_vocabulary(path: str) -> Vocabulary:
    with open(path, encoding="utf-8") as file:
        content = json.load(file)
    ids = content["model"]["vocab"]
    special = {t["content"]: t["id"] for t in content["added_tokens"]}
    pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in content["model"]["merges"]]
    base = max([*ids.values(), *special.values()]) + 1
    keys = np.array([ids[a] * base + ids[b] for a, b in pairs], dtype=np.int64)
    order = np.argsort(keys)
    characters = _byte_characters()
    to_byte = {c: b for b, c in enumerate(characters)}
    id_bytes = [b""] * base
    for token, number in ids.items():
        id_bytes[number] = bytes(to_byte[c] for c in token)
    for token, number in special.items():
        id_bytes[number] = token.encode()
    return Vocabulary(
        keys[order],
        order.astype(np.int64),
        np.array([ids[a + b] for a, b in pairs], dtype=np.int64)[order],
        base,
        np.array([ids[c] for c in characters], dtype=np.int64),
        id_bytes,
        special,
        later_characters(),
    )


def merge_rounds(words: list[bytes], vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words in one flat array, and where each word starts (one more for the end)."""
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    word = np.repeat(np.arange(len(words)), lengths)
    symbol = vocabulary.byte_id[np.frombuffer(b"".join(words), dtype=np.uint8)]
    done_word, done_symbol = [], []
    while len(symbol):
        rank = np.full(len(symbol), NO_RANK)
        place = np.zeros(len(symbol), dtype=np.int64)
        if len(symbol) > 1:
            key = symbol[:-1] * vocabulary.base + symbol[1:]
            at = np.minimum(np.searchsorted(vocabulary.pair_keys, key), len(vocabulary.pair_keys) - 1)
            known = (vocabulary.pair_keys[at] == key) & (word[:-1] == word[1:])
            rank[:-1][known] = vocabulary.pair_rank[at[known]]
            place[:-1] = at
        starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        sizes = np.diff(np.r_[starts, len(word)])
        lowest = np.repeat(np.minimum.reduceat(rank, starts), sizes)
        finished = lowest == NO_RANK
        if finished.any():
            done_word.append(word[finished])
            done_symbol.append(symbol[finished])
            rest = ~finished
            word, symbol, rank, place, lowest = word[rest], symbol[rest], rank[rest], place[rest], lowest[rest]
            if not len(symbol):
                break
        merge = np.flatnonzero(rank == lowest)
        # equal neighbours overlap: of a run of places, every second one merges, from the left
        run = np.flatnonzero(np.r_[True, np.diff(merge) != 1])
        offset = np.arange(len(merge)) - np.repeat(run, np.diff(np.r_[run, len(merge)]))
        merge = merge[offset % 2 == 0]
        symbol[merge] = vocabulary.pair_id[place[merge]]
        keep = np.ones(len(symbol), dtype=bool)
        keep[merge + 1] = False
        word, symbol = word[keep], symbol[keep]
    all_word = np.concatenate(done_word) if done_word else np.zeros(0, dtype=np.int64)
    all_symbol = np.concatenate(done_symbol) if done_symbol else np.zeros(0, dtype=np.int64)
    order = np.argsort(all_word, kind="stable")
    counts = np.bincount(all_word, minlength=len(words))
    return all_symbol[order], np.r_[0, np.cumsum(counts)]


def _windows(text: str) -> Iterator[str]:
    start = 0
    while len(text) - start > WINDOW_CHARS:
        cut = _CUT.search(text, start + WINDOW_CHARS)
        if cut is None:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


class Encoder:
    """Encodes batches of texts; words met before are looked up, in a table of bounded size."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        names = sorted(vocabulary.special, key=len, reverse=True)
        self.special = regex.compile("(" + "|".join(map(regex.escape, names)) + ")") if names else None
        self.words, self.rare_words = split_pattern(), None
        self._forget()

    def _forget(self) -> None:
        self.index: dict[str, int] = {}
        self.flat = np.zeros(0, dtype=np.int32)
        self.starts = np.zeros(0, dtype=np.int64)
        self.length = np.zeros(0, dtype=np.int64)

    def _split(self, text: str) -> list[str]:
        if text.isascii() or self.vocabulary.later.isdisjoint(text):
            return self.words.findall(text)
        self.rare_words = self.rare_words or split_pattern(self.vocabulary.later)
        return self.rare_words.findall(text)

    def _segments(self, text: str) -> list[str]:
        """Words of a text in order; a special token is a word of its own."""
        found: list[str] = []
        for window in _windows(text):
            if self.special is None or self.special.search(window) is None:
                found += self._split(window)
            else:
                for part in self.special.split(window):
                    found += [part] if part in self.vocabulary.special else self._split(part)
        return found

    def _learn(self, words: list[str]) -> None:
        special = self.vocabulary.special
        fresh = [w for w in dict.fromkeys(words) if w not in self.index]
        flat, starts = merge_rounds([b"" if w in special else w.encode() for w in fresh], self.vocabulary)
        starts, length = starts[:-1], np.diff(starts)
        fixed = [i for i, w in enumerate(fresh) if w in special]
        if fixed:
            starts[fixed] = len(flat) + np.arange(len(fixed))
            length[fixed] = 1
            flat = np.r_[flat, [special[fresh[i]] for i in fixed]]
        self.index.update(zip(fresh, range(len(self.index), len(self.index) + len(fresh))))
        self.starts = np.r_[self.starts, starts + len(self.flat)]
        self.length = np.r_[self.length, length]
        self.flat = np.r_[self.flat, flat.astype(np.int32)]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of some texts and the offsets of each text in them."""
        words: list[str] = []
        ends = [0]
        for text in texts:
            words += self._segments(text)
            ends.append(len(words))
        if len(self.index) > MOST_WORDS:
            self._forget()
        self._learn(words)
        used = np.fromiter(map(self.index.__getitem__, words), dtype=np.int64, count=len(words))
        ids, before = gather(self.flat, self.starts, self.length, used)
        return ids, before[np.array(ends)]


def gather(flat: np.ndarray, starts: np.ndarray, length: np.ndarray, used: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pieces ``used`` of a flat array one after the other, and where each begins (one more for the end)."""
    sizes = length[used]
    before = np.r_[0, np.cumsum(sizes)]
    return flat[np.repeat(starts[used] - before[:-1], sizes) + np.arange(before[-1])], before


class Decoder:
    """Decodes batches of id arrays."""

    def __init__(self, id_bytes: list[bytes]):
        self.flat = np.frombuffer(b"".join(id_bytes), dtype=np.uint8)
        self.length = np.array([len(b) for b in id_bytes], dtype=np.int64)
        self.starts = np.r_[0, np.cumsum(self.length)[:-1]]

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
        content, before = gather(self.flat, self.starts, self.length, ids)
        ends, raw = before[offsets], content.tobytes()
        return [raw[a:b].decode("utf-8", "replace") for a, b in zip(ends[:-1], ends[1:])]


def item_groups(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of about ``most`` units each; one large item stands alone."""
    start, total = 0, 0
    for i, size in enumerate(sizes):
        if total and total + size > most:
            yield start, i
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield start, len(sizes)


def in_groups(batches: Iterator[pa.Array], sizes: Callable[[pa.Array], pa.Array], most: int) -> Iterator[pa.Array]:
    """The rows of all batches in slices of about ``most`` units; what is made of a slice can leave at once."""
    for batch in batches:
        for start, end in item_groups(pc.fill_null(sizes(batch), 0).to_pylist(), most):
            yield batch.slice(start, end - start)


def _loaded(vocabulary: str | Vocabulary) -> Vocabulary:
    return load_vocabulary(vocabulary) if isinstance(vocabulary, str) else vocabulary


def encode(df: DataFrame, vocabulary: str | Vocabulary, text: str = "text", output: str = "ids") -> DataFrame:
    """Adds the token ids of every whole text; a vocabulary file is read by the driver only."""
    shared = df.sparkSession.sparkContext.broadcast(_loaded(vocabulary))

    @F.arrow_udf("array<int>")
    def encoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = Encoder(shared.value)
        for part in in_groups(batches, pc.binary_length, WINDOW_CHARS):
            ids, offsets = encoder.encode([x or "" for x in part.to_pylist()])
            yield pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids))

    return df.withColumn(output, encoded(F.col(text)))


def decode(df: DataFrame, vocabulary: str | Vocabulary, ids: str = "ids", output: str = "decoded") -> DataFrame:
    """Adds the text of an array of ids; bytes that are no UTF-8 become replacement characters."""
    shared = df.sparkSession.sparkContext.broadcast(_loaded(vocabulary).id_bytes)

    @F.arrow_udf("string")
    def decoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        decoder = Decoder(shared.value)
        for part in in_groups(batches, pc.list_value_length, WINDOW_IDS):
            sizes = pc.fill_null(pc.list_value_length(part), 0).to_pylist()
            ids = part.flatten().to_numpy(zero_copy_only=False)
            yield pa.array(decoder.decode(ids, np.r_[0, np.cumsum(sizes)]), pa.string())

    return df.withColumn(output, decoded(F.col(ids)))
