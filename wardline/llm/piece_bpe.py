"""SentencePiece BPE: encoding and decoding of whole texts by vectorised merge rounds.

A text gets one leading space mark and every space becomes one. Texts are cut where no
piece of the vocabulary could ever reach across: before runs of space marks, and inside a
word between characters that stand next to each other in no piece. The distinct words of
a batch lie in one flat array of symbols. In each round every word takes the lowest rank
among its pairs and merges all places that have it at once, from the left; finished words
leave the array, until no pair is left.

A vocabulary of pieces (other than a list of merges) may give a merged pair a neighbour
that ranks before it. The next merge is then inside that neighbourhood, so of the places
of one word only those up to and with the first such place merge in the same round. That
keeps the order of merges exact: lowest rank first, then leftmost. A word that still has
pairs after ``MOST_ROUNDS`` rounds, which only very long unbroken runs reach, is finished
in the same order with a heap, so that time stays near linear in its length.

Defined results: a null text counts as empty and has no ids; null ids decode to the empty
text. Characters without a piece become one id per UTF-8 byte; bytes that are no UTF-8
decode to one replacement character each. Long texts are worked on in windows. Columns
besides the text are passed through whatever their names; repeated rows give equal rows.
"""

from __future__ import annotations

import codecs
import heapq
import re
import struct
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.llm.bpe import NO_RANK, gather, in_groups

WINDOW_CHARS = 100_000
WINDOW_IDS = 100_000
MOST_WORDS = 250_000
MOST_CHARS = 5_000_000
MOST_ROUNDS = 48
#: Fixed values of the model file: the space mark, and the kinds of pieces.
SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
UNKNOWN_TEXT = " ⁇ "
_WORD = re.compile(f"{SPACE}+[^{SPACE}]*")
_CUT = re.compile(f"(?<=[^ {SPACE}])(?=[ {SPACE}])")
_POINTS = 0x110000


class Model(NamedTuple):
    """Arrays of a model; a symbol is a piece's id, or ``size`` plus the code point of a character without one."""

    size: int
    pair_keys: np.ndarray  # sorted, left * base + right
    pair_rank: np.ndarray
    pair_id: np.ndarray
    base: int
    touchy: np.ndarray  # pieces with a pair that ranks no later than the piece itself
    character: np.ndarray  # symbol of each code point
    alphabet: np.ndarray  # number of each code point among the characters of pieces, 0 for any other
    neighbours: np.ndarray  # whether two such characters stand side by side in some piece
    spaces_lead: bool  # no piece has a space mark after another character
    byte_id: np.ndarray
    id_bytes: list[bytes]
    strips: np.ndarray  # 1: begins with a space mark, 2: control, 0: any other


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        shift += 7
        if byte < 128:
            return value, at


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and value of each field of a message; fixed-width values stay bytes."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(data, at)
        else:
            size = {1: 8, 5: 4}.get(kind)
            if size is None:
                size, at = _varint(data, at)
            value, at = data[at : at + size], at + size
        yield key >> 3, value


def read_pieces(path: str) -> list[tuple[str, float, int]]:
    """Text, score and kind of each piece, in id order."""
    with open(path, "rb") as file:
        content = file.read()
    pieces, trainer, normalizer = [], {}, {}
    for number, value in _fields(content):
        if number == 1:
            own = dict(_fields(value))
            pieces.append((own[1].decode(), struct.unpack("<f", own.get(2, b"\0\0\0\0"))[0], own.get(3, NORMAL)))
        elif number == 2:
            trainer = dict(_fields(value))
        elif number == 3:
            normalizer = dict(_fields(value))
    plain = normalizer.get(2, b"") == b"" and normalizer.get(3, 1) and not normalizer.get(4, 1) and normalizer.get(5, 1)
    known = {kind for *_, kind in pieces} <= {NORMAL, UNKNOWN, CONTROL, BYTE}
    if trainer.get(3) != 2 or not trainer.get(35) or trainer.get(24) or not plain or not known:
        raise ValueError("only BPE models with byte fallback and plain spaces in front are supported")
    return pieces


def load_model(path: str) -> Model:
    pieces = read_pieces(path)
    size = len(pieces)
    ids = {text: i for i, (text, _, kind) in enumerate(pieces) if kind == NORMAL}
    order = np.array([-pieces[i][1] for i in ids.values()])
    rank = dict(zip(ids, np.unique(order, return_inverse=True)[1].tolist()))

    def symbol(text: str) -> int | None:
        return ids.get(text, size + ord(text) if len(text) == 1 else None)

    base = size + _POINTS
    pairs: dict[int, tuple[int, int]] = {}
    touchy = np.zeros(base, dtype=bool)
    for text, number in ids.items():
        for i in range(1, len(text)):
            halves = text[:i], text[i:]
            left, right = map(symbol, halves)
            if left is not None and right is not None:
                pairs[left * base + right] = rank[text], number
                for half in halves:
                    if half in ids and rank[text] <= rank[half]:
                        touchy[ids[half]] = True
    keys = np.array(sorted(pairs), dtype=np.int64)
    found = np.array([pairs[k] for k in keys.tolist()], dtype=np.int64).reshape(-1, 2)
    character = np.arange(size, base, dtype=np.int32)
    for text, number in ids.items():
        if len(text) == 1:
            character[ord(text)] = number
    used = sorted({c for t in ids for c in t})
    alphabet = np.zeros(_POINTS, dtype=np.int32)
    alphabet[[ord(c) for c in used]] = np.arange(1, len(used) + 1)
    neighbours = np.zeros((len(used) + 1, len(used) + 1), dtype=bool)
    for text in ids:
        own = alphabet[[ord(c) for c in text]]
        neighbours[own[:-1], own[1:]] = True
    byte_id = np.zeros(256, dtype=np.int64)
    id_bytes, strips = [b""] * size, np.zeros(size, dtype=np.int8)
    for i, (text, _, kind) in enumerate(pieces):
        if kind == BYTE:
            value = int(text[3:5], 16)
            byte_id[value], id_bytes[i] = i, bytes([value])
        elif kind == CONTROL:
            strips[i] = 2
        elif kind == UNKNOWN:
            id_bytes[i] = UNKNOWN_TEXT.encode()
        else:
            id_bytes[i], strips[i] = text.replace(SPACE, " ").encode(), text.startswith(SPACE)
    return Model(
        size,
        keys,
        found[:, 0],
        found[:, 1],
        base,
        touchy,
        character,
        alphabet,
        neighbours,
        not any(SPACE in t.lstrip(SPACE) for t in ids),
        byte_id,
        id_bytes,
        strips,
    )


def _pairs(model: Model, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rank and piece of pairs of symbols; ``NO_RANK`` where they make no piece."""
    keys = left * model.base + right
    at = np.minimum(np.searchsorted(model.pair_keys, keys), len(model.pair_keys) - 1)
    return np.where(model.pair_keys[at] == keys, model.pair_rank[at], NO_RANK), model.pair_id[at]


def _in_order(symbols: list[int], model: Model, table: dict[int, tuple[int, int]]) -> tuple[list[int], list[int]]:
    """One word merged one pair at a time, lowest rank first, then leftmost: symbols and their first places."""
    if not table:
        table.update(zip(model.pair_keys.tolist(), zip(model.pair_rank.tolist(), model.pair_id.tolist())))
    after = list(range(1, len(symbols) + 1))
    before = list(range(-1, len(symbols) - 1))
    queue = []

    def offer(left: int, right: int) -> None:
        if left >= 0 and right < len(symbols):
            found = table.get(symbols[left] * model.base + symbols[right])
            if found:
                queue.append((found[0], left, right, symbols[left], symbols[right], found[1]))

    for i in range(len(symbols) - 1):
        offer(i, i + 1)
    heapq.heapify(queue)
    while queue:
        _, left, right, was_left, was_right, piece = heapq.heappop(queue)
        if symbols[left] != was_left or symbols[right] != was_right or after[left] != right:
            continue
        symbols[left], symbols[right] = piece, -1
        after[left] = after[right]
        if after[left] < len(symbols):
            before[after[left]] = left
        fresh, queue_size = (before[left], left), len(queue)
        offer(*fresh)
        offer(left, after[left])
        added = queue[queue_size:]
        del queue[queue_size:]
        for item in added:
            heapq.heappush(queue, item)
    places = [i for i, s in enumerate(symbols) if s >= 0]
    return [symbols[i] for i in places], places


def _first_only(word: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Which places of each word come no later than its first stop."""
    stops = np.cumsum(stop)
    start = np.r_[True, word[1:] != word[:-1]]
    sizes = np.diff(np.r_[np.flatnonzero(start), len(word)])
    earlier = stops - stop  # stops before this place, over all words
    return earlier == np.repeat(earlier[start], sizes)


def merge_rounds(words: list[str], model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words in one flat array, and where each word starts (one more for the end)."""
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    points = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32)
    if not len(points):
        return np.zeros(0, dtype=np.int64), np.zeros(len(words) + 1, dtype=np.int64)
    owner = np.repeat(np.arange(len(words)), lengths)
    symbol = model.character[points].astype(np.int64)
    letter = model.alphabet[points]
    joined = model.neighbours[letter[:-1], letter[1:]] & (owner[1:] == owner[:-1])
    word = np.r_[0, np.cumsum(~joined)]
    place = np.arange(len(points))
    rank = np.full(len(symbol), NO_RANK)  # of the pair that begins at each place
    piece = np.zeros(len(symbol), dtype=np.int64)
    changed = np.flatnonzero(joined)
    done_place, done_symbol = [], []
    rounds, table = 0, {}
    while len(symbol):
        changed = changed[(changed >= 0) & (changed < len(symbol) - 1)]
        inside = changed[word[changed] == word[changed + 1]]
        rank[changed] = NO_RANK
        rank[inside], piece[inside] = _pairs(model, symbol[inside], symbol[inside + 1])
        starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        sizes = np.diff(np.r_[starts, len(word)])
        lowest = np.repeat(np.minimum.reduceat(rank, starts), sizes)
        finished = lowest == NO_RANK
        if finished.any():
            done_place.append(place[finished])
            done_symbol.append(symbol[finished])
            rest = ~finished
            word, symbol, rank, piece, place, lowest = (x[rest] for x in (word, symbol, rank, piece, place, lowest))
            if not len(symbol):
                break
        if rounds == MOST_ROUNDS:
            for own, first in zip(np.split(symbol, ends := np.flatnonzero(np.diff(word)) + 1), np.split(place, ends)):
                last, kept = _in_order(own.tolist(), model, table)
                done_symbol.append(np.array(last, dtype=np.int64))
                done_place.append(first[kept])
            break
        rounds += 1
        merge = np.flatnonzero(rank == lowest)
        # places side by side overlap: of a run of them every second one merges, from the left
        run = np.flatnonzero(np.r_[True, np.diff(merge) != 1])
        offset = np.arange(len(merge)) - np.repeat(run, np.diff(np.r_[run, len(merge)]))
        merge = merge[offset % 2 == 0]
        new = piece[merge]
        if model.touchy[new].any():
            best = rank[merge]
            edge = np.r_[-1, word, -1]  # shifted by one
            left = symbol[np.maximum(merge - 1, 0)].copy()
            follows = np.flatnonzero(np.diff(merge) == 2) + 1
            left[follows] = new[follows - 1]  # just merged by then
            right = symbol[np.minimum(merge + 2, len(symbol) - 1)]
            with_left = (edge[merge] == word[merge]) & (_pairs(model, left, new)[0] <= best)
            beyond = edge[np.minimum(merge + 3, len(edge) - 1)]
            with_right = (beyond == word[merge]) & (_pairs(model, new, right)[0] <= best)
            stop = model.touchy[new] & (with_left | with_right)
            if stop.any():
                merge = merge[_first_only(word[merge], stop)]
        symbol[merge] = piece[merge]
        keep = np.ones(len(symbol), dtype=bool)
        keep[merge + 1] = False
        rank[merge] = NO_RANK  # also where a merged pair is the last of all
        word, symbol, rank, piece, place = word[keep], symbol[keep], rank[keep], piece[keep], place[keep]
        merged = merge - np.arange(len(merge))  # one symbol less for each merge before
        changed = np.unique(np.r_[merged - 1, merged])
    all_place, all_symbol = np.concatenate(done_place), np.concatenate(done_symbol)
    order = np.argsort(all_place)
    return _with_bytes(all_symbol[order], owner[all_place[order]], len(words), model)


def _with_bytes(symbol: np.ndarray, owner: np.ndarray, words: int, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Characters without a piece replaced by the ids of their bytes."""
    strange = np.flatnonzero(symbol >= model.size)
    if len(strange):
        encoded = [chr(p).encode() for p in (symbol[strange] - model.size).tolist()]
        size = np.ones(len(symbol), dtype=np.int64)
        size[strange] = [len(b) for b in encoded]
        is_byte = np.zeros(len(symbol), dtype=bool)
        is_byte[strange] = True
        symbol, owner, is_byte = np.repeat(symbol, size), np.repeat(owner, size), np.repeat(is_byte, size)
        symbol[is_byte] = model.byte_id[np.frombuffer(b"".join(encoded), dtype=np.uint8)]
    return symbol, np.r_[0, np.cumsum(np.bincount(owner, minlength=words))]


def _windows(text: str) -> Iterator[str]:
    """A text with its leading space mark, in stretches that each begin with a space mark."""
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

    def __init__(self, model: Model):
        self.model = model
        self._forget()

    def _forget(self) -> None:
        self.index: dict[str, int] = {}
        self.chars = 0
        self.flat = np.zeros(0, dtype=np.int32)
        self.starts = np.zeros(0, dtype=np.int64)
        self.length = np.zeros(0, dtype=np.int64)

    def _segments(self, text: str) -> list[str]:
        """Words of a text in order, each without the space mark it begins with."""
        if not text:
            return []
        if not self.model.spaces_lead:
            return [text.replace(" ", SPACE)]
        found: list[str] = []
        for window in _windows(SPACE + text):
            marked = window.replace(" ", SPACE)
            if SPACE * 2 in marked:
                found += [w[1:] for w in _WORD.findall(marked)]
            else:
                found += marked.split(SPACE)[1:]
        return found

    def _learn(self, words: list[str]) -> None:
        fresh = [w for w in dict.fromkeys(words) if w not in self.index]
        flat, starts = merge_rounds([SPACE + w for w in fresh], self.model)
        self.index.update(zip(fresh, range(len(self.index), len(self.index) + len(fresh))))
        self.chars += sum(map(len, fresh))
        self.length = np.r_[self.length, np.diff(starts)]
        self.starts = np.r_[self.starts, starts[:-1] + len(self.flat)]
        self.flat = np.r_[self.flat, flat.astype(np.int32)]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of some texts and the offsets of each text in them."""
        words: list[str] = []
        ends = [0]
        for text in texts:
            words += self._segments(text)
            ends.append(len(words))
        if len(self.index) > MOST_WORDS or self.chars > MOST_CHARS:
            self._forget()
        self._learn(words)
        used = np.fromiter(map(self.index.__getitem__, words), dtype=np.int64, count=len(words))
        ids, before = gather(self.flat, self.starts, self.length, used)
        return ids, before[np.array(ends)]


def _each_byte(error: UnicodeDecodeError) -> tuple[str, int]:
    return "�" * (error.end - error.start), error.end


class Decoder:
    """Decodes batches of id arrays."""

    def __init__(self, id_bytes: list[bytes], strips: np.ndarray):
        codecs.register_error("each_byte", _each_byte)
        self.flat = np.frombuffer(b"".join(id_bytes), dtype=np.uint8)
        self.length = np.array([len(b) for b in id_bytes], dtype=np.int64)
        self.starts = np.r_[0, np.cumsum(self.length)[:-1]]
        self.strips = strips

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
        content, before = gather(self.flat, self.starts, self.length, ids)
        kind = self.strips[ids]
        texts, raw = [], content.tobytes()
        for start, end in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
            first = start
            while first < end and kind[first] == 2:
                first += 1
            space = 1 if first < end and kind[first] == 1 else 0
            # bytes on both sides of a control id make no character together
            cuts = [before[first] + space, *before[first + np.flatnonzero(kind[first:end] == 2)].tolist(), before[end]]
            texts.append("".join(raw[a:b].decode("utf-8", "each_byte") for a, b in zip(cuts[:-1], cuts[1:])))
        return texts


def encode(df: DataFrame, model_path: str, text: str = "text", output: str = "ids") -> DataFrame:
    """Adds the token ids of every whole text; the model file is read by the driver only."""
    shared = df.sparkSession.sparkContext.broadcast(load_model(model_path))

    @F.arrow_udf("array<int>")
    def encoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = Encoder(shared.value)
        for part in in_groups(batches, pc.binary_length, WINDOW_CHARS):
            ids, offsets = encoder.encode([x or "" for x in part.to_pylist()])
            yield pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids))

    return df.withColumn(output, encoded(F.col(text)))


def decode(df: DataFrame, model_path: str, ids: str = "ids", output: str = "decoded") -> DataFrame:
    """Adds the text of an array of ids."""
    model = load_model(model_path)
    shared = df.sparkSession.sparkContext.broadcast((model.id_bytes, model.strips))

    @F.arrow_udf("string")
    def decoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        decoder = Decoder(*shared.value)
        for part in in_groups(batches, pc.list_value_length, WINDOW_IDS):
            sizes = pc.fill_null(pc.list_value_length(part), 0).to_pylist()
            ids = part.flatten().to_numpy(zero_copy_only=False)
            yield pa.array(decoder.decode(ids, np.r_[0, np.cumsum(sizes)]), pa.string())

    return df.withColumn(output, decoded(F.col(ids)))
