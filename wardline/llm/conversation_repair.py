"""Repair of conversation structure by cheapest edits, with square-root checkpointed programming.

Rows of a conversation are taken by turn, then role, then text (null turns first). A row is
blank (no character other than white space), else duplicate (role and text stood earlier),
else truncated (its last such character is none of ``.!?``), else sound. Edits, by cost:

* Keep 0; Rerole to user or assistant 2; both 1 more for a truncated row, and neither for
  a blank or duplicate one;
* Delete 3;
* Insert an empty user or assistant row anywhere 2.

The initials of the roles must come to ``(s?(ua)+)?``: an automaton of four states. A
backward pass gives the least cost to go from each state; of its vectors only those at
every square root of the number of rows are stored. The forward walk recomputes one such
block after the other and takes, of the tight edits, the one whose initial is least in
ASCII, so the audit is the least of all cheapest ones.

Rows are dealt by ranges of conversation, turn, role and the text's beginning, so that no
task holds a whole conversation of any size. Conversations inside one range are repaired
where they are. Of the others each piece gives a table of costs between states; the tables
are combined backwards into a vector at every piece's end, and one walk over the pieces
streams edits and digest. Texts seen in an earlier piece reach a piece as digests.

Defined results: null ids form one conversation; null roles and texts are one space; null
turns count in no gap; rows that are equal in turn, role and text follow each other. A row
may stand several times or not at all (``copies``); a conversation of which no row stands
has zeros, an empty audit and the digest of nothing. Only the four columns and ``copies``
are read. An empty table gives no rows. Long texts are handled whole.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator, Sequence
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardline.plans.stages import Stages

PIECE_ROWS = 20_000
PIECE_CHARS = 4_000_000
PREFIX_CHARS = 32

SOUND, BLANK, DUPLICATE, TRUNCATED = range(4)
LEGAL = {"su", "ua", "au"}
_MARK = re.compile(r"[^\x20\x09-\x0D]")
_WHITE = " \t\n\v\f\r"
FAR = 1 << 60

#: States of the automaton: nothing yet, after system, after user, after assistant.
_NEXT = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
_TURN = {0: 2, 1: 2, 2: 3, 3: 2}  # state after an inserted or re-roled row
_ROLE = {2: "user", 3: "assistant"}


def _options(initial: str, fault: int) -> list[list[tuple[str, int, int]]]:
    """Per state the edits of one row, in the order of their initials: letter, cost, next state."""
    more = 1 if fault == TRUNCATED else 0
    options = []
    for state in range(4):
        own = [("D", 3, state)]
        if fault not in (BLANK, DUPLICATE):
            kept = _NEXT.get(initial, {}).get(state)
            own += [("K", more, kept)] if kept is not None else []
            own.append(("R", 2 + more, _TURN[state]))
        options.append(own)
    return options


_EDITS = {(i, f): _options(i, f) for i in "sua?" for f in range(4)}


def _kinds(roles: Sequence[str], faults: Sequence[int]) -> list:
    return [_EDITS[r[:1] if r[:1] in _NEXT else "?", f] for r, f in zip(roles, faults)]


def _with_inserts(v: Sequence[int]) -> tuple[int, ...]:
    after_user, after_assistant = min(v[2], 2 + v[3]), min(v[3], 2 + v[2])
    return min(v[0], 2 + after_user), min(v[1], 2 + after_user), after_user, after_assistant


#: Cost to go at the end of a conversation.
END = _with_inserts((0, FAR, FAR, 0))


def _before(row: list, v: Sequence[int]) -> tuple[int, ...]:
    """Cost to go before a row, from that after it."""
    return _with_inserts([min(cost + v[to] for _, cost, to in own) for own in row])


def _checkpoints(rows: list, end: Sequence[int]) -> tuple[int, list[tuple[int, ...]]]:
    """Block length, and the vectors before each block and at the end."""
    size = math.isqrt(max(len(rows) - 1, 0)) + 1
    kept, v = [tuple(end)], tuple(end)
    for i in range(len(rows) - 1, -1, -1):
        v = _before(rows[i], v)
        if i % size == 0:
            kept.append(v)
    return size, kept[::-1]


def costs_between(rows: list) -> list[int]:
    """Least cost from each state before some rows to each state after them, row by row of a 4 x 4 table."""
    columns = []
    for state in range(4):
        v = tuple(0 if s == state else FAR for s in range(4))
        for row in reversed(rows):
            v = _before(row, v)
        columns.append(v)
    return [columns[to][start] for start in range(4) for to in range(4)]


def walk(rows: list, end: Sequence[int], state: int, last: bool) -> tuple[list[tuple[str, int, int]], int, int]:
    """Tight edits from a state: letter, row (-1: inserted), state after it; the final state; the cost to go.

    Rows inserted behind the last row belong to the walk of the last piece only.
    """
    size, kept = _checkpoints(rows, end)
    edits, cost = [], kept[0][state]

    def insert_if_tight(v: Sequence[int]) -> bool:
        nonlocal state
        if 2 + v[_TURN[state]] != v[state]:
            return False
        state = _TURN[state]
        edits.append(("I", -1, state))
        return True

    for block, start in enumerate(range(0, len(rows), size)):
        stop = min(start + size, len(rows))
        vectors = [kept[block + 1]]
        for i in range(stop - 1, start - 1, -1):
            vectors.append(_before(rows[i], vectors[-1]))
        vectors.reverse()
        for i in range(start, stop):
            v, after = vectors[i - start], vectors[i - start + 1]
            while True:
                tight = [(letter, to) for letter, cost, to in rows[i][state] if cost + after[to] == v[state]]
                if tight and tight[0][0] == "D" or not insert_if_tight(v):
                    letter, state = tight[0]
                    edits.append((letter, i, state))
                    break
    while last and end[state]:
        insert_if_tight(end)
    return edits, state, cost


def faults_of(roles: Sequence[str], texts: Sequence[str], seen: set, key=lambda role, text: (role, text)) -> list[int]:
    """First fault of each row; ``seen`` holds the keys of earlier rows and gets those of these."""
    faults = []
    for role, text in zip(roles, texts):
        own = key(role, text)
        if not _MARK.search(text):
            faults.append(BLANK)
        elif own in seen:
            faults.append(DUPLICATE)
        else:
            faults.append(SOUND if text.rstrip(_WHITE)[-1] in ".!?" else TRUNCATED)
        seen.add(own)
    return faults


def digest(role: str, text: str) -> bytes:
    return hashlib.blake2b(f"{len(role)}:{role}{text}".encode(), digest_size=16).digest()


class Repair:
    """The running result of one conversation."""

    def __init__(self) -> None:
        self.state, self.cost, self.audit, self.sha, self.lines = 0, None, [], hashlib.sha256(), 0
        self.count = [0, 0, 0, 0]
        self.illegal, self.initial = 0, None
        self.lowest = self.highest = None
        self.turns = 0

    def add(self, turns, roles, texts, faults, end: Sequence[int], last: bool) -> None:
        rows = _kinds(roles, faults)
        edits, self.state, cost = walk(rows, end, self.state, last)
        if rows and self.cost is None:
            self.cost = cost
        self.audit.append("".join(letter for letter, _, _ in edits))
        for letter, row, state in edits:
            if letter != "D":
                role = roles[row] if letter == "K" else _ROLE[state]
                self.sha.update((("\n" if self.lines else "") + f"{role}:{texts[row] if row >= 0 else ''}").encode())
                self.lines += 1
        for turn, role, fault in zip(turns, roles, faults):
            self.count[fault] += 1
            if self.initial is not None and self.initial + role[:1] not in LEGAL:
                self.illegal += 1
            self.initial = role[:1]
            if turn is not None:
                self.turns += turn != self.highest
                self.lowest = turn if self.lowest is None else self.lowest
                self.highest = turn

    def row(self) -> tuple:
        gaps = self.highest - self.lowest + 1 - self.turns if self.turns else 0
        return (
            gaps, self.count[BLANK], self.count[DUPLICATE], self.count[TRUNCATED], self.illegal,
            self.cost or 0, "".join(self.audit), self.sha.hexdigest(),
        )


_RESULT = [
    *[(name, T.LongType()) for name in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
    ("audit", T.StringType()),
    ("repaired_sha256", T.StringType()),
]
_PIECE = [
    ("piece", T.LongType()),
    ("turns", T.ArrayType(T.LongType())),
    ("roles", T.ArrayType(T.StringType())),
    ("texts", T.ArrayType(T.StringType())),
    ("digests", T.ArrayType(T.BinaryType())),
]
_ARROW = [
    *[pa.int64()] * 6, pa.string(), pa.string(),
    pa.int64(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.string()), pa.list_(pa.binary()),
]


def _batch(rows: list[tuple], id_type: pa.DataType, kinds: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [id_type, *kinds])], names=names)


def _first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Results of conversations inside a range; pieces of those at its ends and of very long ones."""
    number = TaskContext.get().partitionId() << 32
    names = ["conv_id", *[n for n, _ in _RESULT], *[n for n, _ in _PIECE]]
    conv, held, chars, open_, id_type = None, [], 0, True, None
    out: list[tuple] = []

    def flush(more: bool) -> None:
        """Hand over the held rows; ``more`` if the conversation may go on after them."""
        nonlocal held, chars, number
        turns, roles, texts = (list(c) for c in zip(*held)) if held else ([], [], [])
        if open_ or more:
            keys = list(dict.fromkeys(map(digest, roles, texts)))
            out.append((conv, *[None] * len(_RESULT), number, turns, roles, texts, keys))
            number += 1
        else:
            repair = Repair()
            repair.add(turns, roles, texts, faults_of(roles, texts, set()), END, last=True)
            out.append((conv, *repair.row(), *[None] * len(_PIECE)))
        held, chars = [], 0

    begun = False
    for batch in batches:
        id_type = batch.column(0).type
        ids, turns, roles, texts, copies = (c.to_pylist() for c in batch.columns)
        for own, turn, role, text, times in zip(ids, turns, roles, texts, copies):
            if begun and own != conv:
                flush(more=False)
                open_ = False
            conv, begun = own, True
            for _ in range(times):
                if len(held) >= PIECE_ROWS or chars >= PIECE_CHARS:
                    flush(more=True)
                    open_ = True
                held.append((turn, role, text))
                chars += len(text)
        yield _batch(out, id_type, _ARROW, names)
        out.clear()
    if begun:
        flush(more=True)
        yield _batch(out, id_type, _ARROW, names)


def _faults_in_piece(row: dict) -> list[int]:
    return faults_of(row["roles"], row["texts"], set(row["seen"] or ()), digest)


def _costs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            table = costs_between(_kinds(row["roles"], _faults_in_piece(row)))
            arrays = [[row["conv_key"]], [row["piece"]], [table]]
            yield pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], names=["conv_key", "piece", "table"])


def _ends(pieces: pa.Table) -> pa.Table:
    """Cost to go at the end of each piece of a conversation: a few numbers for each of its pieces."""
    rows, end, found = sorted(zip(pieces["piece"].to_pylist(), pieces["table"].to_pylist()), reverse=True), END, []
    for place, (piece, table) in enumerate(rows):
        found.append((piece, list(end), place == 0))
        end = [min(table[4 * s + e] + end[e] for e in range(4)) for s in range(4)]
    columns = list(zip(*found))
    return pa.table([pa.array(columns[0]), pa.array(columns[1]), pa.array(columns[2])], ["of_piece", "end", "last"])


def _last_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One walk over the ordered pieces of each conversation."""
    names = ["conv_id", *[n for n, _ in _RESULT]]

    def pieces() -> Iterator[dict]:
        for batch in batches:
            for row in range(batch.num_rows):
                yield batch.slice(row, 1).to_pylist()[0] | {"id_type": batch.schema.field("conv_id").type}

    for _, own in groupby(pieces(), key=lambda row: row["conv_key"]):
        repair = Repair()
        for row in own:
            repair.add(row["turns"], row["roles"], row["texts"], _faults_in_piece(row), row["end"], row["last"])
        yield _batch([(row["conv_id"], *repair.row())], row["id_type"], _ARROW[: len(_RESULT)], names)


def repair(rows: DataFrame, copies: Column | None = None) -> DataFrame:
    """One row per ``conv_id`` of ``conv_id, turn, role, text`` rows.

    Columns: ``gaps, blank, duplicate, truncated, illegal, cost`` (long), ``audit`` and
    ``repaired_sha256``. ``copies`` is how often a row stands, 1 if left out.
    """
    stages = Stages(rows.sparkSession, "repair")
    space = F.lit(" ")
    plain = rows.select(
        "conv_id",
        F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", space).alias("role"),
        F.coalesce("text", space).alias("text"),
        (F.lit(1) if copies is None else copies.cast("int")).alias("copies"),
    )
    # the row's number parts equal rows of one turn, however many there are
    order = ["conv_id", "turn", "role"]
    dealt = plain.repartitionByRange(*order, F.substring("text", 1, PREFIX_CHARS), F.monotonically_increasing_id())
    id_field = T.StructField("conv_id", rows.schema["conv_id"].dataType)
    first = T.StructType([id_field, *[T.StructField(*f) for f in [*_RESULT, *_PIECE]]])
    found = stages.write(dealt.sortWithinPartitions(*order, "text").mapInArrow(_first_pass, first))
    names = ["conv_id", *[n for n, _ in _RESULT]]
    whole = found.where(F.col("piece").isNull()).select(names)

    key = F.when(F.col("conv_id").isNull(), "").otherwise(F.concat(F.lit("="), F.col("conv_id").cast("string")))
    pieces = found.where(F.col("piece").isNotNull()).select("conv_id", key.alias("conv_key"), *[n for n, _ in _PIECE])
    held = pieces.select("conv_key", "piece", F.explode("digests").alias("digest"))
    first_at = held.groupBy("conv_key", "digest").agg(F.min("piece").alias("first"), F.count(F.lit(1)).alias("n"))
    later = held.join(first_at.where("n > 1"), ["conv_key", "digest"]).where("piece > first")
    seen = later.groupBy(F.col("piece").alias("of_piece")).agg(F.collect_list("digest").alias("seen"))
    known = pieces.drop("digests").join(seen, F.col("piece") == F.col("of_piece"), "left").drop("of_piece")
    known = stages.write(known)
    tables = known.select("conv_key", "piece", "roles", "texts", "seen").mapInArrow(
        _costs, "conv_key string, piece long, table array<long>"
    )
    ends = tables.groupBy("conv_key").applyInArrow(_ends, "of_piece long, end array<long>, last boolean")
    walked = known.join(ends, F.col("piece") == F.col("of_piece")).drop("of_piece")
    walked = walked.repartition("conv_key").sortWithinPartitions("conv_key", "piece")
    result = T.StructType([id_field, *[T.StructField(*f) for f in _RESULT]])
    return whole.unionByName(walked.mapInArrow(_last_pass, result))


def damaged(rows: DataFrame) -> tuple[DataFrame, Column]:
    """Rows with planted faults by a hash of ``conv_id:turn``, and how often each stands.

    Of 20 values 0 drops a row, 1 empties its text, 2 takes out ``.!?``, 3 repeats it,
    4 makes its role user. Nulls are one space.
    """
    space = F.lit(" ")
    text = F.coalesce("text", space)
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), space) for c in ("conv_id", "turn")])
    slot = F.pmod(F.crc32(key.cast("binary")), F.lit(20))
    changed = rows.select(
        "conv_id",
        "turn",
        F.when(slot == 4, "user").otherwise(F.coalesce("role", space)).alias("role"),
        F.when(slot == 1, "").when(slot == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.when(slot == 0, 0).when(slot == 3, 2).otherwise(1).alias("copies"),
    )
    return changed, F.col("copies")
