"""Encoders and decoders let go of a slice of a batch at once."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
import pytest

from wardline.llm import bpe, sketch_dedup, textops


def test_batches_leave_in_slices_of_bounded_size():
    texts = ["ab" * 20, None, "", "c" * 30, "d" * 200, "e"] * 50
    batches = [pa.array(texts[:100], pa.string()), pa.array([], pa.string()), pa.array(texts[100:], pa.string())]
    parts = list(bpe.in_groups(iter(batches), pc.binary_length, 100))
    assert [t for p in parts for t in p.to_pylist()] == texts
    assert len(parts) > 100 and all(pc.sum(pc.binary_length(p)).as_py() <= 100 or len(p) <= 3 for p in parts)


@pytest.mark.parametrize("parts_of", [sketch_dedup.signed_parts, sketch_dedup.set_parts])
def test_sets_and_sketches_leave_block_by_block(parts_of, monkeypatch):
    texts = ["one two three four five six", None, "", "seven eight", "one two three four five six"] * 100
    whole = [r for p in parts_of(pa.array(texts), 3) for r in p.to_pylist()]
    monkeypatch.setattr(textops, "PIECE_BYTES", 200)
    parts = list(parts_of(pa.array(texts), 3))
    assert len(whole) == len(texts) and [r for p in parts for r in p.to_pylist()] == whole
    assert len(parts) > 20 and whole[0] == whole[4] != whole[3] and whole[1]["node"] is None
