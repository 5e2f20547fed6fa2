"""What a worker holds while it hashes texts follows the bytes of a pass, not those of a batch."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from lodestone.llm import neardup, textvec


@pytest.fixture(scope="module")
def batch():
    """8 MB of text, as much as a worker gets at once."""
    g = np.random.default_rng(5)
    texts = [" ".join(map(str, g.integers(1000, 99_999, 6_000))) for _ in range(235)]
    keys = pa.array(range(len(texts)), pa.int64())
    return pa.RecordBatch.from_arrays([keys, keys, pa.array([None, *texts[1:]])], names=["doc_id", "text_key", "text"])


class _Frame:
    def select(self, *columns):
        return self


@pytest.fixture
def sketch(monkeypatch):
    """What ``sketches`` does with a stream of batches, without Spark."""
    monkeypatch.setattr(neardup, "arrow_map", lambda frame, work, schema: work)
    return neardup.sketches(_Frame())


def test_sketches_hold_a_pass(batch, sketch):
    for _ in sketch([batch.slice(0, 2)]):  # tables that stay
        pass
    tracemalloc.start()
    try:
        assert sum(out.num_rows for out in sketch([batch])) == batch.num_rows
        assert tracemalloc.get_traced_memory()[1] < 48 << 20
    finally:
        tracemalloc.stop()


def test_sketches_do_not_depend_on_passes(batch, sketch, monkeypatch):
    part = batch.slice(0, 40)
    whole = pa.Table.from_batches(list(sketch([part])))
    monkeypatch.setattr(neardup, "PASS_BYTES", 10_000)
    assert pa.Table.from_batches(list(sketch([part]))).combine_chunks().equals(whole.combine_chunks())


def test_power_tables_are_as_long_as_a_run(monkeypatch):
    monkeypatch.setattr(textvec, "_powers", (np.ones(1, np.uint64), np.ones(1, np.uint64)))
    text = "a " * (textvec.CHUNK // 2)
    assert len(textvec.word_hashes(pa.array([text]))[0]) == textvec.CHUNK // 2
    assert [len(p) for p in textvec._powers] == [textvec.CHUNK + 1] * 2
