"""Groups of a sorted stream of Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def _joined(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    return held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.RecordBatch, int, int]]:
    """(batch, from, to) of each group in a stream that is sorted by the keys; an open group's batches are joined once."""
    held: list[pa.RecordBatch] = []
    last: list = []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        edges = [0, *(np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1).tolist()]
        if held and last != [c[0] for c in columns]:
            whole = _joined(held)
            yield whole, 0, whole.num_rows
            held = []
        last = [c[-1] for c in columns]
        if len(edges) == 1:
            held.append(batch)
            continue
        if held:
            whole = _joined([*held, batch.slice(0, edges[1])])
            yield whole, 0, whole.num_rows
            edges = edges[1:]
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            yield batch, lo, hi
        held = [batch.slice(edges[-1])]
    if held:
        whole = _joined(held)
        yield whole, 0, whole.num_rows
