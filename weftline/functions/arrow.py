"""Strings of an Arrow batch as bytes and offsets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def utf8(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all strings in a row, and the offsets of each; nulls are empty."""
    data = pc.fill_null(strings, "").cast(pa.large_binary())
    _, offsets, values = data.buffers()
    off = np.frombuffer(offsets, np.int64)[data.offset : data.offset + len(data) + 1] if len(data) else np.zeros(1, np.int64)
    raw = np.frombuffer(values, np.uint8)[off[0] : off[-1]] if values is not None else np.zeros(0, np.uint8)
    return raw, off - off[0]


def slices(strings: pa.Array, limit: int = 4 << 20) -> Iterator[pa.Array]:
    """The strings in runs of about ``limit`` bytes, or a single one."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(strings), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(strings):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + limit, side="right")))
        yield strings.slice(start, stop - start)
        start = stop


def sliced(batch: pa.RecordBatch, column: str, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The rows in runs with about ``limit`` bytes of a column's strings, or a single one: what is made of a run is sent before the next is begun."""
    at = 0
    for some in slices(batch.column(column), limit):
        yield batch.slice(at, len(some))
        at += len(some)
