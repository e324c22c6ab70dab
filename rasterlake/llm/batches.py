"""Arrow batches in bounded pieces, so that a worker's memory does not depend on how rows are dealt."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_ROWS = 400
SLICE_BYTES = 4 << 20


def slices(batches: Iterable[pa.RecordBatch], column: str = "text", rows: int = SLICE_ROWS, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Pieces of at most ``rows`` rows and ``size`` bytes of ``column``; a longer value is a piece of its own."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            before = int(ends[at - 1]) if at else 0
            until = min(at + rows, max(at + 1, int(np.searchsorted(ends, before + size, "right"))))
            yield batch.slice(at, until - at)
            at = until


def binaries(column: pa.Array, kind: str) -> list[np.ndarray | None]:
    """The values of a binary column as arrays of ``kind``, without copying them."""
    width, data = np.dtype(kind).itemsize, column.buffers()[2]
    offset = np.dtype(np.int64 if pa.types.is_large_binary(column.type) else np.int32)
    ends = np.frombuffer(column.buffers()[1], offset, len(column) + 1, offset.itemsize * column.offset).tolist()
    empty = np.empty(0, kind)
    known = column.is_valid().to_pylist()
    return [(np.frombuffer(data, kind, (b - a) // width, a) if b > a else empty) if ok else None for a, b, ok in zip(ends[:-1], ends[1:], known, strict=True)]
