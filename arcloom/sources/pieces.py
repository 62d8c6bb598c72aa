"""Bounded pieces of Arrow batches inside tasks: Python objects are made for one piece at a time."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc

PIECE_BYTES = 256 << 10
PIECE_ROWS = 256


def pieces(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int = PIECE_BYTES,
           max_rows: int = PIECE_ROWS) -> Iterator[pa.RecordBatch]:
    """Row ranges in order whose values of ``column`` have ``max_bytes`` together; only a single row may have more."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        start = held = 0
        for at, size in enumerate(sizes):
            if at > start and (held + size > max_bytes or at - start >= max_rows):
                yield batch.slice(start, at - start)
                start, held = at, 0
            held += size
        if start < batch.num_rows:
            yield batch.slice(start)
        del batch
        # a process may wait long for its next task: what the batch took besides itself goes back
        pa.default_memory_pool().release_unused()
