"""Arrow batches in pieces of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc


def pieces(batch: pa.RecordBatch, column: int, most_bytes: int = 4_000_000, most_rows: int = 1_000) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of at most so many rows and bytes of one text column; a text beyond that is a slice of its own, whole."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    begin = 0
    while begin < batch.num_rows:
        end, room = begin, most_bytes
        while end < batch.num_rows and end - begin < most_rows and (end == begin or sizes[end] <= room):
            room -= sizes[end]
            end += 1
        yield batch.slice(begin, end - begin)
        begin = end
