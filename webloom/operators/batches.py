"""Bounded pieces of Arrow batches for the Python stages."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc

_ROWS = 512
#: Parsed nodes take about twenty times the text of their pages, so this sets what a worker holds beside its input.
_BYTES = 1 << 19


def pieces(batches: Iterator[pa.RecordBatch], text_column: int) -> Iterator[pa.RecordBatch]:
    """Slices of at most 512 rows and, unless one row is larger, 512 KB of text, so output stays small whatever the
    size of a page."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text_column)), 0).to_pylist()
        start, held = 0, 0
        for row, size in enumerate(sizes):
            if row > start and (row - start >= _ROWS or held + size > _BYTES):
                yield batch.slice(start, row - start)
                start, held = row, 0
            held += size
        if start < len(sizes):
            yield batch.slice(start)
