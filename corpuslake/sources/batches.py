"""Arrow batches of bounded size: Spark bounds a batch by its rows, whose texts or files may be large."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of texts or files, and list items, that a task holds as Python objects at a time, about.
BATCH_BYTES, BATCH_ITEMS = 4 << 20, 1 << 20


def cuts(column: pa.Array, limit: int) -> Iterator[tuple[int, int]]:
    """(start, end) of parts of a column with about ``limit`` bytes, or list items; a longer value stands alone."""
    lengths = pc.list_value_length(column) if pa.types.is_list(column.type) else pc.binary_length(column)
    size = np.cumsum(pc.fill_null(lengths, 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(column):
        end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + limit, "right")))
        yield at, end
        at = end


def bounded(batches: Iterable[pa.RecordBatch], column: int, limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches by ``cuts`` of a column."""
    for b in batches:
        for at, end in cuts(b.column(column), limit):
            yield b.slice(at, end - at)


def gathered(rows: Iterable[tuple], schema: pa.Schema, size, limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Rows as batches of about ``limit`` bytes, ``size`` being those of a row."""
    made = lambda held: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
    held, n = [], 0
    for r in rows:
        held.append(r)
        n += size(r)
        if n >= limit:
            yield made(held)
            held, n = [], 0
    if held:
        yield made(held)
