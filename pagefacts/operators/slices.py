"""Batches of a Python function in slices of bounded size."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: A slice of a batch holds about this many bytes of text, which bounds a worker's memory.
SLICE_BYTES = 3_000_000


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches into runs of rows with about ``limit`` bytes of ``column``; one row at least."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes, dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(at, to - at)
            at = to
            pa.default_memory_pool().release_unused()


def give_back() -> None:
    """Returns freed memory to the system, so that a worker that did a large piece of work is small for its next tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # no glibc
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def by_slices(column: str, fields: dict[str, pa.DataType], rows: Callable[..., Iterator[tuple]], *columns: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow: ``rows`` of the values of ``columns``, one input row at a time, as rows of ``fields``. What
    a worker holds besides Spark's batch is a slice of it by ``column`` and what comes of that."""
    schema = pa.schema(list(fields.items()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, column):
            found = [x for row in zip(*(part.column(c).to_pylist() for c in columns), strict=True) for x in rows(*row)]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], t) for i, t in enumerate(fields.values())], schema=schema)
            del found
        give_back()

    return run
