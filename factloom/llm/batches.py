"""Arrow batches in slices that bound the memory of a Python worker, however long the texts."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def slices_of(batch: pa.RecordBatch, column: int, most: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """Cuts a batch into slices with about ``most`` bytes of text in a column."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    cut = np.cumsum(sizes) // most
    at = [0, *(np.flatnonzero(np.diff(cut)) + 1).tolist(), batch.num_rows]
    for lo, hi in zip(at, at[1:], strict=False):
        if lo < hi:
            yield batch.slice(lo, hi - lo)


def give_back() -> None:
    """Return freed memory to the system: idle workers live on beside busy ones, and what they hold counts."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


def trimmed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A partition function that gives back its memory when the partition ends."""

    @wraps(run)
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return go
