"""Arrow batch <-> numpy block helpers used inside tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def as_matrix(column: pa.Array) -> np.ndarray:
    """(n, d) view of a list<double> column whose rows share one length."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if n == 0:
        return flat.reshape(0, 0)
    if len(flat) % n or (len(flat) and not np.array_equal(
        np.diff(column.offsets.to_numpy()), np.full(n, len(flat) // n)
    )):
        raise ValueError("vectors must all have the same length and no nulls")
    return flat.reshape(n, len(flat) // n)


def as_lists(block: np.ndarray) -> pa.Array:
    """list<double> column of an (n, d) block."""
    n, d = block.shape
    offsets = pa.array(np.arange(n + 1, dtype=np.int32) * d)
    return pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(block).ravel()))


def squared_distances(block: np.ndarray, point: np.ndarray) -> np.ndarray:
    """Summed component after component, as a SQL left fold would."""
    total = np.zeros(block.shape[0])
    for j in range(block.shape[1]):
        diff = block[:, j] - point[j]
        total += diff * diff
    return total
