"""Vectors of floating point numbers as vectors of whole numbers, for exact arithmetic."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Whole components from here on are refused: products of them fit no result column.
LIMIT = 1 << 53


def scaled(column: pa.Array, scale: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(rows, floor(scale * x))`` for the usable vectors of a list column, one length at a time.

    Null vectors and those with a null or non-finite component are left out. A component that
    reaches ``LIMIT`` after scaling is an error, since no exact result could hold it.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = np.where(column.is_valid().to_numpy(zero_copy_only=False), column.value_lengths().fill_null(0).to_numpy(), -1)
    for dim in np.unique(lengths[lengths >= 0]).tolist():
        rows = np.flatnonzero(lengths == dim)
        flat = column.take(pa.array(rows)).flatten()
        # a null component becomes NaN, and its vector falls out with the non-finite ones
        x = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), dim)
        good = np.isfinite(x).all(axis=1)
        rows, whole = rows[good], np.floor(x[good] * scale)
        if whole.size and np.abs(whole).max() >= LIMIT:
            raise ValueError(f"a vector component of {LIMIT} or more after scaling cannot be computed with exactly")
        if len(rows):
            yield rows, whole.astype(np.int64)


def lists(values: np.ndarray) -> pa.Array:
    """One list of 64-bit integers per row of a matrix."""
    offsets = np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.ravel().astype(np.int64)))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Inverse of :func:`lists` for rows of ``dim`` numbers."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim)


def exact(values: np.ndarray, limit: int) -> np.ndarray:
    """The same numbers, as Python integers where 64 bits might not do for what follows."""
    return values.astype(object) if values.size and np.abs(values).max() >= limit else values
