"""Columns of vectors as matrices, for the operators on embeddings."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Rows of a matrix that is worked on at once, so that memory does not follow the input.
ROWS = 4_096


def whole(column: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and values of the vectors with exactly ``dims`` components, none of them null or non-finite."""
    rows = np.flatnonzero(pc.equal(pc.list_value_length(column).fill_null(-1), dims).to_numpy(zero_copy_only=False))
    flat = column.take(pa.array(rows)).flatten().cast(pa.float64()) if dims else pa.array([], pa.float64())
    values = flat.to_numpy(zero_copy_only=False).reshape(-1, dims)
    finite = np.isfinite(values).all(axis=1)  # a null is a NaN here
    return rows[finite], values[finite]


def integers(values: np.ndarray, scale: int, limit: int) -> np.ndarray:
    """floor(scale * value); a number of ``limit`` or more in size is an error, as exact sums would not fit a long."""
    scaled = np.floor(values * scale)
    if scaled.size and np.abs(scaled).max() >= limit:
        raise ValueError(f"a vector's component is {limit // scale} or more in size")
    return scaled.astype(np.int64)


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """A column of integer lists of one length as a matrix of longs."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims).astype(np.int64)


def lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    """The rows of a matrix as a column of lists."""
    ends = np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.ascontiguousarray(values).reshape(-1), kind))


def slices(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows, ``ROWS`` at most at a time."""
    for batch in rows:
        for start in range(0, batch.num_rows, ROWS):
            yield batch.slice(start, ROWS)
