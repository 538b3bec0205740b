"""Small Arrow helpers shared by the vector operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def one_array(column: pa.ChunkedArray | pa.Array) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def matrix(column: pa.ChunkedArray | pa.Array, kind: type | None = np.float64) -> np.ndarray:
    """Equal-length list column to a [rows, dim] matrix, without Python objects; for no kind in the column's own, not copied."""
    column = one_array(column)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    flat = flat if kind is None else flat.astype(kind)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def ragged_arrow(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, pa.Array]:
    """List column to (row number of each entry, entries)."""
    column = one_array(column)
    lengths = np.diff(column.offsets.to_numpy(zero_copy_only=False))
    return np.repeat(np.arange(len(column)), lengths), column.flatten()


def ragged(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The same with NumPy entries."""
    rows, entries = ragged_arrow(column)
    return rows, entries.to_numpy(zero_copy_only=False)


def vector_column(rows: np.ndarray, kind: pa.DataType) -> pa.Array:
    """[rows, dim] matrix to a list column."""
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(rows.reshape(-1), kind))


def key_runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Cut rows sorted by `key` into one table per key value."""
    pending: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        if pending is not None:
            table = pa.concat_tables([pending, table])
        keys = table[key].to_numpy()
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        for start, end in zip(starts[:-1], starts[1:], strict=True):
            yield table.slice(start, end - start)
        pending = table.slice(starts[-1])
    if pending is not None:
        yield pending
