"""Small numpy helpers shared by the operators that work on Arrow batches inside tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def codes(*columns: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Dense codes of the rows' values in all columns together; nulls are a value."""
    out: np.ndarray | None = None
    for column in columns:
        array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        encoded = pc.dictionary_encode(array, null_encoding="encode")
        part = encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        if out is None:
            out = part
        else:
            out = np.unique(out * (len(encoded.dictionary) + 1) + part, return_inverse=True)[1].astype(np.int64)
    return out if out is not None else np.zeros(0, np.int64)


def longs(column: pa.ChunkedArray | pa.Array, null: int = 0) -> np.ndarray:
    """An integer or timestamp column as int64 (timestamps in microseconds), nulls as ``null``."""
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if pa.types.is_timestamp(array.type):
        array = array.cast(pa.timestamp("us", array.type.tz)).cast(pa.int64())
    return pc.fill_null(array.cast(pa.int64()), null).to_numpy(zero_copy_only=False)


def ranks(*arrays: np.ndarray) -> tuple[list[np.ndarray], int]:
    """The arrays with each value replaced by its rank among all of them, and how many there are."""
    values = np.unique(np.concatenate(arrays)) if arrays else np.zeros(0, np.int64)
    return [np.searchsorted(values, a) for a in arrays], len(values)


def starts(sorted_keys: np.ndarray) -> np.ndarray:
    """True where a new key begins."""
    out = np.ones(len(sorted_keys), bool)
    out[1:] = sorted_keys[1:] != sorted_keys[:-1]
    return out


def running_max(keys: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Running maximum of ``values`` within runs of equal, ascending ``keys``."""
    if not len(keys):
        return values
    order = np.unique(values)
    rank = np.searchsorted(order, values)
    group = np.cumsum(starts(keys)) - 1
    return order[np.maximum.accumulate(group * len(order) + rank) - group * len(order)]
