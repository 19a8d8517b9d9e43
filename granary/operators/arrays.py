"""Columns of lists as flat arrays, a bounded number of elements at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Elements of lists, and the row of each."""
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    return column.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(column)), sizes)


def slices(batches: Iterator[pa.RecordBatch], sizes: Callable[[pa.RecordBatch], np.ndarray], most: int) -> Iterator[pa.RecordBatch]:
    """Runs of rows of about ``most`` elements, by ``sizes`` of a batch; a row stays whole."""
    for batch in batches:
        of = np.cumsum(sizes(batch)) // most
        cuts = [0, *(np.flatnonzero(np.diff(of)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b > a:
                yield batch.slice(a, b - a)


def list_sizes(column: str) -> Callable[[pa.RecordBatch], np.ndarray]:
    return lambda batch: pc.fill_null(pc.list_value_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def starts(*keys: np.ndarray) -> np.ndarray:
    """Where a run of equal keys begins."""
    n = len(keys[0])
    new = np.zeros(n, bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def lists(bounds: np.ndarray, values: np.ndarray | pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), values if isinstance(values, pa.Array) else pa.array(values))


def shrunk(values: np.ndarray) -> bytes:
    """Whole numbers from 0 on in as few bytes as the greatest needs, all first bytes before all second ones: equal ones compress."""
    width = max(1, (int(values.max(initial=0)).bit_length() + 7) // 8)
    return bytes([width]) + values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def regrown(data: bytes) -> np.ndarray:
    """The numbers of ``shrunk``."""
    planes = np.frombuffer(data, np.uint8, offset=1).reshape(data[0], -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, : data[0]] = planes.T
    return out.view("<u8").ravel()
