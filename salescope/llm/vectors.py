"""Vector columns as numpy matrices inside Arrow tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def valid(vector: Column) -> Column:
    """Not null, no null or non-finite component, not zero."""
    as_double = F.transform(vector, lambda x: x.cast("double"))
    finite = F.forall(as_double, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vector.isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(as_double, lambda x: x != 0)


def matrices(col: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix in double precision) for each length of the vectors."""
    off = np.asarray(col.offsets, dtype=np.int64)
    flat = np.asarray(col.values, dtype=np.float64)
    size = np.diff(off)
    for n in np.unique(size):
        rows = np.flatnonzero(size == n)
        if n:
            yield rows, flat[off[rows][:, None] + np.arange(n)]


def power_of_two(n: int) -> int:
    return 1 << max(0, int(n - 1).bit_length())


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the columns (length a power of two);
    a step adds and subtracts whole rows.  ``x`` is overwritten."""
    d, n = x.shape
    other, h = np.empty_like(x), 1
    while h < d:
        was, now = x.reshape(d // (2 * h), 2, h, n), other.reshape(d // (2 * h), 2, h, n)
        np.add(was[:, 0], was[:, 1], out=now[:, 0])
        np.subtract(was[:, 0], was[:, 1], out=now[:, 1])
        x, other, h = other, x, 2 * h
    x /= np.sqrt(d)
    return x


def rotation(x: np.ndarray, seed: int) -> np.ndarray:
    """Pseudorandom rotation: three rounds of random signs and a Hadamard
    transform, on rows padded to a power of two."""
    d = power_of_two(x.shape[1])
    y = np.zeros((d, len(x)))
    y[:x.shape[1]] = x.T
    signs = np.random.Generator(np.random.Philox(key=seed)).integers(0, 2, size=(3, d)) * 2.0 - 1.0
    for s in signs:
        y *= s[:, None]
        y = hadamard(y)
    return np.ascontiguousarray(y.T)
