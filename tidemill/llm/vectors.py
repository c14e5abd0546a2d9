"""What the vector operators share: sound rows, whole-number vectors, exact dot products."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Entries of this size and more are left out, as non-finite ones are: 1024 times them, squared and summed, has no place in a long.
LARGEST = 2.0**17


def sound(vector: str | Column) -> Column:
    """True for vectors that are not null and whose entries are neither null, nor non-finite, nor of 2**17 and more."""
    x = F.col(vector) if isinstance(vector, str) else vector
    return x.isNotNull() & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) >= LARGEST))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of a list column without nulls, in double precision."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def whole(column: pa.Array, dim: int) -> np.ndarray:
    """floor(1024 * entry), as 64-bit whole numbers."""
    return np.floor(matrix(column, dim) * 1024).astype(np.int64)


def exact_gram(x: np.ndarray) -> np.ndarray:
    """x'x for whole numbers below 2**29, as exact Python integers."""
    most = int(np.abs(x).max(initial=0))
    if most * most * max(1, len(x)) < 2**53:
        return (x.astype(np.float64).T @ x.astype(np.float64)).astype(np.int64).astype(object)
    step = max(1, 2**62 // max(1, most * most))
    return sum((x[k : k + step].T @ x[k : k + step]).astype(object) for k in range(0, len(x), step))


def squared_distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Exact squared Euclidean distances of whole-number rows to whole-number centres."""
    most = int(max(np.abs(x).max(initial=0), np.abs(centres).max(initial=0)))
    if most * most * 4 * x.shape[1] < 2**53:  # then doubles are exact
        a, c = x.astype(np.float64), centres.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ c.T) + (c * c).sum(1)).astype(np.int64)
    return np.stack([((x - c) ** 2).sum(1) for c in centres], 1)
