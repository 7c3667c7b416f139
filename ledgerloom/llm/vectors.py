"""What the operators on vectors share: whole-number components, exact products and distances."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Components count in steps of 1/SCALE. Beyond MOST steps, squared distances and products of a few dozen components no longer fit a long.
SCALE, MOST = 256, 1 << 27
#: Whole numbers below it are exact as doubles.
EXACT = 1 << 53


def whole(vector: Column) -> Column:
    """Each component x as floor(256 * x), with x as double."""
    return F.transform(vector, lambda x: F.floor(SCALE * x.cast("double")).cast("int"))


def usable(vector: Column) -> Column:
    """Whether no component is null, NaN, infinite or beyond ``MOST``; false for a null vector."""
    return F.coalesce(F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) < MOST // SCALE, F.lit(False))), F.lit(False))


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """A column of lists as rows of ``dims`` whole numbers; shorter lists end with zeros."""
    flat, sizes = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.diff(column.offsets.to_numpy())
    if len(flat) == len(column) * dims:
        return flat.reshape(-1, dims)
    out = np.zeros((len(column), dims), np.int64)
    out[np.repeat(np.arange(len(column)), sizes), np.concatenate([np.arange(n) for n in sizes]) if len(sizes) else []] = flat
    return out


def largest(x: np.ndarray) -> int:
    return int(np.abs(x).max(initial=0))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of all rows of ``a`` with all rows of ``b``, exactly: as doubles where those are exact, which is fast."""
    if a.shape[1] * largest(a) * largest(b) < EXACT:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a @ b.T


def squared_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared Euclidean distances of all rows of ``a`` to all rows of ``b``, exactly."""
    if 4 * a.shape[1] * max(largest(a), largest(b)) ** 2 < EXACT:
        return (a * a).sum(1)[:, None] - 2 * products(a, b) + (b * b).sum(1)
    return np.stack([((a - row) ** 2).sum(1) for row in b], axis=1) if len(b) else np.empty((len(a), 0), np.int64)
