"""Integer vectors: exact products and distances, whatever the size of the components.

Components are 64-bit integers.  Where no partial sum can reach 2^53, products go through
double-precision matrix products, which are exact then; beyond that through 64-bit integers,
and beyond that through Python's integers.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where results that do not fit a long end.
MOST = (1 << 63) - 1


def integer_vectors(rows: DataFrame, scale: int, *columns, vector: str = "embedding") -> DataFrame:
    """The columns and `v`: floor(scale * x) of each component, as longs (products beyond them end at their limits).

    Rows whose vector is null or holds a null or non-finite component are left out.
    """
    x = F.transform(vector, lambda c: c.cast("double"))
    bad = F.exists("x", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))))
    good = rows.select(*columns, x.alias("x")).filter(F.col("x").isNotNull() & ~bad)
    return good.withColumn("v", F.transform("x", lambda c: F.floor(c * F.lit(float(scale))).cast("long"))).drop("x")


def matrix(column, width: int) -> np.ndarray:
    """An Arrow column of lists of `width` longs, as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(-1, width)


def _largest(x: np.ndarray) -> int:
    return max(int(x.max(initial=0)), -int(x.min(initial=0)))


def products(a: np.ndarray, b: np.ndarray, beside: int = 1) -> np.ndarray:
    """a @ b.T, exactly; integers so large that `beside` such products fit, else Python's."""
    most = _largest(a) * _largest(b) * max(1, a.shape[1]) * beside
    if most < 1 << 53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    kind = np.int64 if most < 1 << 62 else object
    return a.astype(kind) @ b.T.astype(kind)


def squared_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of each row of a from each row of b, exactly."""
    far = max(_largest(a), _largest(b))
    kind = np.int64 if 4 * far * far * max(1, a.shape[1]) < 1 << 62 else object
    x, y = a.astype(kind), b.astype(kind)
    return (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None, :] - 2 * products(a, b, 4).astype(kind)


def squared_from_own(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of each row of a from the row of b at its place, exactly."""
    kind = np.int64 if 4 * max(_largest(a), _largest(b)) ** 2 * max(1, a.shape[1]) < 1 << 62 else object
    x = a.astype(kind) - b.astype(kind)
    return (x * x).sum(axis=1)


def to_long(x: np.ndarray) -> np.ndarray:
    """As 64-bit integers; what does not fit ends at the limits."""
    return x if x.dtype == np.int64 else np.array([max(-MOST - 1, min(MOST, int(y))) for y in x.ravel()], np.int64).reshape(x.shape)
