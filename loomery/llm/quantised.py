"""Vectors as small integers, and exact squared distances between them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A component becomes floor(SCALE * x).
SCALE = 1024
#: Integers stay below this, so that a squared distance of 64 components fits in 62 bits.
LARGEST = 1 << 27


def whole(vector: Column) -> Column:
    """True where a vector is there and holds neither nulls nor non-finite components."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & finite, F.lit(False))


def floors(vector: Column) -> Column:
    """floor(SCALE * x) of each component in double precision, as array<int>. A component whose
    integer isn't below LARGEST in size is an error, never a wrong distance."""
    far = F.exists(vector, lambda x: F.abs(x.cast("double")) >= float(LARGEST // SCALE))
    ints = F.transform(vector, lambda x: F.floor(x.cast("double") * SCALE).cast("int"))
    return F.when(far, F.raise_error(F.lit(f"a component is {LARGEST // SCALE} or larger in size"))).otherwise(ints)


def quantised(vectors: DataFrame, id_col: str, vector_col: str, *keep: Column) -> DataFrame:
    """``id`` (long), ``q`` and the columns ``keep`` of the rows whose vectors are ``whole``."""
    v = F.col(vector_col)
    return vectors.where(whole(v)).select(F.col(id_col).cast("long").alias("id"), floors(v).alias("q"), *keep)


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Lists of one length as rows of integers."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim)


def distances(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances (int64) of all rows of ``x`` from all ``entries``."""
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(entries).max(initial=0)))
    if 4 * most * most * max(1, x.shape[1]) < 1 << 52:  # then doubles hold every sum exactly
        a, b = x.astype(np.float64), entries.astype(np.float64)
        return ((a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)).astype(np.int64)
    a, b = x.astype(np.int64), entries.astype(np.int64)
    return np.stack([((a - e) ** 2).sum(axis=1) for e in b], axis=1)
