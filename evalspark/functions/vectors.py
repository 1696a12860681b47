"""Vector expressions. Products run as Arrow batches: one numpy pass per batch."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F
from pyspark.sql.types import DoubleType

from evalspark.functions.binding import bind


def l2_normalize(vector: Column) -> Column:
    """Unit length, with a zero vector left as it is."""
    squares = F.aggregate(vector, F.lit(0.0).cast("double"), lambda s, x: s + x.cast("double") * x.cast("double"))
    return bind(F.sqrt(squares), lambda norm: F.transform(
        vector, lambda x: x.cast("double") / F.when(norm == 0, F.lit(1.0)).otherwise(norm)))


def _rows(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Flat float64 values and row offsets of a list array, ragged rows allowed."""
    offsets = column.offsets.to_numpy()
    values = column.values.to_numpy(zero_copy_only=False).astype(np.float64)
    return values[offsets[0]:offsets[-1]], offsets - offsets[0]


def _row_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    lengths = np.diff(offsets)
    if len(lengths) and lengths.min() == lengths.max() and lengths[0] > 0:
        return values.reshape(len(lengths), lengths[0]).sum(axis=1)
    sums = np.concatenate([[0.0], np.cumsum(values)])
    return sums[offsets[1:]] - sums[offsets[:-1]]


@F.arrow_udf(DoubleType())
def cosine(left: pa.Array, right: pa.Array) -> pa.Array:
    """Cosine of two list columns row by row; a zero vector scores 0."""
    left = pa.concat_arrays(left.chunks) if isinstance(left, pa.ChunkedArray) else left
    right = pa.concat_arrays(right.chunks) if isinstance(right, pa.ChunkedArray) else right
    a, offsets = _rows(left)
    b, _ = _rows(right)
    dot = _row_sums(a * b, offsets)
    norm = np.sqrt(_row_sums(a * a, offsets)) * np.sqrt(_row_sums(b * b, offsets))
    return pa.array(np.divide(dot, norm, out=np.zeros_like(dot), where=norm != 0))
