"""Vector functions on array columns; sums are doubles in the order of the components."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Added to lengths before a division.
TINY = 1e-8


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / ((norm(a) + TINY) * (norm(b) + TINY))


def let(value: Column, body) -> Column:
    """``body(value)``, with ``value`` worked out once a row however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def normalise(a: Column) -> Column:
    return let(norm(a) + TINY, lambda length: F.transform(a, lambda x: x.cast("double") / length))


def truncated(a: Column, dim: int) -> Column:
    """The first ``dim`` components, made a unit vector."""
    return normalise(F.slice(a, 1, dim))


def literal(values) -> Column:
    return F.array(*(F.lit(float(v)) for v in values))


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """An Arrow column of vectors as rows of doubles. What is missing at a shorter one's end, or in it, is 0."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    there = np.arange(lengths.max(initial=0)) < lengths[:, None]
    out = np.zeros(there.shape)
    out[there] = column.flatten().cast(pa.float64()).fill_null(0.0).to_numpy(zero_copy_only=False)
    return out


def dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``dot`` of each row of ``a`` with that of ``b``, with the same sums."""
    shared = min(a.shape[1], b.shape[1])
    return np.add.accumulate(a[:, :shared] * b[:, :shared], axis=1)[:, -1] if shared else np.zeros(len(a))
