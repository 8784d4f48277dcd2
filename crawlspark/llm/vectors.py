"""Shared by the vector operators: usable vectors, bounded samples, Arrow lists as matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Rows that rotations and tree splits are fitted on; they steer speed, never results.
SAMPLE = 8192


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding as array<double>) of vectors that have a cosine, of any length.

    Left out: a null vec_id, null vectors, null or non-finite components, zero and empty vectors. Rows that
    repeat a vec_id and its vector are one. Only vectors of one length have a cosine with each other.
    """
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    v = v.where(F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & finite & F.exists("embedding", lambda x: x != 0))
    return v.dropDuplicates(["vec_id", "embedding"])


def width(vectors: DataFrame) -> int:
    """Length of the longest vector."""
    return vectors.agg(F.max(F.size("embedding"))).first()[0] or 0


def lengths(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)


def matrix(column: pa.Array | pa.ChunkedArray, columns: int) -> np.ndarray:
    """Lists as the rows of a matrix, filled with zeros up to so many columns."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    out = np.zeros((len(column), columns))
    out[np.arange(columns) < lengths(column)[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; large or tiny components don't overflow on the way."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def sample(vectors: DataFrame, columns: int, rows: int = SAMPLE) -> np.ndarray:
    """A fixed pseudo-random choice of at most so many unit vectors, on the driver."""
    chosen = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(rows).select("embedding").toArrow()
    found = matrix(chosen.column(0), columns)
    return unit(found) if len(found) else found
