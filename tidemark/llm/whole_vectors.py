"""Vectors as whole numbers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

MOST = 1 << 24  # components beyond count as this much, so that squares of differences and their sums fit a long


def whole_vectors(vectors: DataFrame, scale: int, vec_id: str, vector: str, label: str) -> DataFrame:
    """``vec_id, label, v``: rows whose vector is not null and has only finite components, each as ``floor(scale * x)``."""
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("v"))
    bad = F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = rows.filter(F.col("v").isNotNull()).filter(~bad)
    whole = F.transform("v", lambda c: F.floor(F.greatest(F.least(c * scale, F.lit(float(MOST))), F.lit(float(-MOST)))).cast("int"))
    return rows.withColumn("v", whole)


def width_of(rows: DataFrame) -> int:
    """Length of the longest vector, 0 without rows."""
    return rows.agg(F.max(F.size("v"))).first()[0] or 0


def padded(column, width: int) -> np.ndarray:
    """A column of lists as rows of ``width`` numbers, shorter lists filled up with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(column), width), dtype=np.int64)
    out[np.arange(width) < sizes[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out
