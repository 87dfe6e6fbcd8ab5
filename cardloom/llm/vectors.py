"""Vectors in Arrow batches as numpy arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: Column) -> Column:
    """Whether a vector takes part: not null, not empty, not all zero, and every component finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~bad & F.exists(vector, lambda x: x != 0)


def vector_rows(df: DataFrame, id_col: str, vector_col: str, narrow: bool = False) -> DataFrame:
    """(vec_id long, v array<double>) of the vectors that take part; `narrow` leaves floats as floats."""
    kind = "array<float>" if narrow and dict(df.dtypes)[vector_col] == "array<float>" else "array<double>"
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast(kind).alias("v"))
    return rows.filter(usable(F.col("v")))


def matrix(column: pa.ListArray | pa.ChunkedArray) -> np.ndarray:
    """Rows of equal length as a matrix of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros((0, 0))
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
