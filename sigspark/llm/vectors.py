"""Which vectors take part in a comparison, and copies as one row."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KIND = "array<double>"


def usable(vector: str) -> Column:
    """Neither null nor empty nor zero, and without null or non-finite components."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(
        F.col(vector).isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(vector, lambda x: x != 0), F.lit(False)
    )


def usable_rows(embeddings: DataFrame, vector: str = "embedding") -> DataFrame:
    """vec_id and ``vec`` (doubles) of the rows that take part."""
    return embeddings.where(usable(vector)).select("vec_id", F.col(vector).cast(KIND).alias("vec"))


def matrix(column: pa.Array) -> np.ndarray:
    """The rows of a list column that all have the same length."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):  # more than one chunk does not occur after combining, except for none
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.list_(pa.float64()))
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 0))
