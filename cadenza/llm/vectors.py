"""Integer vectors and the exchange of number lists with Python tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F


def is_finite(vector: Column) -> Column:
    """Neither null itself nor with a null or non-finite entry."""
    def broken(c: Column) -> Column:
        c = c.cast("double")
        return c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    return F.coalesce(~F.exists(vector, broken), F.lit(False))


def scaled(vector: Column, scale: int) -> Column:
    """floor(scale * c) of each entry as a long; beyond the range of longs
    it is the nearest long."""
    return F.transform(vector, lambda c: F.floor(
        c.cast("double") * F.lit(float(scale))))


def integer_vectors(rows: DataFrame, vector: str, x: str, scale: int,
                    keep: dict[str, Column]) -> DataFrame:
    """``keep`` and the scaled vector of the rows whose vector is finite."""
    return rows.where(is_finite(F.col(vector))).select(
        *[c.alias(n) for n, c in keep.items()],
        scaled(F.col(vector), scale).alias(x))


def common_length(rows: DataFrame, x: str) -> int:
    """The most frequent length of the vectors, the longest of equally
    frequent ones; 0 for an empty table."""
    found = rows.groupBy(F.size(x).alias("d")).count().orderBy(
        F.desc("count"), F.desc("d")).first()
    return found["d"] if found else 0


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """The lists of a column, all of one width, as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def lists(rows: np.ndarray) -> pa.Array:
    """Each row of a two-dimensional array as one list."""
    ends = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()),
                                    pa.array(rows.ravel()))
