"""Embedding tables as whole numbers, and Arrow columns of them as matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: An entry c becomes floor(SCALE * c).
SCALE = 256


def usable(vector: Column) -> Column:
    """Whether a vector is not null, has entries, and all of them are finite."""
    return vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))


def whole(vector: Column) -> Column:
    """array<bigint>: floor(SCALE * c) of each entry, computed in double precision."""
    return F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE).cast("bigint"))


def of_usual_length(rows: DataFrame, vector: str) -> tuple[DataFrame, int]:
    """The rows whose vector has the length that most have (of several such lengths the greatest), and that length; 0 for an empty table."""
    found = rows.groupBy(F.size(vector).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    d = found["d"] if found else 0
    return rows.where(F.size(vector) == d), d


def matrix(column: pa.Array | pa.ChunkedArray, d: int) -> np.ndarray:
    """A column of lists of d whole numbers as int64 rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.int64).reshape(len(column), d)
