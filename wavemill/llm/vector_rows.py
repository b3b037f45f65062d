"""Vectors as rows of integers, for operators that count exactly."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavemill.llm.common import slices

FAR = 2.0**50  # scaled components beyond this count as this
ROWS = 2048  # rows that Python holds at a time


def usable_rows(vectors: DataFrame, id_col: str, vector_col: str, **more) -> tuple[DataFrame, int]:
    """(vec_id, vec, more columns) of the vectors that are not null or empty, hold neither nulls nor
    non-finite components and have the length that most of these have (of equally many, the
    greater): vectors of other lengths have no place in one space with them; and that length."""
    columns = [F.col(c).alias(n) for n, c in more.items()]
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vec"), *columns)
    bad = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.where(F.coalesce((F.size("vec") > 0) & ~bad, F.lit(False)))
    most = rows.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    dims = most["d"] if most else 0
    return rows.where(F.size("vec") == dims), dims


def scaled(column: pa.Array, scale: int, plus: int = 0) -> np.ndarray:
    """floor(scale * component) + plus of an Arrow column of equally long lists, as a matrix of int64."""
    x = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
    return np.clip(np.floor(x * scale), -FAR, FAR).astype(np.int64) + plus


def blocks(batches, rows: int = ROWS):
    for part in slices(batches, rows):
        if part.num_rows:
            yield part


def magnitude(*arrays: np.ndarray) -> int:
    return max((max(int(x.max()), -int(x.min())) for x in arrays if x.size), default=0)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b of matrices of integers without loss: in doubles where all sums stay exact there,
    else with Python's integers."""
    if magnitude(a) * magnitude(b) * a.shape[1] < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64)).astype(np.int64)
    return a.astype(object) @ b.astype(object)


def decimals(values) -> pa.Array:
    """Integers as decimals of 38 digits; larger ones are null."""
    return pa.array([v if abs(v) < 10**38 else None for v in map(int, values)], pa.decimal128(38, 0))
