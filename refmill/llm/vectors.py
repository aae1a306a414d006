"""What the operators on embeddings share: which vectors take part, and their bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, vec): distinct ids with a vector of finite components that isn't all zero, as doubles.

    Vectors of other lengths than the most common one take no part; of several rows with one id the least vector counts.
    """
    v = F.col("_v")
    df = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("_v"))
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    df = df.filter(F.col("vec_id").isNotNull() & v.isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(v, lambda x: x != 0))
    return df.groupBy("vec_id").agg(F.min("_v").alias("vec"))


def common_length(df: DataFrame) -> int:
    """The most common length (the smaller of two), 0 for an empty table: one row comes to the driver."""
    top = df.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return top["n"] if top else 0


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """float64[rows, dim] of a list column."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(-1, dim)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def batches_of(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(0, b.num_rows, size):
            yield b.slice(i, size)
