"""Sums of matrices over all rows: Arrow batches as blocks of numbers, products by BLAS, one matrix a task, added up by a tree."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Tasks that add up the matrices of all others; the driver gets one from each.
ADDERS = 16
SUMS = "sums binary"


def numbers(batch: pa.RecordBatch) -> np.ndarray:
    """Rows by columns, as doubles; a null is NaN."""
    out = np.empty((batch.num_columns, batch.num_rows))  # column by column, as Arrow has them
    for i in range(batch.num_columns):
        out[i] = batch.column(i).to_numpy(zero_copy_only=False)
    return out.T


def packed(total: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])


def added(parts: DataFrame, shape: tuple[int, ...]) -> np.ndarray:
    """Sum of packed matrices: by ADDERS tasks, then here."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in batches:
            for one in batch.column(0).to_pylist():
                total += np.frombuffer(one).reshape(shape)
        yield packed(total)

    got = parts.select("sums").repartition(ADDERS).mapInArrow(add, SUMS).collect()
    return np.sum([np.frombuffer(r[0]).reshape(shape) for r in got], axis=0)


def summed(df: DataFrame, columns: list[Column], part: Callable[[np.ndarray], np.ndarray], shape: tuple[int, ...]) -> np.ndarray:
    """Sum of ``part`` of every block (rows by ``columns``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in batches:
            if batch.num_rows:
                total += part(numbers(batch))
        yield packed(total)

    return added(df.select(*(c.cast("double").alias(f"x{i}") for i, c in enumerate(columns))).mapInArrow(run, SUMS), shape)


def gram(df: DataFrame, columns: list[Column], shift: np.ndarray, weight: Column | None = None) -> tuple[int, float, np.ndarray, np.ndarray]:
    """Rows, sum of weights, and weighted sums and cross-products of the columns minus ``shift``."""
    k, weighted = len(columns), weight is not None

    def part(x: np.ndarray) -> np.ndarray:
        z = np.ones((k + 1, len(x)))  # the last row of the product has the sums
        z[:k] = x.T[:k] - shift[:, None]
        out = np.zeros((k + 2, k + 1))
        out[: k + 1] = (z * x.T[k:]) @ z.T if weighted else z @ z.T
        out[k + 1, 0] = len(x)
        return out

    total = summed(df, [*columns, *([weight] if weighted else [])], part, (k + 2, k + 1))
    return int(round(total[k + 1, 0])), float(total[k, k]), total[k, :k], total[:k, :k]


def first_means(df: DataFrame, columns: list[Column], rows: int) -> np.ndarray:
    """Means of a few rows."""
    some = df.select(*(c.cast("double").alias(f"x{i}") for i, c in enumerate(columns))).limit(rows).toArrow()
    values = np.array([some.column(i).to_numpy() for i in range(len(columns))]).reshape(len(columns), -1)
    return np.array([np.nanmean(v) if len(v) and not np.isnan(v).all() else 0.0 for v in values])
