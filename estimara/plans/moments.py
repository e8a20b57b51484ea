"""Cross-moments of some columns in one pass: what every linear estimator here is made of."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import first_means, gram

#: Columns beyond which products are sums of matrix blocks: as expressions they grow with the square.
WIDE = 16
#: Rows from which sums are shifted; any point near the data does, none changes the result.
SHIFT_ROWS = 1000
#: A column is collinear if this part of its variance is left after those before it.
COLLINEAR = 1e-11


@dataclass
class Moments:
    """Sum of weights, means and centred cross-products, of columns by name."""

    names: list[str]
    n: int
    weight: float
    means: np.ndarray
    cross: np.ndarray

    def at(self, names: list[str]) -> list[int]:
        return [self.names.index(x) for x in names]

    def block(self, rows: list[str], columns: list[str]) -> np.ndarray:
        return self.cross[np.ix_(self.at(rows), self.at(columns))]

    def mean(self, names: list[str]) -> np.ndarray:
        return self.means[self.at(names)]


def shift_of(df: DataFrame, names: list[str]) -> np.ndarray:
    """Means of a few rows: a first guess of where the data lie."""
    if len(names) > WIDE:
        return first_means(df, [F.col(x) for x in names], SHIFT_ROWS)
    row = df.select(*names).limit(SHIFT_ROWS).agg(*(F.avg(F.col(x).cast("double")).alias(x) for x in names)).first()
    return np.array([v if v is not None else 0.0 for v in row])


def pairs(k: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(k) for j in range(i, k)]


def symmetric(values: list[float | None], k: int) -> np.ndarray:
    out = np.zeros((k, k))
    for (i, j), v in zip(pairs(k), values):
        out[i, j] = out[j, i] = v or 0.0
    return out


def moments(df: DataFrame, names: list[str], weight: str | None = None, shift: np.ndarray | None = None) -> Moments:
    """One aggregation over ``df`` (which must have no nulls in these columns); of many columns, one pass of matrix blocks.

    shift: a guess of the means; without one, those of a few rows.
    """
    k = len(names)
    shift = shift_of(df, names) if shift is None else shift
    if k > WIDE:
        n, size, sums, cross = gram(df, [F.col(c) for c in names], shift, F.col(weight) if weight else None)
        if not n:
            return Moments(names, 0, 0.0, np.full(k, np.nan), np.full((k, k), np.nan))
        return Moments(names, n, size, sums / size + shift, cross - np.outer(sums, sums) / size)
    x = [F.col(c).cast("double") - float(s) for c, s in zip(names, shift)]
    w = F.col(weight).cast("double") if weight else None
    by = (lambda c: c * w) if weight else (lambda c: c)
    total = F.sum(w) if weight else F.count("*").cast("double")
    row = df.agg(F.count("*"), total, *(F.sum(by(c)) for c in x), *(F.sum(by(x[i] * x[j])) for i, j in pairs(k))).first()
    n, size = row[0], row[1] or 0.0
    if not n:
        return Moments(names, 0, 0.0, np.full(k, np.nan), np.full((k, k), np.nan))
    sums = np.array(row[2 : 2 + k], float)
    return Moments(names, n, size, sums / size + shift, symmetric(list(row[2 + k :]), k) - np.outer(sums, sums) / size)


@dataclass
class GroupedMoments:
    """Within groups: cross-products about the groups' means, of groups of two rows or more."""

    n: int
    groups: int
    within: Moments


def within_moments(df: DataFrame, names: list[str], group: str) -> GroupedMoments:
    """Sums by group, then over groups: rows are combined before the shuffle and nothing is joined back.

    Of many columns, the products within are those of all rows minus those of the groups' sums.
    """
    k, shift = len(names), shift_of(df, names)
    if k > WIDE:
        x = [F.col(c).cast("double") for c in names]
        sums = df.groupBy(group).agg(F.count("*").alias("n"), *(F.sum(c - float(v)).alias(f"s{i}") for i, (c, v) in enumerate(zip(x, shift))))
        _, _, _, whole = gram(df, x, shift)
        _, _, _, apart = gram(sums, [F.col(f"s{i}") / F.sqrt("n") for i in range(k)], np.zeros(k))
        large = sums.where("n >= 2")
        groups, n, total, _ = gram(large, [*(F.col(f"s{i}") / F.col("n") for i in range(k))], np.zeros(k), F.col("n"))
        return GroupedMoments(int(n), groups, Moments(names, int(n), n, total / max(n, 1.0) + shift, whole - apart))
    x = [F.col(c).cast("double") - float(s) for c, s in zip(names, shift)]
    sums = df.groupBy(group).agg(F.count("*").alias("n"), *(F.sum(c).alias(f"s{i}") for i, c in enumerate(x)), *(F.sum(x[i] * x[j]).alias(f"p{i}_{j}") for i, j in pairs(k)))
    row = sums.where("n >= 2").agg(F.sum("n"), F.count("*"), *(F.sum(F.col(f"p{i}_{j}") - F.col(f"s{i}") * F.col(f"s{j}") / F.col("n")) for i, j in pairs(k)), *(F.sum(f"s{i}") for i in range(k))).first()
    n = row[0] or 0
    means = np.array([v or 0.0 for v in row[2 + len(pairs(k)) :]]) / max(n, 1) + shift
    return GroupedMoments(n, row[1], Moments(names, n, float(n), means, symmetric(list(row[2 : 2 + len(pairs(k))]), k)))


def cross_sums(df: DataFrame, columns: list[Column], weight: Column | None = None) -> tuple[int, np.ndarray]:
    """Count, and sums of weight times products of columns: the middle of a sandwich."""
    k = len(columns)
    if k > WIDE:
        n, _, _, cross = gram(df, columns, np.zeros(k), weight)
        return n, cross
    by = (lambda c: c * weight) if weight is not None else (lambda c: c)
    row = df.agg(F.count("*"), *(F.sum(by(columns[i] * columns[j])) for i, j in pairs(k))).first()
    return row[0], symmetric(list(row[1:]), k)


def collinear(cross: np.ndarray, names: list[str]) -> list[str]:
    """Columns that those before them, and the constant, determine."""
    size = np.sqrt(np.maximum(np.diag(cross), 0))
    bad: list[str] = []
    left = np.divide(cross, np.outer(size, size), out=np.zeros_like(cross), where=np.outer(size, size) > 0)
    for i, name in enumerate(names):
        if left[i, i] <= COLLINEAR:
            bad.append(name)
            continue
        left = left - np.outer(left[:, i], left[i, :]) / left[i, i]
    return bad


def qr_factor(df: DataFrame, names: list[str], weight: str | None = None) -> tuple[np.ndarray, int]:
    """R of the QR factorisation of these columns (no nulls), and the number of rows; weight: of rows times the weights' roots.

    Each batch gives a factor, and the factors again, all in one pass.
    """
    k = len(names)

    def run(batches):
        import pyarrow as pa

        held, n = np.zeros((0, k)), 0
        for batch in batches:
            rows = np.column_stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(k)])
            held, n = np.linalg.qr(np.vstack([held, rows]), mode="r"), n + sum(batch.column(k).to_pylist())
        counts = pa.array([n] + [0] * (len(held) - 1), pa.int64()) if len(held) else pa.array([], pa.int64())
        yield pa.RecordBatch.from_arrays([*(pa.array(held[:, i]) for i in range(k)), counts], [*(f"x{i}" for i in range(k)), "n"])

    root = F.sqrt(F.col(weight).cast("double")) if weight else F.lit(1.0)
    numbers = df.select(*((F.col(x).cast("double") * root).alias(f"x{i}") for i, x in enumerate(names)), F.lit(1).cast("long").alias("n"))
    schema = ", ".join(f"x{i} double" for i in range(k)) + ", n long"
    # At most k rows from each task, then from each of 16, then one.
    parts = np.array([list(r) for r in numbers.mapInArrow(run, schema).repartition(16).mapInArrow(run, schema).collect()], float).reshape(-1, k + 1)
    return np.linalg.qr(parts[:, :k], mode="r"), int(parts[:, k].sum())
