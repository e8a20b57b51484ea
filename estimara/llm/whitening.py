"""Embedding whitening by Chebyshev-filtered subspace iteration over distributed centred products.

The covariance is never formed: a pass takes a block of vectors to its product
with the covariance, as sums of X'(XQ) over centred rows. A few Lanczos steps
bound the spectrum from below; then a polynomial recurrence of such passes damps
what lies between that bound and the block's least Ritz value, and QR and
Rayleigh-Ritz follow, until every component's residual certifies it.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stage

SCALE, OFFSET = 1024, 100_000
#: Entries beyond this have no whole number x in a double's exact range; such vectors go like non-finite ones.
LARGEST = 2.0**40
COMPONENTS, BLOCK = 8, 24
LANCZOS_STEPS, MAX_DEGREE, MAX_CYCLES = 12, 24, 60
#: A component is certified by a residual of this part of the largest eigenvalue; if rounding holds it above, by LOOSE and no more progress.
CERTIFIED, LOOSE = 2e-14, 1e-10
#: A filter may stretch the first direction against the block's last by this factor, so that QR keeps all of them.
MAX_STRETCH = 1e9
#: Components with less than this part of the largest variance have none.
NO_VARIANCE = 1e-13
#: Tasks that add up the other tasks' sums, and matrices that the driver gets.
ADDERS = 8
ROWS = "vec_id long, x array<bigint>"


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(vec_id, x) of vectors whose entries are all finite."""
    for batch in batches:
        vectors = batch.column(1)
        sizes = np.where(vectors.is_valid().to_numpy(zero_copy_only=False), vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), 0)
        flat = vectors.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)  # a null entry becomes NaN
        row = np.repeat(np.arange(len(vectors)), sizes)
        bad = np.bincount(row[~(np.abs(flat) < LARGEST)], minlength=len(vectors)) > 0
        good = vectors.is_valid().to_numpy(zero_copy_only=False) & ~bad
        x = np.floor(SCALE * flat[good[row]]).astype(np.int64) + OFFSET
        ends = np.append(0, np.cumsum(sizes[good])).astype(np.int32)
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(good)), pa.ListArray.from_arrays(pa.array(ends), pa.array(x))], ["vec_id", "x"])


def prepared(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, int]:
    """The staged fit list (vec_id, x), and its dimension.

    Vectors that are null or hold null or non-finite entries are gone, and those
    of another length than most have (the longer, if as many).
    """
    names = {c.lower(): f"`{c}`" for c in df.columns}
    own = df.select(F.col(names[vec_id.lower()]).cast("long").alias("vec_id"), F.col(names[vector.lower()]).cast("array<double>").alias("x"))
    rows = stage(own.mapInArrow(_entries, ROWS), "vectors")
    sizes = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    d = sizes[0]["d"] if sizes else 0
    return rows.where(F.size("x") == d), d


def _matrix(batch: pa.RecordBatch, d: int) -> np.ndarray:
    return batch.column(batch.schema.get_field_index("x")).flatten().to_numpy().reshape(-1, d)


def summed(rows: DataFrame, part: Callable[[np.ndarray], np.ndarray], d: int, shape: tuple[int, ...], kind: type) -> np.ndarray:
    """Sum over all batches of ``part`` of their x (rows by ``d``): a matrix from each task, again from each adder, then one."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape, kind)
        for batch in batches:
            if batch.num_rows:
                total += part(_matrix(batch, d))
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape, kind)
        for batch in batches:
            for one in batch.column(0).to_pylist():
                total += np.frombuffer(one, kind).reshape(shape)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

    parts = rows.select("x").mapInArrow(add, "sums binary").repartition(ADDERS).mapInArrow(again, "sums binary").collect()
    return np.sum([np.frombuffer(r[0], kind).reshape(shape) for r in parts], axis=0)


@dataclass
class Whitening:
    """n, sums by dimension, components by falling eigenvalue, and the variance's trace."""

    n: int
    sums: np.ndarray
    components: np.ndarray  # dimensions x components
    values: np.ndarray
    trace: float
    passes: int
    residual: float

    @property
    def start(self) -> np.ndarray:
        """Whole part of the means: x minus it is small and exact."""
        return self.sums // max(self.n, 1)

    @property
    def rest(self) -> np.ndarray:
        return (self.sums - self.n * self.start) / max(self.n, 1)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.start) - self.rest

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ (self.components / np.sqrt(self.values))

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Exact sums of (n x - S)^2; None where that exceeds 64 bits."""
        apart = self.n * (x - self.start) - (self.sums - self.n * self.start)
        about = (apart.astype(float) ** 2).sum(axis=1)
        out = (apart * apart).sum(axis=1).tolist()
        for i in np.flatnonzero(about > 2.0**62):
            exact = sum(int(v) ** 2 for v in apart[i])
            out[i] = exact if exact < 1 << 63 else None
        return out


def _degree(top: float, least: float, centre: float, half: float) -> int:
    """The largest degree whose filter stretches the first Ritz direction by MAX_STRETCH at most against the block's last."""
    grow = [math.acosh(max(1.0, (v - centre) / half)) for v in (top, least)]
    apart = grow[0] - grow[1]
    return MAX_DEGREE if apart <= 0 else max(2, min(MAX_DEGREE, int(math.log(MAX_STRETCH) / apart)))


def lower_bound(times: Callable[[np.ndarray], np.ndarray], d: int, steps: int) -> float:
    """No eigenvalue lies below: the least Ritz value of a few Lanczos steps minus the last residual."""
    q, alphas, betas = np.random.default_rng(7).standard_normal((d, 1)), [], []
    basis = [q / np.linalg.norm(q)]
    for _ in range(min(steps, d)):
        w = times(basis[-1])
        alphas.append(float(basis[-1][:, 0] @ w[:, 0]))
        for b in basis * 2:  # orthogonal to all before, twice
            w = w - b * float(b[:, 0] @ w[:, 0])
        betas.append(float(np.linalg.norm(w)))
        if betas[-1] <= 1e-12 * max(abs(a) for a in alphas) or len(basis) == d:
            break
        basis.append(w / betas[-1])
    k = len(alphas)
    ritz = np.linalg.eigvalsh(np.diag(alphas) + np.diag(betas[: k - 1], 1) + np.diag(betas[: k - 1], -1))
    return max(0.0, float(ritz[0]) - betas[-1])


def leading(times: Callable[[np.ndarray], np.ndarray], d: int, k: int, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, float]:
    """The ``k`` leading eigenvalues and vectors of a symmetric operator, and the largest residual relative to the first value."""
    size = min(d, max(block, 2 * k))
    q = np.linalg.qr(np.random.default_rng(20).standard_normal((d, size)))[0]
    low, best, worse = lower_bound(times, d, LANCZOS_STEPS) if size < d else 0.0, math.inf, 0
    for _ in range(MAX_CYCLES):
        product = times(q)
        small = q.T @ product
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        q, product = q @ turn, product @ turn
        first = max(float(values[0]), 1e-300)
        residual = float(np.linalg.norm(product[:, :k] - q[:, :k] * values[:k], axis=0).max()) / first
        worse = worse + 1 if residual > best / 2 else 0
        best = min(best, residual)
        if residual <= CERTIFIED or residual <= LOOSE and worse >= 2 or values[0] <= 0:
            return values[:k], q[:, :k], residual
        # y_j is the filter's polynomial of degree j of the covariance, times q: 1 at most within the unwanted part, growing above it.
        cut = max(float(values[-1]), low + 1e-9 * first)
        centre, half = (cut + low) / 2, (cut - low) / 2
        before, y = q, (product - centre * q) / half
        for _ in range(_degree(float(values[0]), float(values[min(k, size - 1)]), centre, half) - 1):
            before, y = y, 2 / half * (times(y) - centre * y) - before
        q = np.linalg.qr(y / np.linalg.norm(y, axis=0))[0]
    raise ArithmeticError(f"The components aren't certified after {MAX_CYCLES} cycles: the residual is {residual:.1e}.")


def fit(rows: DataFrame, d: int, components: int = COMPONENTS) -> Whitening:
    """``rows``: the fit list of ``prepared``. Components without variance are left out."""
    whole = summed(rows, lambda x: np.append(x.sum(axis=0), len(x)), d, (d + 1,), np.int64)
    fitted = Whitening(int(whole[-1]), whole[:-1], np.zeros((d, 0)), np.zeros(0), 0.0, 0, 0.0)
    if not fitted.n or not d:
        return fitted
    centred, n = fitted.centred, fitted.n
    fitted.trace = float(summed(rows, lambda x: (centred(x) ** 2).sum(axis=0), d, (d,), np.float64).sum() / n)
    if not fitted.trace > 0:
        return fitted

    def times(q: np.ndarray) -> np.ndarray:
        fitted.passes += 1

        def part(x: np.ndarray) -> np.ndarray:
            own = centred(x)
            return own.T @ (own @ q)

        return summed(rows, part, d, q.shape, np.float64) / n

    values, vectors, fitted.residual = leading(times, d, min(components, d))
    some = values > NO_VARIANCE * values[0]
    fitted.values, fitted.components = values[some], vectors[:, some]
    return fitted


def identity_error(rows: DataFrame, fitted: Whitening, d: int) -> float:
    """Largest absolute entry of the whitened vectors' covariance minus the identity; their means are theirs, not taken as zero."""
    k = len(fitted.values)
    if not k:
        return 0.0

    def part(x: np.ndarray) -> np.ndarray:
        w = fitted.whitened(x)
        return np.vstack([w.T @ w, w.sum(axis=0)])

    sums = summed(rows, part, d, (k + 1, k), np.float64) / fitted.n
    return float(np.abs(sums[:k] - np.outer(sums[k], sums[k]) - np.eye(k)).max())


def whiten(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error: a row for each remaining row and component.

    Rows whose vector is null, holds null or non-finite entries (or some beyond
    2**40), or has another length than most, are left out, also from the fit.
    Components without variance are left out, so a table of equal vectors, or
    of one, gives no rows; so does an empty one. Equal eigenvalues may have any
    basis of their space. Rows with equal or null ids are rows of their own.
    deviation is null where it exceeds 64 bits. Other columns, whatever their
    names, aren't looked at.
    """
    rows, d = prepared(df, vec_id, vector)
    fitted = fit(rows, d, components)
    k, error = len(fitted.values), identity_error(rows, fitted, d)
    shares = fitted.values / fitted.trace if k else fitted.values

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not k or not batch.num_rows:
                continue
            x, m = _matrix(batch, d), batch.num_rows
            each = pa.array(np.repeat(np.arange(m), k))
            columns = [batch.column(0).take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, fitted.n)), pa.array(fitted.deviations(x), pa.int64()).take(each)]
            columns += [pa.array(fitted.whitened(x).ravel()), pa.array(np.tile(shares, m)), pa.array(np.full(m * k, error))]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
