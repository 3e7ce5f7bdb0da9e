"""Whitening of vectors: projection on the leading eigenvectors of their covariance, each scaled to unit variance.

Vectors become whole numbers, so their number and sums are exact and every vector is
centred before anything is multiplied: n x - S is a whole number however far the mean lies
from zero. Each task adds up the products of its centred vectors, Spark adds these up by
place in the matrix, and the matrix, whose size is that of a vector squared whatever the
table, is taken apart on the driver: Householder reflections make it tridiagonal, bisection
on Sturm counts finds the leading eigenvalues, inverse iteration their vectors, which are
made orthogonal to those of close eigenvalues before. The components are broadcast
and every row is projected where it is scanned.

Copies of a vector count once for the fit and are all projected.

Defined cases: vectors that are NULL or hold NULL or non-finite components take no part, nor
do those of another length than most (the longer one at a tie); a NULL id is an id; extra
columns are left out. Components without variance (beyond rounding) have no whitened form and
are left out, so one vector alone gives no rows, and neither does an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.centroids import usable
from tidemark.llm.common import map_batches
from tidemark.operators.staging import staged

_EPS = np.finfo(np.float64).eps
RESULT = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal, off-diagonal and the reflections (unit vectors) that lead there from a symmetric matrix."""
    a, reflections = matrix.astype(np.float64).copy(), []
    for k in range(len(a) - 2):
        v = a[k + 1 :, k].copy()
        length = np.linalg.norm(v)
        if length > 0 and np.any(v[1:] != 0):
            v[0] += np.copysign(length, v[0])
            v /= np.linalg.norm(v)
            rest = a[k + 1 :, k + 1 :]
            p = rest @ v
            w = p - (v @ p) * v
            rest -= 2 * (np.outer(v, w) + np.outer(w, v))
            first = a[k + 1 :, k] - 2 * v * (v @ a[k + 1 :, k])
            a[k + 1 :, k] = a[k, k + 1 :] = first
        else:
            v = np.zeros_like(v)
        reflections.append(v)
    return np.diag(a).copy(), np.diag(a, 1).copy(), reflections


def reflected_back(reflections: list[np.ndarray], vector: np.ndarray) -> np.ndarray:
    """A vector of the tridiagonal matrix as one of the matrix it came from."""
    out = vector.copy()
    for k in reversed(range(len(reflections))):
        v = reflections[k]
        out[k + 1 :] -= 2 * v * (v @ out[k + 1 :])
    return out


def sturm_count(diagonal: np.ndarray, off: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many eigenvalues are less than each number of ``at``."""
    floor = np.finfo(np.float64).tiny * max(1.0, float((off**2).max(initial=0.0)))
    count, q = np.zeros(len(at), np.int64), np.ones(len(at))
    for i, d in enumerate(diagonal):
        q = d - at - (off[i - 1] ** 2 / q if i else 0.0)
        q = np.where(np.abs(q) < floor, -floor, q)
        count += q < 0
    return count


def leading_eigenvalues(diagonal: np.ndarray, off: np.ndarray, many: int) -> np.ndarray:
    """The ``many`` largest eigenvalues, falling, bisected until no double lies between the bounds."""
    n = len(diagonal)
    around = np.abs(np.concatenate([[0], off])) + np.abs(np.concatenate([off, [0]]))
    low = np.full(many, (diagonal - around).min()) - _EPS
    high = np.full(many, (diagonal + around).max()) + _EPS
    below = n - 1 - np.arange(many)  # so many eigenvalues are less than the wanted one
    for _ in range(200):
        middle = low + (high - low) / 2
        if ((middle == low) | (middle == high)).all():
            break
        up = sturm_count(diagonal, off, middle) <= below
        low, high = np.where(up, middle, low), np.where(up, high, middle)
    return low + (high - low) / 2


def _solve(diagonal: np.ndarray, off: np.ndarray, shift: float, right: np.ndarray) -> np.ndarray:
    """(T - shift) y = right by elimination with exchange of neighbouring rows."""
    n, least = len(diagonal), _EPS * max(float(np.abs(diagonal).max()), float(np.abs(off).max(initial=0.0)), np.finfo(float).tiny)
    d, u, s, y = (diagonal - shift).copy(), np.append(off, 0.0), np.zeros(n), right.copy()  # diagonal and the two above
    for i in range(n - 1):
        below = off[i]
        if abs(d[i]) >= abs(below):
            d[i] = d[i] if abs(d[i]) > least else np.copysign(least, d[i])
            m = below / d[i]
            d[i + 1] -= m * u[i]
            y[i + 1] -= m * y[i]
        else:
            m = d[i] / below
            d[i], u[i], s[i], d[i + 1], u[i + 1] = below, d[i + 1], u[i + 1], u[i] - m * d[i + 1], -m * u[i + 1]
            y[i], y[i + 1] = y[i + 1], y[i] - m * y[i + 1]
    for i in reversed(range(n)):
        d[i] = d[i] if abs(d[i]) > least else np.copysign(least, d[i])
        y[i] = (y[i] - (u[i] * y[i + 1] if i + 1 < n else 0.0) - (s[i] * y[i + 2] if i + 2 < n else 0.0)) / d[i]
    return y


def eigenvectors(diagonal: np.ndarray, off: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit vectors of ``values`` (falling) by inverse iteration, one row each; those of close values are kept orthogonal."""
    size = max(float(np.abs(diagonal).max()) + 2 * float(np.abs(off).max(initial=0.0)), np.finfo(float).tiny)
    random, out, begun, shift = np.random.default_rng(13), [], 0, np.inf
    for k, value in enumerate(values):
        if k and values[k - 1] - value > 1e-3 * size:
            begun = k
        # Equal values get shifts that differ a little, or they would give one vector.
        shift = min(value, shift - 10 * _EPS * size) if k > begun else value
        y = random.standard_normal(len(diagonal))
        for _ in range(6):
            for other in (*out[begun:k], *out[begun:k]):
                y = y - (other @ y) * other
            y = _solve(diagonal, off, shift, y / np.abs(y).max())
            y = y / np.abs(y).max()
        for other in (*out[begun:k], *out[begun:k]):
            y = y - (other @ y) * other
        out.append(y / np.linalg.norm(y))
    return np.array(out)


def leading_components(matrix: np.ndarray, many: int) -> tuple[np.ndarray, np.ndarray]:
    """Up to ``many`` largest eigenvalues of a covariance matrix that are not zero, and their unit vectors as rows."""
    scale = float(np.trace(matrix))
    if not scale > 0:
        return np.empty(0), np.empty((0, len(matrix)))
    diagonal, off, reflections = tridiagonal(matrix / scale)
    values = leading_eigenvalues(diagonal, off, min(many, len(matrix)))
    vectors = eigenvectors(diagonal, off, values)
    kept = values > 64 * len(matrix) * _EPS * max(values[0], 0.0)
    out = [reflected_back(reflections, v) for v in vectors[kept]]
    return values[kept] * scale, np.array([v / np.linalg.norm(v) for v in out])


class _Centre:
    """Exact centring: n x - S of blocks of vectors."""

    def __init__(self, n: int, sums: list[int]) -> None:
        self.n, self.near = n, np.array([s // n for s in sums], np.int64)
        self.rest = np.array([s % n for s in sums], np.int64)

    def deviations(self, x: np.ndarray) -> np.ndarray:
        shifted = x - self.near
        if len(x) and (int(np.abs(shifted).max()) + 1) * self.n >= 1 << 62:
            raise OverflowError("centred vectors do not fit in 64 bits")
        return shifted * self.n - self.rest

    def squares(self, deviations: np.ndarray) -> np.ndarray:
        """Exact sums of squares; what does not fit in 64 bits is an error."""
        top = int(np.abs(deviations).max(initial=0))
        if top * top * deviations.shape[1] < 1 << 63:
            return (deviations**2).sum(axis=1)
        return np.array([sum(v * v for v in row) for row in deviations.tolist()], np.int64)


def _vectors(batch: pa.RecordBatch, column: int, dimensions: int) -> np.ndarray:
    return batch.column(column).flatten().to_numpy(zero_copy_only=False).reshape(-1, dimensions)


def _second_moments(fitted: DataFrame, n: int, dimensions: int, made) -> np.ndarray:
    """Sum of made(x) made(x)^T over all vectors of ``fitted(x)``, over n; made gives blocks of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                block = made(_vectors(batch, 0, dimensions))
                product = block.T @ block
                total = product if total is None else total + product
        if total is not None:
            upper = np.triu_indices(len(total))
            at = (upper[0] * len(total) + upper[1]).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[upper])], ["at", "value"])

    sums = map_batches(fitted, run, "at bigint, value double").groupBy("at").agg(F.sum("value").alias("value"))
    found = sums.toArrow()  # half the matrix, whatever the table
    at, value = found["at"].to_numpy(), found["value"].to_numpy()
    side = int((np.sqrt(8 * len(at) + 1) - 1) / 2)
    out = np.zeros((side, side))
    out[at // side, at % side] = value / n
    return out + np.triu(out, 1).T


def whiten(rows: DataFrame, *, components: int = 16, scale: int = 64, offset: int = 1_000_000) -> DataFrame:
    """``RESULT`` of every usable row of ``rows(vec_id, embedding)`` and every component.

    ``deviation`` is the exact sum of (n x - S)^2, ``whitened`` the projection, ``explained``
    the component's share of the variance, ``identity_error`` the largest entry of the
    covariance of the whitened fit list less the identity, measured in a pass of its own.
    """
    spark = rows.sparkSession
    vector = F.col("embedding").cast("array<double>")
    kept = rows.select(F.col("vec_id").cast("bigint").alias("vec_id"), vector.alias("c")).filter(usable(F.col("c")) & (F.size("c") > 0))
    usual = kept.groupBy(F.size("c").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    if usual is None:
        return spark.createDataFrame([], RESULT)
    dimensions = usual["size"]
    whole = F.transform("c", lambda v: F.floor(v * F.lit(float(scale))) + offset)
    kept = kept.filter(F.size("c") == dimensions).select("vec_id", whole.alias("x"))
    fitted = staged(kept.select("x").distinct())
    totals = fitted.agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col("x")[j]).alias(f"s{j}") for j in range(dimensions)]).first()
    n = totals["n"]
    centre = _Centre(n, [totals[f"s{j}"] for j in range(dimensions)])
    covariance = _second_moments(fitted, n, dimensions, lambda x: centre.deviations(x) / n)
    values, vectors = leading_components(covariance, components)
    if not len(values):
        return spark.createDataFrame([], RESULT)
    projection = (vectors / np.sqrt(values)[:, None]).T
    check = _second_moments(fitted, n, dimensions, lambda x: (centre.deviations(x) / n) @ projection)
    error = float(np.abs(check - np.eye(len(values))).max())
    explained = values / np.trace(covariance)
    shared = spark.sparkContext.broadcast((centre, projection, explained))  # dimensions x components numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, projection, explained = shared.value
        many = len(explained)
        for batch in batches:
            if not batch.num_rows:
                continue
            deviations = centre.deviations(_vectors(batch, 1, dimensions))
            whitened = (deviations / n) @ projection
            rows_in = len(deviations)
            of = pa.array(np.repeat(np.arange(rows_in), many))
            columns = [
                batch.column(0).take(of),
                pa.array(np.tile(np.arange(1, many + 1, dtype=np.int32), rows_in)),
                pa.array(np.full(rows_in * many, n, np.int64)),
                pa.array(np.repeat(centre.squares(deviations), many)),
                pa.array(whitened.ravel()),
                pa.array(np.tile(explained, rows_in)),
                pa.array(np.full(rows_in * many, error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return map_batches(kept, run, RESULT)
