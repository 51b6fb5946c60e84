"""Whitening of embeddings by Chebyshev-filtered subspace iteration.

Vectors become integers, each different one counts once in the fit. The covariance matrix is never
built: a pass over the vectors gives V Q = (1/n) sum of c (c' Q) for the centred vectors c and a thin
matrix Q, one partial sum per task, added up by Spark. Of a spectrum the leading part is wanted; the
other eigenvalues lie between 0 and the smallest Ritz value of the subspace. A Chebyshev polynomial
of V, applied by its three-term recurrence with one pass per degree, stays within 1 on that
interval and grows quickly above it. QR makes the filtered block orthonormal, and Rayleigh-Ritz with one more
pass gives values, vectors and their residuals. That is repeated until the residuals are at the
rounding error of the passes, or no longer fall; they bound the error of every eigenvalue, and divided
by the distance to the next one that of the vectors.

Sums over the vectors are exact integers. A centred component is its integer distance to the whole
part of the mean, less the mean's fraction, so large means cost no digits.

Defined cases: rows with a null or empty vector, a null, NaN or infinite component take no part.
Vectors must have one length, and scaled components must fit into 64 bits; else the job fails. Where
there are fewer dimensions than components, there are fewer components. A component without variance
has null ``whitened``; of a set without variance ``explained`` is null. ``identity_error`` is over the
components with variance, 0 if there are none. An empty table gives no rows. Repeated rows and null ids
are rows like others. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from odqa_spark.llm.frames import materialize

SCALE = 256
COMPONENTS = 4
#: Columns of Q for each wanted component, and the degree of the filter.
BLOCK = 8
DEGREE = 8
MAX_ROUNDS = 60
#: Residual, relative to the largest eigenvalue, at which the vectors are as exact as the passes.
RESIDUAL = 1e-14
_LIMIT = float(1 << 63)


@dataclass
class Whitening:
    """Number and sums of the fitted vectors, leading eigenpairs, and how exact they are."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    residual: float
    passes: int
    identity_error: float = 0.0

    def scaled(self) -> np.ndarray:
        """Vectors divided by the root of their eigenvalue; NaN for one without variance."""
        return self.vectors / np.sqrt(np.where(self.values > 0, self.values, np.nan))


def usable(vector: str) -> Column:
    """Whether the vector has components and all are finite numbers."""
    finite = lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf"))
    return F.coalesce(F.forall(vector, finite), F.lit(False)) & (F.size(vector) > 0)


def whole_numbers(vector: str, scale: int = SCALE) -> Column:
    """floor(scale * component) of every component as a long."""

    def one(c: Column) -> Column:
        y = c.cast("double") * F.lit(float(scale))
        return F.when(F.abs(y) < _LIMIT, F.floor(y)).otherwise(F.raise_error(F.lit("a scaled component is beyond 64 bits")).cast("bigint"))

    return F.transform(vector, one)


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(flat) != len(column) * d or set(np.diff(column.offsets.to_numpy())) - {d}:
        raise ValueError(f"vectors of one length, {d}, are expected")
    return flat.reshape(len(column), d)


def _sums(fit: DataFrame, d: int) -> tuple[int, list[int]]:
    """Number of vectors and exact sum of each dimension."""
    high, low = 1 << 32, (1 << 32) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, upper, lower = 0, [0] * d, [0] * d
        for batch in batches:
            x = _matrix(batch.column(0), d)
            n += len(x)
            upper = [a + int(b) for a, b in zip(upper, (x >> 32).sum(axis=0))]
            lower = [a + int(b) for a, b in zip(lower, (x & low).sum(axis=0))]
        if n:
            values = [n, *upper, *lower]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(values)), pa.int32()), pa.array([str(v) for v in values])], ["i", "v"])

    rows = fit.mapInArrow(run, "i int, v string").groupBy("i").agg(F.sum(F.col("v").cast("decimal(38,0)")).cast("string").alias("v")).collect()
    found = {r["i"]: int(r["v"]) for r in rows}
    n = found.get(0, 0)
    return n, [found.get(1 + i, 0) * high + found.get(1 + d + i, 0) for i in range(d)]


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    whole = [s // n for s in sums]
    rest = np.array([(s - w * n) / n for s, w in zip(sums, whole)])
    if all(abs(w) < 1 << 62 for w in whole) and np.abs(x, dtype=np.float64).max(initial=0.0) < 2.0**62:
        return (x - np.array(whole, np.int64)).astype(np.float64) - rest
    return np.array([[float(int(v) - w) for v, w in zip(row, whole)] for row in x]).reshape(x.shape) - rest


def _summed(fit: DataFrame, d: int, shape: tuple[int, int], part: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all vectors of a matrix that each block of vectors gives."""
    rows = shape[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        some = False
        for batch in batches:
            x = _matrix(batch.column(0), d)
            for at in range(0, len(x), 4096):
                total += part(x[at : at + 4096])
                some = True
        if some:
            yield pa.RecordBatch.from_arrays([pa.array(range(rows), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], ["i", "y"])

    entries = fit.mapInArrow(run, "i int, y array<double>").selectExpr("i", "posexplode(y) AS (j, v)")
    found = entries.groupBy("i", "j").agg(F.sum("v").alias("v")).toArrow()
    out = np.zeros(shape)
    out[found.column("i").to_numpy(), found.column("j").to_numpy()] = found.column("v").to_numpy()
    return out


def fit_whitening(vectors: DataFrame, vector: str, k: int = COMPONENTS, degree: int = DEGREE, block: int = BLOCK) -> Whitening | None:
    """The leading ``k`` eigenpairs of the covariance of the different integer vectors; None without any vector."""
    fit = materialize(vectors.select(F.col(vector).alias("x")).groupBy("x").agg(F.lit(1).alias("one")).select("x"), "whitening-fit")
    head = fit.select(F.size("x").alias("d")).head()
    if head is None:
        return None
    d = head["d"]
    n, sums = _sums(fit, d)
    k = min(k, d)
    width = min(d, max(block * k, k + 1))
    passes = 0

    def product(q: np.ndarray) -> np.ndarray:
        """V Q, and in a last row the trace of V."""
        nonlocal passes
        passes += 1

        def part(x: np.ndarray) -> np.ndarray:
            c = _centred(x, n, sums)
            return np.vstack([c.T @ (c @ q), np.full((1, q.shape[1]), (c**2).sum())])

        return _summed(fit, d, (d + 1, q.shape[1]), part) / n

    q = np.linalg.qr(np.random.default_rng(42).standard_normal((d, width)))[0]
    last = np.inf
    stalled = 0
    for _ in range(MAX_ROUNDS):
        vq = product(q)
        vq, trace = vq[:-1], float(vq[-1, 0])
        h = q.T @ vq
        theta, s = np.linalg.eigh((h + h.T) / 2)
        theta, s = theta[::-1], s[:, ::-1]
        q, vq = q @ s, vq @ s
        residual = float(np.linalg.norm(vq[:, :k] - q[:, :k] * theta[:k], axis=0).max())
        top = max(float(theta[0]), 0.0)
        stalled = stalled + 1 if residual > 0.5 * last else 0
        if top == 0.0 or width == d and passes > 1 or residual <= RESIDUAL * top or stalled >= 2 and residual <= 1e-9 * top:
            break
        last = min(last, residual)
        if width == d:
            continue
        # on [0, cut] the polynomial stays within 1; it is scaled to 1 at the largest value
        cut = max(float(theta[-1]), 1e-3 * top)
        e = c = cut / 2
        sigma = e / (top - c) if top > cut else 0.5
        tau = 2 / sigma
        before, now = q, (vq - c * q) * (sigma / e)
        for _ in range(degree - 1):
            following = 1 / (tau - sigma)
            before, now = now, (2 * following / e) * (product(now)[:-1] - c * now) - sigma * following * before
            sigma = following
        q = np.linalg.qr(now)[0]
    else:
        raise RuntimeError(f"residual {residual} after {passes} passes")
    values = np.where(theta[:k] > d * np.finfo(float).eps * top, theta[:k], 0.0)
    model = Whitening(n, sums, values, q[:, :k], trace, residual, passes)
    model.identity_error = _identity_error(fit, d, model)
    return model


def _identity_error(fit: DataFrame, d: int, model: Whitening) -> float:
    """Largest entry of the covariance of the whitened vectors less the identity."""
    w = model.scaled()[:, model.values > 0]
    k = w.shape[1]
    if not k:
        return 0.0
    n, sums = model.n, model.sums
    mean = _summed(fit, d, (1, k), lambda x: (_centred(x, n, sums) @ w).sum(axis=0, keepdims=True)) / n

    def part(x: np.ndarray) -> np.ndarray:
        y = _centred(x, n, sums) @ w - mean
        return y.T @ y

    return float(np.abs(_summed(fit, d, (k, k), part) / n - np.eye(k)).max())


def _deviation(x: np.ndarray, n: int, sums: list[int]) -> list[int]:
    """Sum over dimensions of (n x - S)^2, exact."""
    far = max(n * float(np.abs(x, dtype=np.float64).max(initial=0.0)), max(abs(float(s)) for s in sums)) * 2
    if far**2 * x.shape[1] < 2.0**62:
        return ((n * x - np.array(sums, np.int64)) ** 2).sum(axis=1).tolist()
    return [sum((n * int(v) - s) ** 2 for v, s in zip(row, sums)) for row in x]


def whitened(vectors: DataFrame, vector: str, id_col: str, model: Whitening | None) -> DataFrame:
    """(id_col, component, n, deviation, whitened, explained, identity_error) of every row and component."""
    kind = vectors.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    if model is None:
        return vectors.sparkSession.createDataFrame([], schema)
    d, k = model.vectors.shape
    n, sums, w, error = model.n, model.sums, model.scaled(), model.identity_error
    explained = model.values / model.trace if model.trace > 0 else np.full(k, np.nan)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                x = _matrix(part.column(1), d)
                y = _centred(x, n, sums) @ w
                m = len(x)
                each = np.repeat(np.arange(m), k)
                number = lambda v: pa.array(v, pa.float64(), from_pandas=True)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                        pa.array(np.full(m * k, n, np.int64)), pa.array([v for v in _deviation(x, n, sums) for _ in range(k)], pa.int64()),
                        number(y.ravel()), number(np.tile(explained, m)), number(np.full(m * k, error)),
                    ],
                    [id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return vectors.select(id_col, vector).mapInArrow(run, schema)


def whiten(rows: DataFrame, id_col: str = "vec_id", vector: str = "embedding", k: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """``whitened`` of all rows with a usable vector, by the ``k`` leading components of the different vectors."""
    whole = rows.where(usable(vector)).select(id_col, whole_numbers(vector, scale).alias("x"))
    return whitened(whole, "x", id_col, fit_whitening(whole, "x", k))
