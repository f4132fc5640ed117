"""Small dense matrices in Arrow batches: one K x D block of vectors per row.

Spark pools, groups and bounds the blocks; these helpers only do the arithmetic of one
bounded block. Rows of equal shape in a batch are handled by one stacked numpy call.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F


def _blocks(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, stacked blocks n x k x d) for every block shape in the batch."""
    inner = column.flatten()
    values = inner.flatten().to_numpy(zero_copy_only=False)
    outer_at = column.offsets.to_numpy() - column.offsets[0].as_py()
    inner_at = inner.offsets.to_numpy() - inner.offsets[0].as_py()
    k = np.diff(outer_at)
    start = inner_at[outer_at[:-1]]
    size = inner_at[outer_at[1:]] - start
    d = size // np.maximum(k, 1)
    shapes = np.stack([k, d], axis=1)
    for kk, dd in np.unique(shapes, axis=0):
        rows = np.flatnonzero((k == kk) & (d == dd))
        if np.any(size[rows] != kk * dd):
            raise ValueError("vectors of one group differ in length")
        yield rows, np.stack([values[s : s + kk * dd].reshape(kk, dd) for s in start[rows]])


def _row_centred(x: np.ndarray) -> np.ndarray:
    """Each vector minus its own mean, scaled so that x xᵀ is the covariance of rows."""
    return (x - x.mean(axis=2, keepdims=True)) / np.sqrt(x.shape[2] - 1)


def _column_centred(x: np.ndarray) -> np.ndarray:
    """Each dimension minus its mean over vectors, scaled so that xᵀ x is their covariance."""
    return (x - x.mean(axis=1, keepdims=True)) / np.sqrt(x.shape[1] - 1)


def _smaller_gram(x: np.ndarray) -> np.ndarray:
    """x xᵀ or xᵀ x, whichever is smaller; both share their non-zero eigenvalues."""
    t = x.transpose(0, 2, 1)
    return x @ t if x.shape[1] <= x.shape[2] else t @ x


def _scalar_udf(compute):
    @F.arrow_udf("double")
    def run(vectors: pa.Array) -> pa.Array:
        out = np.full(len(vectors), np.nan)
        for rows, x in _blocks(vectors):
            out[rows] = compute(x)
        return pa.array(out, from_pandas=True)

    return run


def log10_det_padded(gram: np.ndarray, full: int, ridge: float) -> np.ndarray:
    """log10 det of a full x full matrix whose non-zero eigenvalues are those of ``gram``."""
    m = gram.shape[-1]
    _, ld = np.linalg.slogdet(gram + ridge * np.eye(m))
    return ld / np.log(10.0) + (full - m) * np.log10(ridge)


@lru_cache(maxsize=None)
def generation_log_det(ridge: float):
    """array of K vectors -> log10 det(C + ridge·I), C = K x K covariance of generations."""

    def compute(x):
        return log10_det_padded(_smaller_gram(_row_centred(x)), x.shape[1], ridge)

    return _scalar_udf(compute)


@lru_cache(maxsize=None)
def feature_log_det(ridge: float):
    """array of K vectors -> log10 det(C + ridge·I), C = D x D covariance of dimensions."""

    def compute(x):
        if x.shape[1] < 2:
            return np.nan
        return log10_det_padded(_smaller_gram(_column_centred(x)), x.shape[2], ridge)

    return _scalar_udf(compute)


@lru_cache(maxsize=None)
def generation_spectrum(ridge: float):
    """array of K vectors -> the K eigenvalues of C + ridge·I, largest first."""

    @F.arrow_udf("array<double>")
    def run(vectors: pa.Array) -> pa.Array:
        out: list = [None] * len(vectors)
        for rows, x in _blocks(vectors):
            g = _smaller_gram(_row_centred(x))
            eig = np.linalg.eigvalsh(g)[:, ::-1].clip(min=0.0) + ridge
            missing = x.shape[1] - eig.shape[1]
            full = np.pad(eig, ((0, 0), (0, missing)), constant_values=ridge)
            for r, e in zip(rows, full):
                out[r] = e
        return pa.array(out, pa.list_(pa.float64()))

    return run


@lru_cache(maxsize=None)
def cross_covariance():
    """two arrays of vectors -> the block of covariances between their generations."""

    @F.arrow_udf("array<array<double>>")
    def run(left: pa.Array, right: pa.Array) -> pa.Array:
        a = {r: m for rows, x in _blocks(left) for r, m in zip(rows, _row_centred(x))}
        b = {r: m for rows, x in _blocks(right) for r, m in zip(rows, _row_centred(x))}
        return pa.array([(a[i] @ b[i].T).tolist() for i in range(len(left))], pa.list_(pa.list_(pa.float64())))

    return run


@lru_cache(maxsize=None)
def gaussian_loglik(ridge: float):
    """(array of K vectors, one vector) -> -Mahalanobis² - ln det of the D x D covariance + ridge·I."""

    @F.arrow_udf("double")
    def run(vectors: pa.Array, point: pa.Array) -> pa.Array:
        points = point.to_pylist()
        out = np.full(len(vectors), np.nan)
        for rows, x in _blocks(vectors):
            if x.shape[1] < 2:
                continue
            mean = x.mean(axis=1)
            z = _column_centred(x)
            for r, zr, mr in zip(rows, z, mean):
                if points[r] is None:
                    continue
                out[r] = loglik_from_factor(zr, np.asarray(points[r]) - mr, ridge)
        return pa.array(out, from_pandas=True)

    return run


def loglik_from_factor(z: np.ndarray, y: np.ndarray, ridge: float) -> float:
    """-(yᵀ(zᵀz + ridge·I)⁻¹y) - ln det(zᵀz + ridge·I), through the smaller Gram matrix."""
    k, d = z.shape
    if d <= k:
        c = z.T @ z + ridge * np.eye(d)
        return float(-(y @ np.linalg.solve(c, y)) - np.linalg.slogdet(c)[1])
    g = z @ z.T + ridge * np.eye(k)
    zy = z @ y
    distance = (y @ y - zy @ np.linalg.solve(g, zy)) / ridge
    return float(-distance - np.linalg.slogdet(g)[1] - (d - k) * np.log(ridge))


# --- moments: what a sample with very many generations is reduced to ---------------


@lru_cache(maxsize=None)
def block_moments(centre_rows: bool):
    """array of vectors -> [n, Σx (D), Σxxᵀ (D·D)] as one flat array; sums over blocks add up."""

    @F.arrow_udf("array<double>")
    def run(vectors: pa.Array) -> pa.Array:
        out: list = [None] * len(vectors)
        for rows, x in _blocks(vectors):
            if centre_rows:
                x = _row_centred(x)
            total = x.sum(axis=1)
            square = x.transpose(0, 2, 1) @ x
            for r, s, q in zip(rows, total, square):
                out[r] = np.concatenate([[x.shape[1]], s, q.ravel()])
        return pa.array(out, pa.list_(pa.float64()))

    return run


def _split_moments(flat: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    d = int((-1 + np.sqrt(4 * len(flat) - 3)) / 2 + 0.5)
    return flat[0], flat[1 : d + 1], flat[d + 1 :].reshape(d, d)


def _feature_covariance(flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n, s, q = _split_moments(flat)
    mean = s / n
    return mean, (q - n * np.outer(mean, mean)) / (n - 1)


def _moment_udf(compute, returns="double"):
    @F.arrow_udf(returns)
    def run(moments: pa.Array) -> pa.Array:
        return pa.array([compute(np.asarray(m)) for m in moments.to_pylist()], _ARROW[returns])

    return run


_ARROW = {"double": pa.float64(), "array<double>": pa.list_(pa.float64())}


@lru_cache(maxsize=None)
def generation_log_det_from_moments(ridge: float):
    def compute(flat):
        n, _, q = _split_moments(flat)
        return float(log10_det_padded(q, int(n), ridge))

    return _moment_udf(compute)


@lru_cache(maxsize=None)
def generation_spectrum_from_moments(ridge: float):
    def compute(flat):
        n, _, q = _split_moments(flat)
        eig = np.linalg.eigvalsh(q)[::-1].clip(min=0.0)[: int(n)] + ridge
        return np.pad(eig, (0, int(n) - len(eig)), constant_values=ridge)

    return _moment_udf(compute, "array<double>")


@lru_cache(maxsize=None)
def feature_log_det_from_moments(ridge: float):
    def compute(flat):
        _, cov = _feature_covariance(flat)
        return float(log10_det_padded(cov, len(cov), ridge))

    return _moment_udf(compute)


@lru_cache(maxsize=None)
def gaussian_loglik_from_moments(ridge: float):
    @F.arrow_udf("double")
    def run(moments: pa.Array, point: pa.Array) -> pa.Array:
        def one(flat, p):
            if p is None:
                return None
            mean, cov = _feature_covariance(np.asarray(flat))
            c = cov + ridge * np.eye(len(cov))
            y = np.asarray(p) - mean
            return float(-(y @ np.linalg.solve(c, y)) - np.linalg.slogdet(c)[1])

        return pa.array([one(f, p) for f, p in zip(moments.to_pylist(), point.to_pylist())], pa.float64())

    return run
