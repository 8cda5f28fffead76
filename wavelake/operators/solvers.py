"""Solvers of normal equations."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def truncated(a: np.ndarray, b: np.ndarray, ridge: float = 0.0, share: float | None = None) -> np.ndarray:
    """Solve a x = b by singular values: with ridge on all, or with those kept whose cumulative share stays below share, and one more."""
    u, s, v = np.linalg.svd(a, hermitian=True)
    if share is not None:
        n = min(len(s), int((np.cumsum(s) / s.sum() < share).sum()) + 1)
        return v[:n].T @ ((u[:, :n].T @ b) / s[:n])
    return v.T @ ((u.T @ b) / (s + ridge))


def incomplete_cholesky(a: np.ndarray) -> np.ndarray:
    """Lower factor with a's own pattern of zeros."""
    low = np.tril(a).astype(float)
    for k in range(len(a)):
        low[k, k] = np.sqrt(max(low[k, k], np.finfo(float).tiny))
        below = np.flatnonzero(low[k + 1 :, k]) + k + 1
        low[below, k] /= low[k, k]
        for j in below:
            rows = np.flatnonzero(low[j:, j]) + j
            low[rows, j] -= low[rows, k] * low[j, k]
    return low


def conjugate_gradient(product, b: np.ndarray, tol: float = 1e-10, most: int = 1000, ridge: float = 0.0, precondition=None) -> np.ndarray:
    """Solve (A + ridge I) x = b by products with A only; precondition maps a residual to a direction."""
    precondition = precondition or (lambda r: r)
    x = np.zeros_like(b, dtype=float)
    r = b - product(x) - ridge * x
    z = precondition(r)
    p, rz = z.copy(), float(r @ z)
    for _ in range(most):
        if np.linalg.norm(r) <= tol * max(np.linalg.norm(b), 1e-300):
            break
        ap = product(p) + ridge * p
        step = rz / float(p @ ap)
        x, r = x + step * p, r - step * ap
        z = precondition(r)
        new = float(r @ z)
        p, rz = z + new / rz * p, new
    return x


def jacobi(diagonal: np.ndarray):
    return lambda r: r / diagonal


def normal_product(df: DataFrame, columns: list[str]):
    """p -> X'(X p), one aggregation over the data: for designs too wide for a Gram matrix on the driver."""

    def product(p: np.ndarray) -> np.ndarray:
        inner = F.lit(0.0)
        for v, c in zip(p, columns, strict=True):
            inner = inner + F.lit(float(v)) * F.col(c)
        row = df.withColumn("__xp", inner).agg(*[F.sum(F.col(c) * F.col("__xp")).alias(f"s{i}") for i, c in enumerate(columns)]).first()
        return np.array([v or 0.0 for v in row])

    return product
