"""Autoregressive models and Granger causality."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .gram import gram_matrix, ridge
from .lags import design_lags, lag_name


def ar_sums(df: DataFrame, column: str, p: int, key: list[str], order: list[str], by: list[str]) -> DataFrame:
    """Per group: an array column g with the (p + 1) x (p + 1) sums of products of lags 1..p and the value itself."""
    data = design_lags(df, [column], p, key, order).filter(F.col(column).isNotNull())
    names = [lag_name(column, k) for k in range(1, p + 1)] + [column]
    return data.groupBy(*by).agg(F.array(*[F.sum(F.col(a) * F.col(b)) for a in names for b in names]).alias("g"))


def fit_ar(df: DataFrame, column: str, p: int, key: list[str], order: list[str], by: list[str] | None = None) -> DataFrame:
    """(by, lag, coef) of x[t] on x[t-1..t-p] without intercept, one model a group: the sums are SQL, the p x p solves run where their group is."""
    by = by or key
    sums = ar_sums(df, column, p, key, order, by)
    kinds = dict(df.dtypes)

    def solve(batches):
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                g = np.array(r.g, float).reshape(p + 1, p + 1)
                coef = ridge(g, list(range(p)), [p], [0.0])[0, :, 0]
                rows += [(*[getattr(r, b) for b in by], k + 1, float(c)) for k, c in enumerate(coef)]
            yield type(pdf)(rows, columns=[*by, "lag", "coef"])

    return sums.mapInPandas(solve, ", ".join([*[f"{b} {kinds[b]}" for b in by], "lag int", "coef double"]))


def fit_var(df: DataFrame, columns: list[str], p: int, key: list[str], order: list[str]) -> DataFrame:
    """(lag, source, target, coef) of all channels on lags 1..p of all channels, without intercept."""
    names = [(k, c, lag_name(c, k)) for k in range(1, p + 1) for c in columns]
    g = gram_matrix(design_lags(df, columns, p, key, order), [*[n for _, _, n in names], *columns])
    q = len(names)
    beta = ridge(g, list(range(q)), list(range(q, q + len(columns))), [0.0])[0]
    rows = [(k, c, t, float(beta[i, m])) for i, (k, c, _) in enumerate(names) for m, t in enumerate(columns)]
    return df.sparkSession.createDataFrame(rows, "lag int, source string, target string, coef double")


def granger(df: DataFrame, columns: list[str], p: int, key: list[str], order: list[str]) -> DataFrame:
    """(source, target, value): log of the residual variance of the target's own model over that with all channels; 0 on the diagonal.

    As in the usual multivariate form the value depends on the target only: all others -> target."""
    lagged = [(k, c, lag_name(c, k)) for k in range(1, p + 1) for c in columns]
    data = design_lags(df, columns, p, key, order).withColumn("__one", F.lit(1.0))
    names = [*[n for _, _, n in lagged], *columns, "__one"]
    g = gram_matrix(data, names)
    q, n = len(lagged), g[-1, -1]
    rows = []
    for m, target in enumerate(columns):
        own = [i for i, (_, c, _) in enumerate(lagged) if c == target]
        variance = []
        for xs in (own, list(range(q))):
            beta = np.zeros(len(names))
            beta[xs] = -ridge(g, xs, [q + m], [0.0])[0, :, 0]
            beta[q + m] = 1.0
            mean = beta @ g[:, -1] / n
            variance.append(beta @ g @ beta / n - mean**2)
        rows += [(s, target, 0.0 if s == target else float(np.log(variance[0] / variance[1]))) for s in columns]
    return df.sparkSession.createDataFrame(rows, "source string, target string, value double")


def log_likelihood(df: DataFrame, truth: str, guess: str, by: list[str]) -> DataFrame:
    """Gaussian log-likelihood of one channel's residuals with their own population variance."""
    r = F.col(truth) - F.col(guess)
    n, v = F.count(r), F.var_pop(r)
    return df.groupBy(*by).agg((-n / 2 * F.log(2 * np.pi * v) - F.sum(r * r) / (2 * v)).alias("log_likelihood"))
