"""Covariances and what follows from them: whitening, filters, canonical correlation."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import generalised_eigh, positive_definite, signed
from .gram import SQL_MOST, gram_groups, gram_matrix
from .lags import lag_features, lag_name


def unpacked(df: DataFrame, vector: str, dims: int, prefix: str = "c") -> DataFrame:
    """Columns prefix0.. of an array's first dims entries, as doubles."""
    return df.select("*", *[F.col(vector)[i].cast("double").alias(f"{prefix}{i}") for i in range(dims)])


def covariance(df: DataFrame, columns: list[str], by: list[str] | None = None, estimator: str | Callable[[np.ndarray], np.ndarray] = "cov") -> DataFrame:
    """Long table (by, i, j, v), i <= j. cov: sample covariance; scm: mean products without centring; pop: population; corr: correlation;
    lwf, oas: shrunk to the mean variance by closed forms; one aggregation each, or with many columns partial Gram matrices. mcd: fast minimum covariance determinant (exact for one column), on pandas groups; so is a function of a group's rows x columns."""
    by = by or []
    if callable(estimator):
        return _by_group(df, columns, by, estimator)
    if estimator in ("lwf", "oas"):
        return _shrunk(df, columns, by, estimator)
    if estimator == "mcd":
        return _mcd(df, columns, by)
    if len(columns) > SQL_MOST:
        return _from_grams(df, columns, by, estimator)
    agg = {"cov": F.covar_samp, "pop": F.covar_pop, "corr": F.corr, "scm": lambda a, b: F.avg(F.col(a) * F.col(b))}[estimator]
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    sums = df.groupBy(*by).agg(*[agg(columns[i], columns[j]).alias(f"__{i}_{j}") for i, j in pairs])
    items = F.array(*[F.struct(F.lit(columns[i]).alias("i"), F.lit(columns[j]).alias("j"), F.col(f"__{i}_{j}").alias("v")) for i, j in pairs])
    return sums.select(*by, F.explode(items).alias("__p")).select(*by, "__p.i", "__p.j", "__p.v")


def _from_grams(df: DataFrame, columns: list[str], by: list[str], estimator: str) -> DataFrame:
    """The same from each group's Gram matrix with a column of ones; rows with a missing value are left out."""
    kinds, p = dict(df.dtypes), len(columns)
    grams = gram_groups(df.na.drop(subset=columns).withColumns({"__one": F.lit(1.0), "__all": F.lit(0)}), [*columns, "__one"], ["__all", *by])

    def run(pdf):
        g = np.array(pdf["gram"].iloc[0], float).reshape(p + 1, p + 1)
        n, mean = g[-1, -1], g[-1, :-1] / g[-1, -1]
        c = g[:-1, :-1] / n - (0 if estimator == "scm" else np.outer(mean, mean))
        if estimator == "cov":
            c = c * n / (n - 1) if n > 1 else c * np.nan
        elif estimator == "corr":
            c = c / np.sqrt(np.outer(np.diag(c), np.diag(c)))
        i, j = np.triu_indices(p)
        out = type(pdf)({"i": [columns[k] for k in i], "j": [columns[k] for k in j], "v": c[i, j]})
        for b in by:
            out[b] = pdf[b].iloc[0]
        return out[[*by, "i", "j", "v"]]

    return grams.groupBy("__all", *by).applyInPandas(run, ", ".join([*[f"{b} {kinds[b]}" for b in by], "i string", "j string", "v double"]))


def _total(columns: list[Column]) -> Column:
    out = columns[0]
    for c in columns[1:]:
        out = out + c
    return out


def _shrunk(df: DataFrame, columns: list[str], by: list[str], estimator: str) -> DataFrame:
    p = len(columns)
    mean = df.groupBy(*by).agg(*[F.avg(c).alias(f"__m{i}") for i, c in enumerate(columns)])
    if not by:
        df, mean, by = df.withColumn("__all", F.lit(0)), mean.withColumn("__all", F.lit(0)), ["__all"]
    data = df.join(mean, by)
    x = [F.col(c) - F.col(f"__m{i}") for i, c in enumerate(columns)]
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    norm = _total([v * v for v in x])
    s = data.groupBy(*by).agg(F.count(F.lit(1)).cast("double").alias("n"), F.avg(norm * norm).alias("q"), *[F.avg(x[i] * x[j]).alias(f"s{i}_{j}") for i, j in pairs])
    trace = _total([F.col(f"s{i}_{i}") for i in range(p)])
    square = _total([F.col(f"s{i}_{j}") * F.col(f"s{i}_{j}") * (1 if i == j else 2) for i, j in pairs])
    mu = trace / p
    if estimator == "oas":
        alpha = square / (p * p)
        top, low = alpha + mu * mu, (F.col("n") + 1) * (alpha - mu * mu / p)
        shrink = F.when(low == 0, F.lit(1.0)).otherwise(F.least(top / low, F.lit(1.0)))
    else:
        delta = (square - mu * mu * p) / p
        beta = (F.col("q") - square) / (F.col("n") * p)
        shrink = F.when(delta == 0, F.lit(0.0)).otherwise(F.least(beta, delta) / delta)
    s = s.withColumn("__mu", mu).withColumn("__k", shrink)
    item = lambda i, j: F.struct(F.lit(columns[i]).alias("i"), F.lit(columns[j]).alias("j"), ((1 - F.col("__k")) * F.col(f"s{i}_{j}") + (F.col("__k") * F.col("__mu") if i == j else F.lit(0.0))).alias("v"))
    return s.select(*by, F.explode(F.array(*[item(i, j) for i, j in pairs])).alias("__p")).select(*by, "__p.i", "__p.j", "__p.v").drop("__all")


def _by_group(df: DataFrame, columns: list[str], by: list[str], matrix: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """The long table of a p x p matrix of each group's rows; a group is one task."""
    kinds, p = dict(df.dtypes), len(columns)
    if not by:
        df, by, kinds = df.withColumn("__all", F.lit(0)), ["__all"], {"__all": "int"}

    def run(pdf):
        c = np.asarray(matrix(pdf[columns].to_numpy(float)), float)
        rows = [(*[pdf[b].iloc[0] for b in by], columns[i], columns[j], c[i, j]) for i in range(p) for j in range(i, p)]
        return type(pdf)(rows, columns=[*by, "i", "j", "v"])

    out = df.select(*by, *columns).groupBy(*by).applyInPandas(run, ", ".join([*[f"{b} {kinds[b]}" for b in by], "i string", "j string", "v double"]))
    return out.drop("__all")


def _mcd(df: DataFrame, columns: list[str], by: list[str], seed: int = 0) -> DataFrame:
    p = len(columns)

    def robust(x: np.ndarray) -> np.ndarray:
        n = len(x)
        h = (n + p + 1) // 2
        if p == 1:  # the best half is a run of the sorted values
            v = np.sort(x[:, 0])
            return min((v[a : a + h].var() for a in range(n - h + 1)), default=np.nan) * np.ones((1, 1))
        rng, best = np.random.default_rng(seed), (np.inf, None)
        for _ in range(30):
            pick = rng.choice(n, min(n, p + 1), replace=False)
            for _ in range(20):
                c = np.cov(x[pick], rowvar=False).reshape(p, p) + 1e-9 * np.eye(p)
                d = np.einsum("ij,jk,ik->i", x - x[pick].mean(0), np.linalg.inv(c), x - x[pick].mean(0))
                new = np.argsort(d, kind="stable")[:h]
                if set(new) == set(pick):
                    break
                pick = new
            det = np.linalg.slogdet(np.cov(x[pick], rowvar=False).reshape(p, p))[1]
            if det < best[0]:
                best = (det, pick)
        return np.cov(x[best[1]], rowvar=False, ddof=0).reshape(p, p)

    return _by_group(df, columns, by, robust)


def definite(table: DataFrame, by: list[str], shift: float = 0.0) -> DataFrame:
    """(by, definite): whether the matrix of a long table (by, i, j, v), less shift on the diagonal, is positive definite."""
    kinds = dict(table.dtypes)

    def run(pdf):
        names = sorted({*pdf["i"], *pdf["j"]})
        at = {c: k for k, c in enumerate(names)}
        m = np.zeros((len(names),) * 2)
        for i, j, v in zip(pdf["i"], pdf["j"], pdf["v"], strict=True):
            m[at[i], at[j]] = m[at[j], at[i]] = v
        return type(pdf)([(*[pdf[b].iloc[0] for b in by], positive_definite(m - shift * np.eye(len(names))))], columns=[*by, "definite"])

    return table.groupBy(*by).applyInPandas(run, ", ".join([*[f"{b} {kinds[b]}" for b in by], "definite boolean"]))


def moments(df: DataFrame, columns: list[str]) -> tuple[float, np.ndarray, np.ndarray]:
    """Rows, means and sums of centred products, from one Gram matrix."""
    g = gram_matrix(df.na.drop(subset=columns).withColumn("__one", F.lit(1.0)), [*columns, "__one"])
    n = g[-1, -1]
    mean = g[:-1, -1] / n
    return n, mean, g[:-1, :-1] - n * np.outer(mean, mean)


def project(df: DataFrame, columns: list[str], weights: np.ndarray, names: list[str], mean: np.ndarray | None = None) -> DataFrame:
    """df with the columns names = (columns - mean) @ weights, as expressions."""
    mean = np.zeros(len(columns)) if mean is None else mean
    new = [_total([F.lit(float(weights[i, k])) * (F.col(c) - F.lit(float(mean[i]))) for i, c in enumerate(columns)]).alias(n) for k, n in enumerate(names)]
    return df.select("*", *new)


class Whitener:
    """PCA or ZCA whitening: transform (x - mean) W', inverse by W's pseudo-inverse."""

    def __init__(self, kind: str = "pca", bias: bool = False):
        self.kind, self.bias = kind, bias

    def fit(self, df: DataFrame, columns: list[str]) -> Whitener:
        n, self.mean, s = moments(df, columns)
        value, vector = np.linalg.eigh(s / (n - (0 if self.bias else 1)))
        keep = value > value.max() * 1e-12
        value, vector = value[keep][::-1], signed(vector[:, keep][:, ::-1])
        self.columns, self.rotation = columns, (vector / np.sqrt(value)).T if self.kind == "pca" else (vector / np.sqrt(value)) @ vector.T
        return self

    def transform(self, df: DataFrame, prefix: str = "w") -> DataFrame:
        return project(df, self.columns, self.rotation.T, [f"{prefix}{i}" for i in range(len(self.rotation))], self.mean)

    def inverse(self, df: DataFrame, prefix: str = "w", out: str = "r") -> DataFrame:
        back = np.linalg.pinv(self.rotation).T
        df = project(df, [f"{prefix}{i}" for i in range(len(self.rotation))], back, [f"__{i}" for i in range(len(self.columns))])
        return df.select("*", *[(F.col(f"__{i}") + F.lit(float(self.mean[i]))).alias(f"{out}{i}") for i in range(len(self.columns))]).drop(*[f"__{i}" for i in range(len(self.columns))])


class ArtefactFilter:
    """Multichannel Wiener filter: x - x W with W = Sy^-1 Sd, Sd = Sy - Sc, or of low rank from the generalised eigenvectors with negative gains dropped.
    keep: None, a number of components, or a share of them."""

    def __init__(self, keep: float | int | None = None):
        self.keep = keep

    def fit(self, df: DataFrame, columns: list[str], artefact: Column) -> ArtefactFilter:
        covs = []
        for part in (df.filter(artefact), df.filter(~artefact)):
            n, _, s = moments(part, columns)
            covs.append(s / (n - 1))
        y, c = covs
        if self.keep is None:
            d = y - c
        else:
            value, vector = generalised_eigh(y, c)
            count = int(self.keep * len(columns)) if isinstance(self.keep, float) and self.keep < 1 else int(self.keep)
            gain = np.where(np.arange(len(value)) >= len(value) - count, np.maximum(value - 1, 0), 0)
            back = np.linalg.inv(vector)
            d = back.T @ np.diag(gain) @ back
        self.columns, self.weights = columns, np.linalg.solve(y, d)
        return self

    def transform(self, df: DataFrame, prefix: str = "clean") -> DataFrame:
        return project(df, self.columns, np.eye(len(self.columns)) - self.weights, [f"{prefix}{i}" for i in range(len(self.columns))])


def rank_for(value: np.ndarray, rule: str | None = None, amount: float = 0.0) -> int:
    """How many of the descending eigenvalues to keep: all above rounding, then by condition, count, share of variance or absolute size."""
    most = int((value > value[0] * len(value) * np.finfo(float).eps).sum())
    if rule is None:
        return most
    if rule == "cond":
        over = np.flatnonzero(value[0] / np.maximum(value, 1e-300) >= amount)
        n = int(over[0]) if len(over) else len(value)
    elif rule == "nKeep":
        n = int(amount)
    elif rule == "var":
        n = int(np.flatnonzero(np.cumsum(value) / value.sum() >= amount - 1e-15)[0]) + 1
    elif rule == "absTol":
        n = int((value > amount).sum())
    else:
        raise ValueError(rule)
    return min(most, n)


def reduced(g: np.ndarray, rule: str | None = None, amount: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """Leading eigenvectors and eigenvalues of a Gram matrix."""
    value, vector = np.linalg.eigh(g)
    value, vector = np.maximum(value[::-1], 0), vector[:, ::-1]
    n = rank_for(value, rule, amount)
    return vector[:, :n], value[:n]


def canonical(df: DataFrame, xs: list[str], ys: list[str], method: str = "svd", centre: bool = True, rule: str | None = None, amount: float = 0.0, share: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Canonical correlation from one joint Gram matrix: weights of x and of y, correlations in descending order.

    svd: singular values between whitened blocks, truncated by rule. nt: both blocks are sphered keeping components up to a cumulative share of variance,
    the joint matrix is diagonalised, correlations are its eigenvalues - 1.
    """
    if centre:
        _, _, g = moments(df, [*xs, *ys])
    else:
        g = gram_matrix(df, [*xs, *ys])
    p = len(xs)
    if method == "svd":
        (v, s), (u, o) = reduced(g[:p, :p], rule, amount), reduced(g[p:, p:], rule, amount)
        a, r, b = np.linalg.svd((v / np.sqrt(s)).T @ g[:p, p:] @ (u / np.sqrt(o)), full_matrices=False)
        return signed((v / np.sqrt(s)) @ a), signed((u / np.sqrt(o)) @ b.T), np.minimum(r, 1.0)
    rotations = []
    for block in (g[:p, :p], g[p:, p:]):
        value, vector = np.linalg.eigh(block)
        value, vector = value[::-1], vector[:, ::-1]
        value, vector = value[value > 0], vector[:, value > 0]
        keep = np.cumsum(value) / value.sum() <= share + 1e-12
        rotations.append(vector[:, keep] / np.sqrt(value[keep] ** (1 - 1e-12)))
    q = rotations[0].shape[1]
    w = np.zeros((len(g), q + rotations[1].shape[1]))
    w[:p, :q], w[p:, q:] = rotations
    value, vector = np.linalg.eigh(w.T @ g @ w)
    n = min(q, rotations[1].shape[1])
    value, vector = value[::-1][:n], vector[:, ::-1][:, :n]
    return rotations[0] @ vector[:q] * np.sqrt(2), rotations[1] @ vector[q:] * np.sqrt(2), value - 1


def activation(covariance_y: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Forward maps of backward weights."""
    return covariance_y @ weights @ np.linalg.inv(weights.T @ covariance_y @ weights)


def multiway(df: DataFrame, groups: list[list[str]], keep: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Canonical correlation of many datasets (columns of one table): each is whitened by PCA to keep components, their joint covariance is diagonalised.
    Gives each dataset's transform and the joint variances, descending; one Gram matrix serves all."""
    flat = [c for g in groups for c in g]
    n, _, s = moments(df, flat)
    s /= n - 1
    first, at = np.zeros((len(flat), 0)), 0
    for g in groups:
        value, vector = np.linalg.eigh(s[at : at + len(g), at : at + len(g)])
        value, vector = value[::-1][:keep], vector[:, ::-1][:, :keep]
        block = np.zeros((len(flat), len(value)))
        block[at : at + len(g)] = vector / np.sqrt(value)
        first, at = np.concatenate([first, block], axis=1), at + len(g)
    value, vector = np.linalg.eigh(first.T @ s @ first)
    value, vector = value[::-1], signed(vector[:, ::-1])
    out, at, col = [], 0, 0
    for g in groups:
        k = min(keep, len(g))
        out.append(first[at : at + len(g), col : col + k] @ vector[col : col + k])
        at, col = at + len(g), col + k
    return out, value


def denoiser(transform: np.ndarray, keep: int) -> np.ndarray:
    """Matrix that takes a dataset to its first keep components and back."""
    return transform[:, :keep] @ np.linalg.pinv(transform)[:keep]


def pca(df: DataFrame, columns: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Directions (columns) and variances, descending."""
    n, _, s = moments(df, columns)
    value, vector = np.linalg.eigh(s / (n - 1))
    return signed(vector[:, ::-1]), value[::-1]


def component_correlations(df: DataFrame, channels: list[str], components: list[str]) -> DataFrame:
    """(channel, component, r): correlation of every channel with every component, in one aggregation."""
    items = F.array(*[F.struct(F.lit(a).alias("channel"), F.lit(b).alias("component"), F.corr(a, b).alias("r")) for a in channels for b in components])
    return df.agg(items.alias("r")).select(F.explode("r").alias("r")).select("r.*")


def nipals(g: np.ndarray, p: int, count: int, rounds: int = 5_000, tolerance: float = 1e-12) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Canonical correlation one pair at a time from a joint matrix of products: alternating least squares between both sides' scores; what is found is kept
    orthogonal to the pairs before."""
    xx, yy, xy = g[:p, :p], g[p:, p:], g[:p, p:]
    wx, wy, r = np.zeros((p, 0)), np.zeros((len(g) - p, 0)), []
    inverse_x, inverse_y = np.linalg.pinv(xx), np.linalg.pinv(yy)

    def apart(w: np.ndarray, before: np.ndarray, m: np.ndarray) -> np.ndarray:
        w = w - before @ (before.T @ m @ w)
        size = np.sqrt(max(float(w @ m @ w), 0.0))
        return w / size if size > 0 else w

    for k in range(count):
        b = apart(np.ones(len(yy)) + np.arange(len(yy)) * 1e-3 * (k + 1), wy, yy)
        a = np.zeros(p)
        for _ in range(rounds):
            new = apart(inverse_x @ (xy @ b), wx, xx)
            b = apart(inverse_y @ (xy.T @ new), wy, yy)
            if np.abs(new - a).max(initial=0.0) < tolerance:
                break
            a = new
        wx, wy = np.column_stack([wx, new]), np.column_stack([wy, b])
        r.append(float(new @ xy @ b))
    return signed(wx), wy * np.where(signed(wx)[0] == wx[0], 1, -1), np.array(r)


class CanonicalModel:
    """Canonical correlation between lagged features and (lagged) channels: svd, nt or nipals, all from one joint Gram matrix of the lagged design. Columns are
    centred, so the intercept is 0 in the components. count: how many pairs."""

    def __init__(self, x_lags: Sequence[int] = (0,), y_lags: Sequence[int] = (0,), method: str = "svd", count: int | None = None, **options):
        self.x_lags, self.y_lags, self.method, self.count, self.options = list(x_lags), list(y_lags), method, count, options

    def design(self, df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
        for columns, lags in ((self.xs, self.x_lags), (self.ys, self.y_lags)):
            df = lag_features(df, columns, lags, key, order)
        return df.na.drop(subset=[*self.x_names, *self.y_names])

    def fit(self, df: DataFrame, xs: list[str], ys: list[str], key: list[str], order: list[str]) -> CanonicalModel:
        self.xs, self.ys = xs, ys
        self.x_names, self.y_names = ([lag_name(c, k) for k in lags for c in columns] for columns, lags in ((xs, self.x_lags), (ys, self.y_lags)))
        data = self.design(df, key, order)
        _, self.mean, g = moments(data, [*self.x_names, *self.y_names])
        most = min(len(self.x_names), len(self.y_names), self.count or len(g))
        if self.method == "nipals":
            self.wx, self.wy, self.r = nipals(g, len(self.x_names), most)
        else:
            self.wx, self.wy, self.r = (v[..., :most] for v in canonical(data, self.x_names, self.y_names, self.method, **self.options))
        return self

    def transform(self, df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
        """df's rows that have all lags, with components u0.. of the features and v0.. of the channels."""
        p = len(self.x_names)
        out = project(self.design(df, key, order), self.x_names, self.wx, [f"u{i}" for i in range(self.wx.shape[1])], self.mean[:p])
        return project(out, self.y_names, self.wy, [f"v{i}" for i in range(self.wy.shape[1])], self.mean[p:])
