"""Linear response models: lagged ridge regression with cross-validation, prediction, scores and model algebra."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.numeric import t_two_sided
from .gram import gram_groups, gram_matrix, ridge
from .lags import lag_features, lag_name

SCHEMA = "alpha double, lag int, feature string, channel string, coef double"


class ResponseModel:
    """y[t] = intercept + sum over lags and features of coef * x[t - lag]. A fitted model is a DataFrame of SCHEMA; the intercept's feature is null."""

    def __init__(self, lags: Sequence[int], alpha: float | Sequence[float] = 0.0, intercept: bool = True):
        self.lags = sorted(int(k) for k in lags)
        self.alphas = [float(a) for a in (alpha if isinstance(alpha, Sequence) else [alpha])]
        self.intercept = intercept

    def _names(self, features: list[str]) -> list[tuple[int | None, str | None, str]]:
        return [(None, None, "__one")] * self.intercept + [(k, f, lag_name(f, k)) for k in self.lags for f in features]

    def design(self, df: DataFrame, features: list[str], key: list[str], order: list[str], fill: float | None = None) -> DataFrame:
        out = lag_features(df, features, self.lags, key, order, fill=fill, drop=fill is None)
        return out.withColumn("__one", F.lit(1.0)) if self.intercept else out

    def table(self, spark, names, beta: np.ndarray, targets: list[str]) -> DataFrame:
        rows = [(a, k, f, c, float(beta[i, j, m])) for i, a in enumerate(self.alphas) for j, (k, f, _) in enumerate(names) for m, c in enumerate(targets)]
        return spark.createDataFrame(rows, SCHEMA)

    def fit(self, df: DataFrame, features: list[str], targets: list[str], key: list[str], order: list[str]) -> DataFrame:
        """One model over all recordings: lags never cross a recording's edge, all recordings add to one Gram matrix. The intercept is penalised too."""
        names = self._names(features)
        columns = [n for _, _, n in names] + targets
        g = gram_matrix(self.design(df, features, key, order).na.drop(subset=targets), columns)
        p = len(names)
        return self.table(df.sparkSession, names, ridge(g, list(range(p)), list(range(p, len(columns))), self.alphas), targets)

    def t_values(self, df: DataFrame, features: list[str], targets: list[str], key: list[str], order: list[str]) -> DataFrame:
        """t and two-sided p of each coefficient without regularisation; degrees of freedom are rows - (coefficients without intercept + 2)."""
        names = self._names(features)
        columns = [n for _, _, n in names] + targets
        g = gram_matrix(self.design(df, features, key, order).na.drop(subset=targets).withColumn("__n", F.lit(1.0)), [*columns, "__n"])
        p, n = len(names), g[-1, -1]
        beta = ridge(g, list(range(p)), list(range(p, len(columns))), [0.0])[0]
        inverse = np.linalg.pinv(g[:p, :p])
        dof = n - (p - self.intercept + 2)
        rows = []
        for m, c in enumerate(targets):
            y = p + m
            rss = g[y, y] - 2 * beta[:, m] @ g[:p, y] + beta[:, m] @ g[:p, :p] @ beta[:, m]
            for j, (k, f, _) in enumerate(names):
                t = float(beta[j, m] / np.sqrt(rss / dof * inverse[j, j]))
                rows.append((k, f, c, t, float(t_two_sided(t, dof))))
        return df.sparkSession.createDataFrame(rows, "lag int, feature string, channel string, t double, p double")

    def predict(self, df: DataFrame, model: DataFrame, features: list[str], key: list[str], order: list[str]) -> DataFrame:
        """All rows of df with a column for each channel (named channel_hat); lags over an edge count 0. A model is small: its numbers go into the plan."""
        rows = model.collect()
        alphas = sorted({r["alpha"] for r in rows})
        if len(alphas) > 1:
            raise ValueError("choose one alpha")
        out = self.design(df, features, key, order, fill=0.0)
        for c in sorted({r["channel"] for r in rows}):
            mine = [r for r in rows if r["channel"] == c]
            terms = [F.lit(r["coef"]) if r["feature"] is None else F.lit(r["coef"]) * F.col(lag_name(r["feature"], r["lag"])) for r in mine]
            total = terms[0]
            for t in terms[1:]:
                total = total + t
            out = out.withColumn(f"{c}_hat", total)
        return out.select(*df.columns, *[f"{c}_hat" for c in sorted({r["channel"] for r in rows})])

    def cross_validate(self, df: DataFrame, features: list[str], targets: list[str], key: list[str], order: list[str], folds: int = 5, by: list[str] | None = None) -> DataFrame:
        """(by, alpha, channel, fold, score): correlation on each held-out fold, for all rows or for each subject (by, some of key). Folds are contiguous
        blocks of a subject's rows in (key, order), the first n mod folds one row longer.

        The data are read once: a fold's Gram matrix, with a column of ones, has all that fits on the other folds and the correlation on its own need. Sums
        of squares lose digits where means are many times the deviations; centre such signals first.
        """
        by = by or []
        names = self._names(features)
        columns = [n for _, _, n in names] + targets
        data = self.design(df, features, key, order).na.drop(subset=targets).withColumn("__ones", F.lit(1.0))
        grams = gram_groups(fold_blocks(data, key, order, folds, by).withColumn("__all", F.lit(0)), [*columns, "__ones"], ["__all", *by, "fold"])
        p, alphas, kinds = len(names), self.alphas, dict(df.dtypes)

        def scores(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("fold")
            grams = [np.array(g, float).reshape(len(columns) + 1, -1) for g in pdf["gram"]]
            total, rows = sum(grams), []
            for f, g in zip(pdf["fold"], grams, strict=True):
                beta = ridge(total - g, list(range(p)), list(range(p, len(columns))), alphas)
                n, one = g[-1, -1], g[-1]
                for i, a in enumerate(alphas):
                    for m, c in enumerate(targets):
                        b, y = beta[i, :, m], p + m
                        vx, vy = n * (b @ g[:p, :p] @ b) - (b @ one[:p]) ** 2, n * g[y, y] - one[y] ** 2
                        both = n * (b @ g[:p, y]) - (b @ one[:p]) * one[y]
                        rows.append((*[pdf[k].iloc[0] for k in by], a, c, int(f), both / np.sqrt(vx * vy) if vx > 0 and vy > 0 else None))
            return pd.DataFrame(rows, columns=[*by, "alpha", "channel", "fold", "score"])

        schema = ", ".join([*[f"{k} {kinds[k]}" for k in by], "alpha double, channel string, fold int, score double"])
        return grams.groupBy("__all", *by).applyInPandas(scores, schema)


def fold_blocks(df: DataFrame, key: list[str], order: list[str], folds: int, by: list[str] | None = None) -> DataFrame:
    """Contiguous folds over all rows, or over each subject's (by). Row numbers are counts of the recordings before plus the place inside, so no window
    holds all rows."""
    by = by or []
    sizes = df.groupBy(*dict.fromkeys([*by, *key])).agg(F.count("*").alias("__rows"))
    # one row for each recording
    before = Window.partitionBy(*by).orderBy(*key).rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("__before", F.coalesce(F.sum("__rows").over(before), F.lit(0))).withColumn("__total", F.sum("__rows").over(Window.partitionBy(*by)))
    inside = F.row_number().over(Window.partitionBy(*key).orderBy(*order)) - 1
    df = df.withColumn("__inside", inside).join(sizes, list(dict.fromkeys([*by, *key])))
    i, n = F.col("__before") + F.col("__inside"), F.col("__total")
    small, extra = F.floor(n / folds), n % folds
    long = (small + 1) * extra
    fold = F.when(i < long, F.floor(i / (small + 1))).otherwise(extra + F.floor((i - long) / F.greatest(small, F.lit(1)))).cast("int")
    return df.withColumn("fold", fold).drop("__inside", "__rows", "__before", "__total")


def best_alpha(scores: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Mean score over folds, then channels, by alpha; the first of the highest, over all or for each subject."""
    by = by or []
    mean = scores.groupBy(*by, "alpha", "channel").agg(F.avg("score").alias("score")).groupBy(*by, "alpha").agg(F.avg("score").alias("score"))
    if not by:
        return mean.orderBy(F.desc("score"), "alpha").limit(1)
    over = Window.partitionBy(*by).orderBy(F.desc("score"), "alpha")
    return mean.withColumn("__r", F.row_number().over(over)).filter("__r = 1").drop("__r")


def reduce_scores(scores: DataFrame, by: list[str], how: str | Callable[[Column], Column] = "avg") -> DataFrame:
    """Scores put together by the name of an aggregate function, or by a function of the column."""
    made = how(F.col("score")) if callable(how) else getattr(F, how)("score")
    return scores.groupBy(*by).agg(made.alias("score"))


def fill_lags(model: DataFrame, lags: Sequence[int]) -> DataFrame:
    """A model with all of the lags: what it lacks counts 0."""
    have = model.filter("lag is not null")
    grid = have.select("alpha", "feature", "channel").distinct().withColumn("lag", F.explode(F.array(*[F.lit(int(k)) for k in lags])))
    full = grid.join(have, ["alpha", "feature", "channel", "lag"], "left").select("alpha", "lag", "feature", "channel", F.coalesce("coef", F.lit(0.0)).alias("coef"))
    return full.union(model.filter("lag is null").select("alpha", "lag", "feature", "channel", "coef"))


def from_array(spark: SparkSession, coefs: np.ndarray, lags: Sequence[int], features: list[str], channels: list[str], alpha: float = 0.0) -> DataFrame:
    """A model from an array (lags, features, channels)."""
    a = np.asarray(coefs, float)
    rows = [(float(alpha), int(k), f, c, float(a[i, j, m])) for i, k in enumerate(lags) for j, f in enumerate(features) for m, c in enumerate(channels)]
    return spark.createDataFrame(rows, SCHEMA)


def p_value(t: Column, dof: Column) -> Column:
    """Two-sided p of Student's t."""

    def two_sided(t: pd.Series, dof: pd.Series) -> pd.Series:
        return pd.Series([float(t_two_sided(float(a), float(b))) for a, b in zip(t, dof, strict=True)])

    return F.pandas_udf(two_sided, "double")(t, dof)


def score(df: DataFrame, truth: str, guess: str, by: list[str], metric: str = "corr") -> DataFrame:
    y, p = F.col(truth), F.col(guess)
    what: dict[str, Column] = {"corr": F.corr(p, y), "mse": F.avg((p - y) * (p - y)), "rmse": F.sqrt(F.avg((p - y) * (p - y)))}
    return df.groupBy(*by).agg(what[metric].alias("score"))


def add_models(*models: DataFrame) -> DataFrame:
    """Element-wise sum of models of one shape."""
    out = models[0]
    for m in models[1:]:
        out = out.unionByName(m)
    return out.groupBy("alpha", "lag", "feature", "channel").agg(F.sum("coef").alias("coef"))


def scale_model(model: DataFrame, by: float) -> DataFrame:
    return model.withColumn("coef", F.col("coef") / by)


def apply_to_model(model: DataFrame, function) -> DataFrame:
    return model.withColumn("coef", function(F.col("coef")))


def subset(model: DataFrame, features: list[str]) -> DataFrame:
    return model.filter(F.col("feature").isin(features))


def nearest_lag(model: DataFrame, times: Sequence[float], srate: float) -> DataFrame:
    """Coefficients at the lag nearest to each time; of two equally near the earlier."""
    wanted = F.explode(F.array(*[F.lit(float(t)) for t in times]))
    rows = model.filter("lag is not null").withColumn("time", wanted)
    over = Window.partitionBy("alpha", "feature", "channel", "time").orderBy(F.abs(F.col("lag") / F.lit(float(srate)) - F.col("time")), "lag")
    return rows.withColumn("__r", F.row_number().over(over)).filter("__r = 1").drop("__r")
