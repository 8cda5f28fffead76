"""Queries by operator over the driver tables, each with the SQL that gives the same rows."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import autoregressive as ar
from ..operators import connectivity as cn
from ..operators import covariance as cv
from ..operators import lags, response, solvers, spectral, windows, words
from ..operators.gram import gram_table
from ..sources import text_tables
from .registry import QUERIES, SQL, query
from .tables import EV, KEY, ORDER, emb_sql, embeddings, events, lagged_sql, lines, load, rounded, rsql, solve_sql, sums_sql

PI = repr(math.pi)


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


# ---- lags

LAGS = [-1, 0, 1, 2]
_LAG_COLS = "x_m1, x_0, x_1, x_2"


@query(f"WITH {EV}, {lagged_sql(LAGS)} SELECT recording, t, coalesce(x_m1, 0.0) AS x_m1, x_0, coalesce(x_1, 0.0) AS x_1, coalesce(x_2, 0.0) AS x_2 FROM lg")
def lag_matrix_fill(spark, sf):
    return lags.lag_features(events(spark, sf), ["x"], LAGS, KEY, ORDER, fill=0.0).select("recording", "t", "x_m1", "x_0", "x_1", "x_2")


@query(f"WITH {EV}, {lagged_sql(LAGS)} SELECT recording, t, {_LAG_COLS} FROM lg WHERE x_m1 IS NOT NULL AND x_2 IS NOT NULL")
def lag_matrix_drop(spark, sf):
    return lags.lag_features(events(spark, sf), ["x"], LAGS, KEY, ORDER, drop=True).select("recording", "t", "x_m1", "x_0", "x_1", "x_2")


@query(f"WITH {EV}, {lagged_sql([-3, -1])} SELECT recording, t, x_m3, x_m1 FROM lg")
def lag_negative(spark, sf):
    return lags.lag_features(events(spark, sf), ["x"], [-3, -1], KEY, ORDER).select("recording", "t", "x_m3", "x_m1")


@query("SELECT CAST(i AS BIGINT) AS lag, i / 125.0::DOUBLE AS time FROM range(CAST(ceil((-0.1)::DOUBLE * 125) AS BIGINT), CAST(ceil(0.4::DOUBLE * 125) AS BIGINT)) r(i)")
def lag_span(spark, sf):
    span = lags.lag_span(-0.1, 0.4, 125)
    return spark.createDataFrame([(k, k / 125) for k in span], "lag long, time double")


@query("SELECT p_partkey, CAST(ceil(p_size * 0.01::DOUBLE * 125.0::DOUBLE) AS BIGINT) AS lag FROM part")
def lag_sparse(spark, sf):
    return load(spark, sf, "part").select("p_partkey", F.ceil(F.col("p_size") * F.lit(0.01) * F.lit(125.0)).cast("long").alias("lag"))


@query(f"WITH {EV}, {lagged_sql([1, 2], ('x', 'y'))} SELECT recording, t, x_1, y_1, x_2, y_2 FROM lg WHERE x_2 IS NOT NULL AND y_2 IS NOT NULL")
def design_lagmatrix(spark, sf):
    return lags.design_lags(events(spark, sf), ["x", "y"], 2, KEY, ORDER).select("recording", "t", "x_1", "y_1", "x_2", "y_2")


@query(f"WITH {EV}, n AS (SELECT recording, count(*) AS n FROM ev GROUP BY 1) SELECT recording, t, x FROM ev JOIN n USING (recording) WHERE t >= 3 AND t < n - 2")
def valid_samples(spark, sf):
    return lags.valid_samples(events(spark, sf), range(-2, 4), KEY).select("recording", "t", "x")


@query(f"""WITH {EV}, f AS (SELECT recording, t, list(x) OVER w AS l FROM ev WINDOW w AS (PARTITION BY recording ORDER BY t ROWS BETWEEN 24 PRECEDING AND 5 FOLLOWING))
 SELECT recording, t, l[1] AS oldest, l[30] AS newest, {rsql("list_sum(l)")} AS total FROM f WHERE len(l) = 30""")
def lag_array(spark, sf):
    df = lags.lag_array(events(spark, sf).select("recording", "t", "x"), "x", -5, 24, KEY, ORDER)
    return df.select("recording", "t", F.col("lagged")[0].alias("oldest"), F.col("lagged")[29].alias("newest"), rounded(F.aggregate("lagged", F.lit(0.0), lambda a, v: a + v)).alias("total"))


@query(f"WITH {EV}, {lagged_sql([-2, 3])} SELECT recording, t, x_m2, x_3 FROM lg")
def lag_halo_blocks(spark, sf):
    df = lags.haloed(events(spark, sf), 16, 3, 2, KEY)
    return lags.lag_features(df, ["x"], [-2, 3], ["recording", "block"], ORDER).filter("own").select("recording", "t", "x_m2", "x_3")


# ---- windows

_CHUNK = f"""WITH {EV}, n AS (SELECT recording, count(*) AS n FROM ev GROUP BY 1),
 k AS (SELECT recording, unnest(range(0, CAST(greatest(floor((n - 10) / 5.0) + 1, 0) AS BIGINT))) AS k FROM n), c AS (SELECT k.recording, k.k AS "window", x, y, t FROM k JOIN ev ON ev.recording = k.recording AND t >= 5 * k.k AND t < 5 * k.k + 10)"""


@query(f'{_CHUNK} SELECT recording, "window", count(*) AS n, min(t) AS first, {rsql("avg(x)")} AS mean FROM c GROUP BY 1, 2')
def chunk_windows(spark, sf):
    return windows.rolling(events(spark, sf), 10, 5, KEY, [F.count("*").alias("n"), F.min("t").alias("first"), rounded(F.avg("x")).alias("mean")])


@query(f'{_CHUNK} SELECT recording, "window", {rsql("avg(x)")} AS mean FROM c GROUP BY 1, 2')
def rolling_mean(spark, sf):
    return windows.rolling(events(spark, sf), 10, 5, KEY, [rounded(F.avg("x")).alias("mean")])


@query(f'{_CHUNK} SELECT recording, "window", {rsql("var_samp(x)", 2)} AS variance FROM c GROUP BY 1, 2')
def rolling_var(spark, sf):
    return windows.rolling(events(spark, sf), 10, 5, KEY, [rounded(F.var_samp("x"), 2).alias("variance")])


@query(f'{_CHUNK} SELECT recording, "window", {rsql("covar_samp(x, y)", 4)} AS covariance FROM c GROUP BY 1, 2')
def rolling_cov(spark, sf):
    return windows.rolling(events(spark, sf), 10, 5, KEY, [rounded(F.covar_samp("x", "y"), 4).alias("covariance")])


@query(f"""WITH {EV}, n AS (SELECT recording, count(*) AS n FROM ev GROUP BY 1), k AS (SELECT recording, n, unnest(range(0, CAST(greatest(ceil((n - 8) / 6.0) + 1, 1) AS BIGINT))) AS k FROM n),
 c AS (SELECT recording, k AS "window", least(6 * k + unnest(range(0, 8)), n - 1) AS t FROM k) SELECT recording, "window", {rsql("max(x) - min(x)")} AS spread, count(*) AS n FROM c JOIN ev USING (recording, t) GROUP BY 1, 2""")
def rolling_function_padded(spark, sf):
    def spread(pdf):
        return pdf.head(1)[["recording", "window"]].assign(spread=round(pdf["x"].max() - pdf["x"].min(), 6) + 0.0, n=len(pdf))

    return windows.rolling_function(events(spark, sf), spread, "recording long, window long, spread double, n long", 8, 2, KEY)


@query(f"""WITH {EV}, w AS (SELECT recording, t, avg(x) OVER w AS a, count(x) OVER w AS n FROM ev WINDOW w AS (PARTITION BY recording ORDER BY t ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING))
 SELECT recording, t, {rsql("a")} AS average FROM w WHERE n = 5""")
def moving_average(spark, sf):
    return windows.moving_average(events(spark, sf), "x", 5, KEY).select("recording", "t", rounded("average").alias("average"))


@query(f"""WITH {EV}, w AS (SELECT recording, t, list(x) OVER w AS l FROM ev WINDOW w AS (PARTITION BY recording ORDER BY t ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING))
 SELECT recording, t, l[1] AS first, l[4] AS last FROM w WHERE len(l) = 4""")
def shift_windows(spark, sf):
    return windows.sliding(events(spark, sf), "x", 4, KEY).select("recording", "t", F.col("values")[0].alias("first"), F.col("values")[3].alias("last"))


@query(f"""WITH {EV}, w AS (SELECT recording, t, sum(x * x) OVER (PARTITION BY recording ORDER BY t ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) / 7 AS p FROM ev)
 SELECT recording, t, {rsql("10 * log10(p + 1e-16)")} AS power FROM w""")
def power_db(spark, sf):
    return windows.power(events(spark, sf), "x", 7, KEY, db=True).select("recording", "t", rounded("power").alias("power"))


@query(f"WITH {EV} SELECT recording, CAST(floor(t / 8) AS BIGINT) AS frame, {rsql('sum(x) / 8')} AS value FROM ev GROUP BY 1, 2")
def frame_mean(spark, sf):
    return windows.frame_mean(events(spark, sf), "x", 8, KEY).select("recording", "frame", rounded("value").alias("value"))


@query(f"WITH {EV} SELECT recording, t, {rsql('(x - min(x) OVER w) / (max(x) OVER w - min(x) OVER w)')} AS scaled FROM ev WINDOW w AS (PARTITION BY recording)")
def minmax_scale(spark, sf):
    return windows.minmax(events(spark, sf), "x", KEY).select("recording", "t", rounded("scaled").alias("scaled"))


@query(f"WITH {EV} SELECT recording, t, {rsql('(x - avg(x) OVER w) / stddev_pop(x) OVER w')} AS z FROM ev WINDOW w AS (PARTITION BY recording)")
def zscore(spark, sf):
    return windows.zscore(events(spark, sf), "x", KEY).select("recording", "t", rounded("z").alias("z"))


_PHASE = f"{EV}, ph AS (SELECT recording, t, 6.2 * (x / 7 - floor(x / 7)) - 3.1 AS p FROM ev)"
_STEP = f"{_PHASE}, st AS (SELECT *, p - lag(p) OVER (PARTITION BY recording ORDER BY t) AS d FROM ph), un AS (SELECT recording, t, sum(coalesce(atan2(sin(d), cos(d)), p)) OVER (PARTITION BY recording ORDER BY t) AS u FROM st)"


def _phases(spark, sf):
    return events(spark, sf).withColumn("p", 6.2 * (F.col("x") / 7 - F.floor(F.col("x") / 7)) - 3.1)


@query(f"WITH {_STEP} SELECT recording, t, {rsql('u')} AS unwrapped FROM un")
def phase_unwrap(spark, sf):
    return windows.unwrap(_phases(spark, sf), "p", KEY).select("recording", "t", rounded("unwrapped").alias("unwrapped"))


@query(f"WITH {_STEP} SELECT recording, t, {rsql(f'coalesce(400.0 + (lead(u) OVER (PARTITION BY recording ORDER BY t) - u) * 4000.0 / (2 * {PI}), 400.0)', 4)} AS frequency FROM un")
def instantaneous_frequency(spark, sf):
    df = windows.unwrap(_phases(spark, sf), "p", KEY)
    return windows.instantaneous_frequency(df, "unwrapped", 4000.0, 400.0, KEY).select("recording", "t", rounded("frequency", 4).alias("frequency"))


@query(f"""WITH {EV}, o AS (SELECT recording, t, CAST(round_even(t * 0.37 * 2.0, 0) AS BIGINT) AS s FROM ev)
 SELECT recording, t, CASE WHEN s = lag(s) OVER (PARTITION BY recording ORDER BY t) THEN s + 1 ELSE s END AS sample FROM o""")
def onset_dedup(spark, sf):
    df = events(spark, sf).withColumn("s", words.sample_of(F.col("t") * 0.37, 2.0))
    return windows.separate_onsets(df, "s", KEY, "t").select("recording", "t", "sample")


@query(f"""WITH c AS (SELECT p_size, CAST(count(*) AS DOUBLE) AS n, p_brand FROM part GROUP BY p_size, p_brand), y AS (SELECT p_brand, p_size AS x, (n - min(n) OVER w) / nullif(max(n) OVER w - min(n) OVER w, 0) AS y FROM c WINDOW w AS (PARTITION BY p_brand)),
 a AS (SELECT p_brand, x, (atan2(lead(y) OVER w - y, lead(x) OVER w - x) - atan2(lag(y) OVER w - y, lag(x) OVER w - x)) / {PI} AS a FROM y WINDOW w AS (PARTITION BY p_brand ORDER BY x)), b AS (SELECT * FROM a WHERE a IS NOT NULL),
 s AS (SELECT p_brand, x, (a - min(a) OVER w) / nullif(max(a) OVER w - min(a) OVER w, 0) AS s FROM b WINDOW w AS (PARTITION BY p_brand)) SELECT p_brand, coalesce(min(CASE WHEN s > 0.5000001 THEN x END), min(x)) AS knee FROM s GROUP BY 1""")
def knee_point(spark, sf):
    df = load(spark, sf, "part").groupBy("p_brand", "p_size").agg(F.count("*").cast("double").alias("n"))
    return windows.knee(df, "p_size", "n", ["p_brand"], 0.5000001)


# ---- Gram matrices and regression


@query(f"WITH {EV} SELECT 'x' AS i, 'x' AS j, {rsql('sum(x * x)', 2)} AS v FROM ev UNION ALL SELECT 'x', 'y', {rsql('sum(x * y)', 2)} FROM ev UNION ALL SELECT 'y', 'y', {rsql('sum(y * y)', 2)} FROM ev")
def gram(spark, sf):
    return gram_table(events(spark, sf), ["x", "y"]).withColumn("v", rounded("v", 2))


@query(f"""WITH {EV}, {lagged_sql([0, 1, 2])}, v AS (SELECT * FROM lg WHERE x_2 IS NOT NULL) SELECT recording, {rsql('sum(x_0 * y)', 3)} AS c0, {rsql('sum(x_1 * y)', 3)} AS c1, {rsql('sum(x_2 * y)', 3)} AS c2 FROM v GROUP BY 1""")
def cross_gram(spark, sf):
    df = lags.lag_features(events(spark, sf), ["x"], [0, 1, 2], KEY, ORDER, drop=True)
    g = gram_table(df, ["x_0", "x_1", "x_2", "y"], KEY).filter("j = 'y' and i <> 'y'")
    return g.groupBy("recording").agg(*[rounded(F.max(F.when(F.col("i") == f"x_{k}", F.col("v"))), 3).alias(f"c{k}") for k in range(3)])


@query(f"""WITH lo AS (SELECT 1.0 AS one, l_quantity AS q, l_discount AS d, l_tax AS x FROM lineitem), {sums_sql("g", "lo", ["one", "q", "d"], ["x"], alpha="2.0")}, {solve_sql("g", 3)}
 SELECT i AS name, {rsql('CASE i WHEN 0 THEN a_0_3 WHEN 1 THEN a_1_3 ELSE a_2_3 END', 8)} AS coef FROM s2, (SELECT CAST(unnest([0, 1, 2]) AS INTEGER) AS i)""")
def ridge_wide(spark, sf):
    from ..operators.gram import gram_matrix
    from ..operators.gram import ridge as solve

    df = load(spark, sf, "lineitem").withColumn("one", F.lit(1.0))
    b = solve(gram_matrix(df, ["one", "l_quantity", "l_discount", "l_tax"]), [0, 1, 2], [3], [2.0])[0, :, 0]
    return spark.createDataFrame([(i, round(float(v), 8) + 0.0) for i, v in enumerate(b)], "name int, coef double")


def _model_sql(xs: list[str], names: list[str], lag_list: list[int], alphas: list[float], digits: int = 6) -> str:
    """A fitted response model as (alpha, lag, feature, channel, coef)."""
    a = "unnest([" + ", ".join(f"{x}::DOUBLE" for x in alphas) + "]) AS alpha"
    p = len(xs)
    grid = f"{EV}, {lagged_sql(lag_list)}, v AS (SELECT *, 1.0 AS one FROM lg WHERE " + " AND ".join(f"{n} IS NOT NULL" for n in xs if n != "one") + f"), al AS (SELECT {a})"
    sums = sums_sql("g", "v, al", xs, ["y"], keys="alpha", alpha="alpha")
    rows = " UNION ALL ".join(f"SELECT alpha, {n} AS channel, {rsql(f'a_{i}_{p}', digits)} AS coef FROM s{p - 1}" for i, n in enumerate(names))
    return f"{grid}, {sums}, {solve_sql('g', p, 1, 'alpha')}, model AS ({rows})"


def _named(k: int | None) -> str:
    return "0 AS lag, 'intercept' AS feature, 'y'" if k is None else f"{k} AS lag, 'x' AS feature, 'y'"


def _coefs(model, digits: int = 6):
    return model.withColumns({"lag": F.coalesce("lag", F.lit(0)), "feature": F.coalesce("feature", F.lit("intercept")), "coef": rounded("coef", digits)})


@query(f"WITH {_model_sql(['one', 'x_0'], [_named(None), _named(0)], [0], [0.0])} SELECT * FROM model")
def ols_1lag(spark, sf):
    return _coefs(response.ResponseModel([0]).fit(events(spark, sf), ["x"], ["y"], KEY, ORDER))


@query(f"WITH {_model_sql(['x_0', 'x_1'], [_named(0), _named(1)], [0, 1], [5.0])} SELECT * FROM model")
def ridge_2lag(spark, sf):
    return _coefs(response.ResponseModel([0, 1], 5.0, intercept=False).fit(events(spark, sf), ["x"], ["y"], KEY, ORDER))


@query(f"WITH {_model_sql(['one', 'x_0', 'x_1'], [_named(None), _named(0), _named(1)], [0, 1], [0.0, 1.0, 100.0])} SELECT * FROM model")
def ridge_multi_alpha(spark, sf):
    return _coefs(response.ResponseModel([0, 1], [0.0, 1.0, 100.0]).fit(events(spark, sf), ["x"], ["y"], KEY, ORDER))


_TRF = _model_sql(["one", "x_m1", "x_0", "x_1"], [_named(None), _named(-1), _named(0), _named(1)], [-1, 0, 1], [10.0])
_TRF_RAW = _model_sql(["one", "x_m1", "x_0", "x_1"], [_named(None), _named(-1), _named(0), _named(1)], [-1, 0, 1], [10.0], 15)


def _trf(spark, sf):
    model = response.ResponseModel([-1, 0, 1], 10.0)
    df = events(spark, sf)
    return model, df, model.fit(df, ["x"], ["y"], KEY, ORDER)


@query(f"WITH {_TRF} SELECT * FROM model")
def trf_segments(spark, sf):
    return _coefs(_trf(spark, sf)[2])


_HAT = f"""WITH {_TRF_RAW}, c AS (SELECT max(CASE WHEN feature = 'intercept' THEN coef END) AS b, max(CASE WHEN lag = -1 THEN coef END) AS m1, max(CASE WHEN lag = 0 AND feature = 'x' THEN coef END) AS c0, max(CASE WHEN lag = 1 THEN coef END) AS c1 FROM model),
 hat AS (SELECT recording, t, y, b + m1 * coalesce(x_m1, 0) + c0 * x_0 + c1 * coalesce(x_1, 0) AS y_hat FROM lg, c)"""


def _hat(spark, sf):
    model, df, table = _trf(spark, sf)
    return model.predict(df, table, ["x"], KEY, ORDER)


@query(f"{_HAT} SELECT recording, t, {rsql('y_hat')} AS y_hat FROM hat")
def trf_predict(spark, sf):
    return _hat(spark, sf).select("recording", "t", rounded("y_hat").alias("y_hat"))


@query(f"{_HAT} SELECT recording, {rsql('corr(y_hat, y)')} AS score FROM hat GROUP BY 1")
def trf_score_corr(spark, sf):
    return response.score(_hat(spark, sf), "y", "y_hat", KEY).withColumn("score", rounded("score"))


@query(f"{_HAT} SELECT recording, {rsql('avg((y_hat - y) * (y_hat - y))', 4)} AS score FROM hat GROUP BY 1")
def trf_score_mse(spark, sf):
    return response.score(_hat(spark, sf), "y", "y_hat", KEY, "mse").withColumn("score", rounded("score", 4))


@query(f"{_HAT} SELECT recording, {rsql('sqrt(avg((y_hat - y) * (y_hat - y)))')} AS score FROM hat GROUP BY 1")
def trf_score_rmse(spark, sf):
    return response.score(_hat(spark, sf), "y", "y_hat", KEY, "rmse").withColumn("score", rounded("score"))


@query(f"{_HAT}, s AS (SELECT recording, corr(y_hat, y) AS s FROM hat GROUP BY 1) SELECT {rsql('avg(s)')} AS mean, {rsql('max(s)')} AS best FROM s")
def trf_score_mean(spark, sf):
    s = response.score(_hat(spark, sf), "y", "y_hat", KEY)
    return s.agg(rounded(F.avg("score")).alias("mean"), rounded(F.max("score")).alias("best"))


_CV = f"""WITH {EV}, {lagged_sql([0, 1])}, v AS (SELECT *, row_number() OVER (ORDER BY recording, t) - 1 AS i, count(*) OVER () AS n FROM lg WHERE x_1 IS NOT NULL),
 f AS (SELECT *, CAST(CASE WHEN i < (n // 4 + 1) * (n % 4) THEN i // (n // 4 + 1) ELSE n % 4 + (i - (n // 4 + 1) * (n % 4)) // (n // 4) END AS INTEGER) AS fold FROM v),
 k AS (SELECT a AS alpha, b AS held FROM (SELECT unnest([0.0, 50.0, 100000.0]::DOUBLE[]) AS a), (SELECT CAST(unnest([0, 1, 2, 3]) AS INTEGER) AS b)),
 {sums_sql("g", "f, k", ["x_0", "x_1"], ["y"], keys="alpha, held", alpha="alpha", where="fold <> held")}, {solve_sql("g", 2, 1, "alpha, held")},
 sc AS (SELECT alpha, 'y' AS channel, fold, corr(a_0_2 * x_0 + a_1_2 * x_1, y) AS score FROM f JOIN s1 ON fold = held GROUP BY alpha, fold)"""


def _cv(spark, sf):
    return response.ResponseModel([0, 1], [0.0, 50.0, 100000.0], intercept=False).cross_validate(events(spark, sf), ["x"], ["y"], KEY, ORDER, 4)


@query(f"{_CV} SELECT alpha, channel, fold, {rsql('score')} AS score FROM sc")
def trf_cv_scores(spark, sf):
    return _cv(spark, sf).withColumn("score", rounded("score"))


@query(f"{_CV} SELECT alpha, {rsql('avg(score)')} AS score FROM sc GROUP BY alpha ORDER BY avg(score) DESC, alpha LIMIT 1")
def trf_best_alpha(spark, sf):
    return response.best_alpha(_cv(spark, sf)).withColumn("score", rounded("score"))


@query(f"WITH {_model_sql(['one', 'x_0'], [_named(None), _named(0)], [0], [0.0, 1.0, 100.0])} SELECT * FROM model WHERE alpha = 1.0")
def trf_select_alpha(spark, sf):
    m = response.ResponseModel([0], [0.0, 1.0, 100.0]).fit(events(spark, sf), ["x"], ["y"], KEY, ORDER)
    return _coefs(m.filter(F.col("alpha") == 1.0))


@query(f"""WITH {EV}, s AS (SELECT count(*) AS n, sum(x * x) AS xx, sum(x * y) AS xy, sum(y * y) AS yy FROM ev)
 SELECT 0 AS lag, 'x' AS feature, 'y' AS channel, {rsql('(xy / xx) / sqrt((yy - xy * xy / xx) / (n - 3) / xx)', 5)} AS t FROM s""")
def trf_tvalues(spark, sf):
    out = response.ResponseModel([0], intercept=False).t_values(events(spark, sf), ["x"], ["y"], KEY, ORDER)
    return out.select("lag", "feature", "channel", rounded("t", 5).alias("t"))


@query(f"WITH {EV} SELECT recording, {rsql(f'-count(*) / 2.0 * ln(2 * {PI} * var_pop(y - x)) - sum((y - x) * (y - x)) / (2 * var_pop(y - x))', 4)} AS log_likelihood FROM ev GROUP BY 1")
def log_likelihood(spark, sf):
    return ar.log_likelihood(events(spark, sf), "y", "x", KEY).withColumn("log_likelihood", rounded("log_likelihood", 4))


_M3 = _model_sql(["x_0", "x_1", "x_2"], [_named(0), _named(1), _named(2)], [0, 1, 2], [3.0], 12)


def _m3(spark, sf):
    return response.ResponseModel([0, 1, 2], 3.0, intercept=False).fit(events(spark, sf), ["x"], ["y"], KEY, ORDER)


@query(f"WITH {_M3} SELECT alpha, lag, feature, channel, {rsql('3 * coef')} AS coef FROM model")
def model_add(spark, sf):
    m = _m3(spark, sf)
    return _coefs(response.add_models(m, m, m))


@query(f"WITH {_M3} SELECT alpha, lag, feature, channel, {rsql('coef / 4.0')} AS coef FROM model")
def model_scale(spark, sf):
    return _coefs(response.scale_model(_m3(spark, sf), 4.0))


@query(f"WITH {_M3} SELECT alpha, lag, feature, channel, {rsql('abs(coef) + coef * coef')} AS coef FROM model")
def model_apply_func(spark, sf):
    return _coefs(response.apply_to_model(_m3(spark, sf), lambda c: F.abs(c) + c * c))


@query(f"""WITH {EV}, v AS (SELECT *, CASE WHEN event_type = 'error' THEN 1.0 ELSE 0.0 END AS u FROM ev), {sums_sql("g", "v", ["x", "u"], ["y"], alpha="1.0")}, {solve_sql("g", 2)}
 SELECT 1.0::DOUBLE AS alpha, 0 AS lag, 'u' AS feature, 'y' AS channel, {rsql('a_1_2')} AS coef FROM s1""")
def model_feature_subset(spark, sf):
    df = events(spark, sf).withColumn("u", (F.col("event_type") == "error").cast("double"))
    m = response.ResponseModel([0], 1.0, intercept=False).fit(df, ["x", "u"], ["y"], KEY, ORDER)
    return _coefs(response.subset(m, ["u"]))


@query(f"WITH {_M3} SELECT alpha, lag, feature, channel, {rsql('coef')} AS coef, CASE lag WHEN 1 THEN 0.011::DOUBLE ELSE 0.5::DOUBLE END AS time FROM model WHERE lag IN (1, 2)")
def model_nearest_lag(spark, sf):
    return _coefs(response.nearest_lag(_m3(spark, sf), [0.011, 0.5], 125.0))


@query(f"{_CV} SELECT alpha, {rsql('avg(score)')} AS score, count(*) AS folds FROM sc GROUP BY alpha")
def trf_multialpha_mean(spark, sf):
    return _cv(spark, sf).groupBy("alpha").agg(rounded(F.avg("score")).alias("score"), F.count("*").alias("folds"))


@query(f"""WITH {EV}, m AS (SELECT t, avg(x) AS x, avg(y) AS y FROM ev GROUP BY 1), {sums_sql("g", "m", ["1.0", "x"], ["y"], alpha="0.5")}, {solve_sql("g", 2)}
 SELECT 0.5::DOUBLE AS alpha, 0 AS lag, 'intercept' AS feature, 'y' AS channel, {rsql('a_0_2')} AS coef FROM s1 UNION ALL SELECT 0.5, 0, 'x', 'y', {rsql('a_1_2')} FROM s1""")
def trf_mean_of_subjects(spark, sf):
    mean = events(spark, sf).groupBy("t").agg(F.avg("x").alias("x"), F.avg("y").alias("y")).withColumn("recording", F.lit(0))
    return _coefs(response.ResponseModel([0], 0.5).fit(mean, ["x"], ["y"], KEY, ORDER))


@query(f"WITH {_M3} SELECT lag, bool_or(abs(coef) > 0.35) AS significant FROM model GROUP BY 1")
def trf_significant_lags(spark, sf):
    return _m3(spark, sf).groupBy("lag").agg(F.bool_or(F.abs("coef") > 0.35).alias("significant"))


@query(f"WITH {emb_sql(3)} SELECT vec_id, " + ", ".join(f"{rsql(f'(e{i} - min(e{i}) OVER ()) / (max(e{i}) OVER () - min(e{i}) OVER ())')} AS c{i}" for i in range(3)) + " FROM em")
def spatial_colours(spark, sf):
    df = embeddings(spark, sf, 3)
    edges = df.agg(*[f(f"e{i}").alias(f"{n}{i}") for i in range(3) for n, f in (("lo", F.min), ("hi", F.max))])  # one row
    out = df.crossJoin(F.broadcast(edges))
    return out.select("vec_id", *[rounded((F.col(f"e{i}") - F.col(f"lo{i}")) / (F.col(f"hi{i}") - F.col(f"lo{i}"))).alias(f"c{i}") for i in range(3)])


# ---- autoregressive models


@query(f"WITH {EV}, {lagged_sql([1])} SELECT recording, 1 AS lag, {rsql('sum(x_1 * x) / sum(x_1 * x_1)')} AS coef FROM lg WHERE x_1 IS NOT NULL GROUP BY recording")
def fit_ar1(spark, sf):
    return ar.fit_ar(events(spark, sf), "x", 1, KEY, ORDER).withColumn("coef", rounded("coef"))


@query(f"""WITH {EV}, {lagged_sql([1, 2])}, {sums_sql("g", "lg", ["x_1", "x_2"], ["x"], keys="recording", where="x_2 IS NOT NULL")}, {solve_sql("g", 2, 1, "recording")}
 SELECT recording, 1 AS lag, {rsql('a_0_2')} AS coef FROM s1 UNION ALL SELECT recording, 2, {rsql('a_1_2')} FROM s1""")
def fit_ar2(spark, sf):
    return ar.fit_ar(events(spark, sf), "x", 2, KEY, ORDER).withColumn("coef", rounded("coef"))


@query(f"""WITH {EV}, {lagged_sql([1], ('x', 'y'))}, {sums_sql("g", "lg", ["x_1", "y_1"], ["x", "y"], where="x_1 IS NOT NULL")}, {solve_sql("g", 2, 2)}
 SELECT 1 AS lag, 'x' AS source, 'x' AS target, {rsql('a_0_2')} AS coef FROM s1 UNION ALL SELECT 1, 'x', 'y', {rsql('a_0_3')} FROM s1 UNION ALL SELECT 1, 'y', 'x', {rsql('a_1_2')} FROM s1 UNION ALL SELECT 1, 'y', 'y', {rsql('a_1_3')} FROM s1""")
def fit_var(spark, sf):
    return ar.fit_var(events(spark, sf), ["x", "y"], 1, KEY, ORDER).withColumn("coef", rounded("coef"))


@query(f"""WITH {EV}, {lagged_sql([1], ('x', 'y'))}, v AS (SELECT * FROM lg WHERE x_1 IS NOT NULL), {sums_sql("g", "v", ["x_1", "y_1"], ["x", "y"])}, {solve_sql("g", 2, 2)},
 o AS (SELECT sum(x_1 * x) / sum(x_1 * x_1) AS bx, sum(y_1 * y) / sum(y_1 * y_1) AS b FROM v),
 r AS (SELECT ln(var_pop(x - bx * x_1) / var_pop(x - a_0_2 * x_1 - a_1_2 * y_1)) AS gx, ln(var_pop(y - b * y_1) / var_pop(y - a_0_3 * x_1 - a_1_3 * y_1)) AS gy FROM v, o, s1)
 SELECT 'x' AS source, 'x' AS target, 0.0 AS value FROM r UNION ALL SELECT 'y', 'x', {rsql('gx', 7)} FROM r UNION ALL SELECT 'x', 'y', {rsql('gy', 7)} FROM r UNION ALL SELECT 'y', 'y', 0.0 FROM r""")
def granger(spark, sf):
    return ar.granger(events(spark, sf), ["x", "y"], 1, KEY, ORDER).withColumn("value", rounded("value", 7))


# ---- covariances


def _pairs_sql(agg, keys: str, source: str, digits: int = 7, dims: int = 4) -> str:
    k = f"{keys}, " if keys else ""
    group = f" GROUP BY {keys}" if keys else ""
    return " UNION ALL ".join(f"SELECT {k}'e{i}' AS i, 'e{j}' AS j, {rsql(agg(f'e{i}', f'e{j}'), digits)} AS v FROM {source}{group}" for i in range(dims) for j in range(i, dims))


E4 = [f"e{i}" for i in range(4)]


E64 = [f"e{i}" for i in range(64)]


def _all_pairs_sql(agg: str, digits: int, by: bool = True) -> str:
    """All 2,080 pairs of a vector's 64 components."""
    k, group = ("a.label, ", "a.label, ") if by else ("", "")
    return f"""WITH lv AS (SELECT vec_id, label, unnest(range(0, 64)) AS k, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings)
 SELECT {k}'e' || a.k AS i, 'e' || b.k AS j, {rsql(agg, digits)} AS v FROM lv a JOIN lv b ON a.vec_id = b.vec_id AND a.k <= b.k GROUP BY {group}a.k, b.k"""


@query(_all_pairs_sql("covar_samp(a.v, b.v)", 7))
def cov_trials(spark, sf):
    return cv.covariance(embeddings(spark, sf, 64), E64, ["label"]).withColumn("v", rounded("v", 7))


@query(_all_pairs_sql("covar_samp(a.v, b.v)", 7, False))
def cov_all(spark, sf):
    return cv.covariance(embeddings(spark, sf, 64), E64).withColumn("v", rounded("v", 7))


@query(_all_pairs_sql("avg(a.v * b.v)", 7))
def cov_scm(spark, sf):
    return cv.covariance(embeddings(spark, sf, 64), E64, ["label"], "scm").withColumn("v", rounded("v", 7))


@query(_all_pairs_sql("corr(a.v, b.v)", 6))
def corr_trials(spark, sf):
    return cv.covariance(embeddings(spark, sf, 64), E64, ["label"], "corr").withColumn("v", rounded("v", 6))


@query(f"WITH {emb_sql(2)}, tp AS (SELECT vec_id, label, e0, e1, avg(e0) OVER w AS e2, avg(e1) OVER w AS e3 FROM (SELECT *, vec_id % 20 AS t FROM em) WINDOW w AS (PARTITION BY t)) " + _pairs_sql(lambda a, b: f"covar_samp({a}, {b})", "label", "tp"))
def cov_extended(spark, sf):
    df = embeddings(spark, sf, 2).withColumn("t", F.col("vec_id") % 20)
    template = df.groupBy("t").agg(F.avg("e0").alias("e2"), F.avg("e1").alias("e3"))
    return cv.covariance(df.join(template, "t"), E4, ["label"]).withColumn("v", rounded("v", 7))


_SHRUNK = f"""WITH {emb_sql(2)}, m AS (SELECT *, e0 - avg(e0) OVER w AS a, e1 - avg(e1) OVER w AS b FROM em WINDOW w AS (PARTITION BY label)),
 s AS (SELECT label, count(*)::DOUBLE AS n, avg((a * a + b * b) * (a * a + b * b)) AS q, avg(a * a) AS aa, avg(a * b) AS ab, avg(b * b) AS bb FROM m GROUP BY 1),
 u AS (SELECT *, (aa + bb) / 2 AS mu, aa * aa + 2 * ab * ab + bb * bb AS sq FROM s)"""
_SHRUNK_OUT = " UNION ALL ".join(f"SELECT label, '{i}' AS i, '{j}' AS j, {rsql(f'(1 - k) * {v}' + (' + k * mu' if i == j else ''), 7)} AS v FROM k" for i, j, v in (("e0", "e0", "aa"), ("e0", "e1", "ab"), ("e1", "e1", "bb")))


@query(f"{_SHRUNK}, k AS (SELECT *, least((sq / 4 + mu * mu) / ((n + 1) * (sq / 4 - mu * mu / 2)), 1.0) AS k FROM u) {_SHRUNK_OUT}")
def cov_oas(spark, sf):
    return cv.covariance(embeddings(spark, sf, 2), ["e0", "e1"], ["label"], "oas").withColumn("v", rounded("v", 7))


@query(f"{_SHRUNK}, k AS (SELECT *, least((q - sq) / (n * 2), (sq - 2 * mu * mu) / 2) / ((sq - 2 * mu * mu) / 2) AS k FROM u) {_SHRUNK_OUT}")
def cov_ledoit_wolf(spark, sf):
    return cv.covariance(embeddings(spark, sf, 2), ["e0", "e1"], ["label"], "lwf").withColumn("v", rounded("v", 7))


@query()
def cov_mcd(spark, sf):
    return cv.covariance(embeddings(spark, sf, 3), ["e0", "e1", "e2"], ["label"], "mcd").withColumn("v", rounded("v", 7))


_UNIT = "SELECT 'w' || i AS i, 'w' || j AS j, CASE WHEN i = j THEN 1.0 ELSE 0.0 END::DOUBLE AS v FROM range(0, 12) a(i), range(0, 12) b(j) WHERE i <= j"


def _whitened(spark, sf, kind: str):
    df = embeddings(spark, sf, 12)
    out = cv.Whitener(kind).fit(df, E64[:12]).transform(df)
    return cv.covariance(out, [f"w{i}" for i in range(12)]).withColumn("v", rounded("v", 6))


@query(_UNIT)
def whiten_check(spark, sf):
    return _whitened(spark, sf, "pca")


@query(_UNIT)
def zca_check(spark, sf):
    return _whitened(spark, sf, "zca")


@query(f"WITH {emb_sql(2)} SELECT vec_id, {rsql('e0')} AS r0, {rsql('e1')} AS r1 FROM em")
def whiten_inverse(spark, sf):
    df = embeddings(spark, sf, 2)
    w = cv.Whitener("pca").fit(df, ["e0", "e1"])
    return w.inverse(w.transform(df)).select("vec_id", rounded("r0").alias("r0"), rounded("r1").alias("r1"))


@query(f"""WITH {EV}, v AS (SELECT var_samp(x) FILTER (event_type = 'error') AS sy, var_samp(x) FILTER (event_type <> 'error') AS sc FROM ev)
 SELECT recording, t, {rsql('x - x * (sy - sc) / sy')} AS clean0 FROM ev, v""")
def wiener_filter(spark, sf):
    df = events(spark, sf)
    return cv.ArtefactFilter().fit(df, ["x"], F.col("event_type") == "error").transform(df).select("recording", "t", rounded("clean0").alias("clean0"))


@query()
def wiener_filter_low_rank(spark, sf):
    df = embeddings(spark, sf, 4)
    out = cv.ArtefactFilter(2).fit(df, E4, F.col("label") < 3).transform(df)
    return out.select("vec_id", *[rounded(f"clean{i}").alias(f"clean{i}") for i in range(4)])


@query(f"WITH {emb_sql(2)} SELECT 0 AS component, {rsql('abs(corr(e0, e1))')} AS r FROM em")
def cca_corr(spark, sf):
    _, _, r = cv.canonical(embeddings(spark, sf, 2), ["e0"], ["e1"])
    return spark.createDataFrame([(i, round(float(v), 6) + 0.0) for i, v in enumerate(r)], "component int, r double")


@query()
def cca_halves(spark, sf):
    df = embeddings(spark, sf, 64)
    _, _, r = cv.canonical(df, [f"e{i}" for i in range(32)], [f"e{i}" for i in range(32, 64)])
    return spark.createDataFrame([(i, round(float(v), 6) + 0.0) for i, v in enumerate(r)], "component int, r double")


@query(f"WITH {emb_sql(2)} SELECT 0 AS component, {rsql('sum(e0 * e1) / sqrt(sum(e0 * e0) * sum(e1 * e1)) * sign(sum(e0 * e1))')} AS r FROM em")
def cca_nt_corr(spark, sf):
    _, _, r = cv.canonical(embeddings(spark, sf, 2), ["e0"], ["e1"], "nt", centre=False)
    return spark.createDataFrame([(i, round(float(v), 6) + 0.0) for i, v in enumerate(r)], "component int, r double")


@query(f"WITH {emb_sql(2)} SELECT {rsql('abs(corr(e0, e1))')} AS r, 1.0::DOUBLE AS sx, 1.0::DOUBLE AS sy FROM em")
def cca_project(spark, sf):
    df = embeddings(spark, sf, 2)
    a, b, _ = cv.canonical(df, ["e0"], ["e1"])
    out = cv.project(cv.project(df, ["e0"], a, ["u"]), ["e1"], b, ["v"])
    n = F.count("*") - 1
    return out.agg(rounded(F.abs(F.corr("u", "v"))).alias("r"), rounded(F.var_samp("u") * n).alias("sx"), rounded(F.var_samp("v") * n).alias("sy"))


@query()
def mcca_variance(spark, sf):
    df = embeddings(spark, sf, 12)
    _, v = cv.multiway(df, [[f"e{i}" for i in range(g, g + 4)] for g in (0, 4, 8)], 3)
    return spark.createDataFrame([(i, round(float(x), 6) + 0.0, round(float(x) / 3 * 100, 4) + 0.0) for i, x in enumerate(v)], "component int, variance double, percent double")


@query(f"""WITH {emb_sql(2)}, g AS (SELECT sum(e0 * e0) AS a, sum(e0 * e1) AS b, sum(e1 * e1) AS c FROM em), l AS (SELECT (a + c) / 2 + sqrt((a - c) * (a - c) / 4 + b * b) AS l0, (a + c) / 2 - sqrt((a - c) * (a - c) / 4 + b * b) AS l1 FROM g)
 SELECT 0 AS component, {rsql('l0')} AS value, true AS kept FROM l UNION ALL SELECT 1, {rsql('l1')}, l0 / (l0 + l1) < 0.6 FROM l""")
def pca_truncate(spark, sf):
    from ..operators.gram import gram_matrix

    value = np.linalg.eigvalsh(gram_matrix(embeddings(spark, sf, 2), ["e0", "e1"]))[::-1]
    n = cv.rank_for(value, "var", 0.6)
    return spark.createDataFrame([(i, round(float(v), 6) + 0.0, i < n) for i, v in enumerate(value)], "component int, value double, kept boolean")


@query(f"WITH {emb_sql(1)} SELECT vec_id, {rsql('(sum(e0) OVER w - e0) / (count(*) OVER w - 1)', 8)} AS jackknife FROM em WINDOW w AS (PARTITION BY label)")
def jackknife_mean(spark, sf):
    return cn.jackknife_means(embeddings(spark, sf, 1), "e0", ["label"]).select("vec_id", rounded("jackknife", 8).alias("jackknife"))


# ---- connectivity

_BIN = f"{EV}, ph AS (SELECT recording, t, 2 * {PI} * (x - floor(x)) AS px, 2 * {PI} * (y * 0.37 - floor(y * 0.37)) AS py FROM ev), bn AS (SELECT recording, t, CAST(least(floor(px / 0.9), 6) AS INTEGER) AS bx, CAST(least(floor(py / 0.9), 6) AS INTEGER) AS b FROM ph)"


def _bins(spark, sf):
    turn = lambda c: 2 * math.pi * (c - F.floor(c))
    df = events(spark, sf).select("recording", "t", turn(F.col("x")).alias("px"), turn(F.col("y") * F.lit(0.37)).alias("py"))
    return df.withColumn("bx", cn.binned(F.col("px"), 0.9, 7)).withColumn("b", cn.binned(F.col("py"), 0.9, 7))


@query(f"WITH {_BIN} SELECT recording, bx, count(*) AS n FROM bn GROUP BY 1, 2")
def histogram1d(spark, sf):
    return cn.histogram(_bins(spark, sf), ["bx"], KEY)


@query(f"WITH {_BIN} SELECT bx, b, count(*) AS n FROM bn GROUP BY 1, 2")
def histogram2d(spark, sf):
    return cn.histogram(_bins(spark, sf), ["bx", "b"], [])


@query(f"WITH {_BIN}, h AS (SELECT recording, bx, count(*) AS n FROM bn GROUP BY 1, 2), p AS (SELECT recording, n / sum(n) OVER (PARTITION BY recording) AS p FROM h) SELECT recording, {rsql('-sum(p * log2(p))')} AS entropy FROM p GROUP BY 1")
def entropy(spark, sf):
    return cn.entropy(_bins(spark, sf), ["bx"], KEY).withColumn("entropy", rounded("entropy"))


def _h(cols: str) -> str:
    return f"(SELECT recording, -sum(p * log2(p)) AS h FROM (SELECT recording, count(*) / sum(count(*)) OVER (PARTITION BY recording) AS p FROM fu GROUP BY recording, {cols}) GROUP BY 1)"


def _pte(x: str, y: str, f: str) -> str:
    return f"(SELECT h1.recording, (h1.h - h2.h - h3.h + h4.h) / log2(7) AS v FROM {_h(y)} h1 JOIN {_h(f'{y}, {x}')} h2 USING (recording) JOIN {_h(f'{f}, {y}')} h3 USING (recording) JOIN {_h(f'{f}, {y}, {x}')} h4 USING (recording))"


@query(f"""WITH {_BIN}, fu AS (SELECT * FROM (SELECT *, lead(bx, 2) OVER w AS fx, lead(b, 2) OVER w AS fy FROM bn WINDOW w AS (PARTITION BY recording ORDER BY t)) WHERE fx IS NOT NULL), a AS {_pte("bx", "b", "fy")}, z AS {_pte("b", "bx", "fx")}
 SELECT recording, 'px' AS src, 'py' AS dst, {rsql('a.v')} AS pte, {rsql('a.v / nullif(a.v + z.v, 0)', 5)} AS dpte FROM a JOIN z USING (recording) UNION ALL SELECT recording, 'py', 'px', {rsql('z.v')}, {rsql('z.v / nullif(a.v + z.v, 0)', 5)} FROM a JOIN z USING (recording)""")
def pte_from_phase(spark, sf):
    out = cn.phase_transfer_entropy(_bins(spark, sf), ["px", "py"], 2, KEY, 0.9)
    return out.select("recording", "src", "dst", rounded("pte").alias("pte"), rounded("dpte", 5).alias("dpte"))


@query(f"""WITH {EV}, m AS (SELECT recording, t, x - avg(x) OVER (PARTITION BY recording) AS px, y - avg(y) OVER (PARTITION BY recording) AS py FROM ev),
 f AS (SELECT recording, coalesce(CAST(lag(px) OVER w * lead(px) OVER w < 0 AS INTEGER), 0) + coalesce(CAST(lag(py) OVER w * lead(py) OVER w < 0 AS INTEGER), 0) AS f FROM m WINDOW w AS (PARTITION BY recording ORDER BY t))
 SELECT recording, CAST(round_even((count(*) - 2) * 2 / nullif(sum(f), 0)::DOUBLE, 0) AS BIGINT) AS delay FROM f GROUP BY 1""")
def pte_delay(spark, sf):
    from pyspark.sql import Window

    over = Window.partitionBy("recording")
    df = events(spark, sf).select("recording", "t", (F.col("x") - F.avg("x").over(over)).alias("px"), (F.col("y") - F.avg("y").over(over)).alias("py"))
    return cn.pte_delay(df, ["px", "py"], KEY)


def _dft_whole(grid: str) -> str:
    """Spectra of one Hann segment over each recording's n samples, on m frequencies (grid: of max(n))."""
    turn = f"2 * {PI} * k * t / m"
    return f"""{EV}, wn AS (SELECT recording, t, x - avg(x) OVER r AS x, y - avg(y) OVER r AS y, count(*) OVER r AS n FROM ev WINDOW r AS (PARTITION BY recording)),
 hw AS (SELECT *, CASE WHEN n = 1 THEN 1.0 ELSE 0.5 - 0.5 * cos(2 * {PI} * t / n) END AS w FROM wn), gr AS (SELECT recording, 100.0 * sum(w * w) AS d, {grid} AS m FROM hw GROUP BY 1), k AS (SELECT recording, d, m, unnest(range(0, m)) AS k FROM gr),
 ft AS (SELECT recording, k, m, d, sum(w * x * cos({turn})) AS xr, -sum(w * x * sin({turn})) AS xi, sum(w * y * cos({turn})) AS yr, -sum(w * y * sin({turn})) AS yi FROM hw JOIN k USING (recording) GROUP BY 1, 2, 3, 4),
 cs AS (SELECT recording, (CASE WHEN 2 * k < m THEN k ELSE k - m END) * (1.0 / (m * 0.01::DOUBLE)) AS freq, xr, xi, yr, yi, d FROM ft)"""


@query(f"""WITH {_dft_whole('max(n)')} SELECT recording, 0 AS src, 0 AS dst, {rsql('freq', 4)} AS freq, {rsql('(xr * xr + xi * xi) / d', 4)} AS re, 0.0::DOUBLE AS im FROM cs
 UNION ALL SELECT recording, 0, 1, {rsql('freq', 4)}, {rsql('(xr * yr + xi * yi) / d', 4)}, {rsql('(xr * yi - xi * yr) / d', 4)} FROM cs UNION ALL SELECT recording, 1, 1, {rsql('freq', 4)}, {rsql('(yr * yr + yi * yi) / d', 4)}, 0.0 FROM cs""")
def csd_whole(spark, sf):
    out = spectral.cross_spectra(events(spark, sf), ["x", "y"], 100.0, KEY)
    return out.select("recording", "src", "dst", rounded("freq", 4).alias("freq"), rounded("re", 4).alias("re"), rounded("im", 4).alias("im"))


@query(f"""WITH {_dft_whole('max(max(n)) OVER ()')}, f AS (SELECT freq, sum((xr * yi - xi * yr) / d) AS s, sum(abs((xr * yi - xi * yr) / d)) AS a FROM cs WHERE freq > 4 AND freq < 30 GROUP BY 1) SELECT 0 AS src, 1 AS dst, {rsql('avg(s / nullif(a, 0))')} AS wpli FROM f""")
def wpli_whole(spark, sf):
    df = events(spark, sf)
    longest = df.agg(F.max("t")).first()[0]  # trials of any length meet on the longest one's frequencies
    out = spectral.cross_spectra(df, ["x", "y"], 100.0, KEY, points=None if longest is None else longest + 1)
    return cn.wpli(out, 4.0, 30.0).withColumn("wpli", rounded("wpli"))


def _analytic_whole(c: str, name: str) -> str:
    """The Hilbert kernel of n points: 2 / n * cot(pi d / n) at odd d for even n, (cot(pi d / n) - (-1)^d / sin(pi d / n)) / n for odd n."""
    turn = f"({PI} * (a.t - b.t) / a.n)"
    kernel = f"CASE WHEN a.t = b.t OR (a.n % 2 = 0 AND (a.t - b.t) % 2 = 0) THEN 0 WHEN a.n % 2 = 0 THEN 2.0 / a.n / tan{turn} ELSE (1 / tan{turn} - (CASE WHEN (a.t - b.t) % 2 = 0 THEN 1 ELSE -1 END) / sin{turn}) / a.n END"
    return f"{name} AS (SELECT a.recording, a.t, a.n, a.{c} AS re, sum(b.{c} * {kernel}) AS im FROM en a JOIN en b ON a.recording = b.recording GROUP BY a.recording, a.t, a.n, a.{c})"


_EN = f"{EV}, en AS (SELECT recording, t, x, y, count(*) OVER (PARTITION BY recording) AS n FROM ev)"


@query(f"WITH {_EN}, {_analytic_whole('x', 'z')} SELECT recording, t, {rsql('re')} AS re, {rsql('im')} AS im, {rsql('sqrt(re * re + im * im)')} AS amplitude FROM z")
def hilbert_whole(spark, sf):
    return spectral.hilbert(events(spark, sf), "x", KEY).select("recording", "t", *[rounded(c).alias(c) for c in ("re", "im", "amplitude")])


@query(f"""WITH {_EN}, {_analytic_whole('x', 'z1')}, {_analytic_whole('y', 'z2')}, c AS (SELECT z1.recording, z1.t, z1.n, z1.re * z2.re + z1.im * z2.im AS a, z1.im * z2.re - z1.re * z2.im AS b FROM z1 JOIN z2 ON z1.recording = z2.recording AND z1.t = z2.t),
 u AS (SELECT recording, t, n, coalesce(a / nullif(sqrt(a * a + b * b), 0), 0) AS a, coalesce(b / nullif(sqrt(a * a + b * b), 0), 0) AS b FROM c), k AS (SELECT recording, unnest(range(0, max(n))) AS k FROM u GROUP BY 1),
 p AS (SELECT recording, k, n, CASE WHEN k = 0 THEN 0 ELSE pow(sum(a * cos(2 * {PI} * k * t / n) + b * sin(2 * {PI} * k * t / n)), 2) + pow(sum(b * cos(2 * {PI} * k * t / n) - a * sin(2 * {PI} * k * t / n)), 2) END AS p FROM u JOIN k USING (recording) GROUP BY 1, 2, 3)
 SELECT recording, 'x' AS src, 'y' AS dst, {rsql("sum(CASE WHEN abs(CASE WHEN 2 * k < n THEN k ELSE k - n END) * (1.0 / (n * 0.01::DOUBLE)) < 13 THEN p ELSE 0 END) / nullif(sum(p), 0)", 5)} AS plm FROM p GROUP BY 1""")
def plm_whole(spark, sf):
    return cn.phase_linearity(events(spark, sf), ["x", "y"], 13.0, 100.0, KEY).withColumn("plm", rounded("plm", 5))


# ---- filters

TAPS = [0.1, 0.2, 0.4, 0.2, 0.1]
_FIR = f"""{EV}, e AS (SELECT recording, t, abs(x) AS x, max(t) OVER (PARTITION BY recording) AS n FROM ev), tp AS (SELECT unnest([-2, -1, 0, 1, 2]) AS k, unnest([0.1, 0.2, 0.4, 0.2, 0.1]::DOUBLE[]) AS h),
 fl AS (SELECT a.recording, a.t, sum(h * b.x) AS filtered FROM e a, tp JOIN e b ON b.recording = a.recording AND b.t = least(greatest(a.t - k, 0), a.n) GROUP BY 1, 2)"""


@query(f"WITH {_FIR} SELECT recording, t, {rsql('filtered')} AS filtered FROM fl")
def fir_lowpass(spark, sf):
    df = events(spark, sf).select("recording", "t", F.abs("x").alias("x"))
    return spectral.fir(df, "x", TAPS, KEY).select("recording", "t", rounded("filtered").alias("filtered"))


_H9 = [float(v) for v in spectral.nm.low_pass(9, 10.0, 100.0)]


@query(f"""WITH {EV}, e AS (SELECT recording, t, pow(abs(x) + 2.220446049250313e-16, 1.0 / 3) AS x, max(t) OVER (PARTITION BY recording) AS n FROM ev), tp AS (SELECT unnest(range(-4, 5)) AS k, unnest({_H9}::DOUBLE[]) AS h),
 fl AS (SELECT a.recording, a.t, sum(h * b.x) AS f FROM e a, tp JOIN e b ON b.recording = a.recording AND b.t = least(greatest(a.t - k, 0), a.n) GROUP BY 1, 2) SELECT recording, t, {rsql('(f - min(f) OVER w) / (max(f) OVER w - min(f) OVER w)')} AS envelope FROM fl WINDOW w AS (PARTITION BY recording)""")
def envelope_rectify(spark, sf):
    return spectral.envelope(events(spark, sf), "x", 100.0, 10.0, KEY, taps=9).select("recording", "t", rounded("envelope").alias("envelope"))


@query()
def envelope_hilbert_resampled(spark, sf):
    return spectral.envelope(events(spark, sf), "x", 100.0, 10.0, KEY, method="hilbert", taps=9, resample=25.0).select("recording", "t", rounded("envelope").alias("envelope"))


_MORLET = spectral.nm.morlet(20.0, 100.0, 2.0)


@query(f"""WITH {EV}, w AS (SELECT unnest(range(0, {len(_MORLET)})) - {(len(_MORLET) - 1) // 2} AS k, unnest({[float(v.real) for v in _MORLET]}::DOUBLE[]) AS wr, unnest({[float(v.imag) for v in _MORLET]}::DOUBLE[]) AS wi)
 SELECT a.recording, a.t, {rsql('pow(sum(wr * b.x), 2) + pow(sum(wi * b.x), 2)', 3)} AS power FROM ev a, w JOIN ev b ON b.recording = a.recording AND b.t = a.t - k GROUP BY 1, 2""")
def morlet_power(spark, sf):
    out = spectral.wavelets(events(spark, sf), "x", [20.0], 100.0, KEY, cycles=2.0)
    return out.select("recording", "t", rounded(F.col("re") * F.col("re") + F.col("im") * F.col("im"), 3).alias("power"))


@query(f"""WITH RECURSIVE {EV}, r AS (SELECT recording, t, x, 0.2137777 * x AS v, x AS x1, 0.2137777 * x AS y1, 0.0::DOUBLE AS y2, 0.0::DOUBLE AS x2 FROM ev WHERE t = 0
 UNION ALL SELECT e.recording, e.t, e.x, 0.2137777 * e.x + 0.1093 * r.x1 + 0.4871 * r.y1 - 0.2519 * r.y2, e.x, 0.2137777 * e.x + 0.1093 * r.x1 + 0.4871 * r.y1 - 0.2519 * r.y2, r.y1, r.x1 FROM r JOIN ev e ON e.recording = r.recording AND e.t = r.t + 1) SELECT recording, t, 0 AS band, {rsql('v', 5)} AS value FROM r""")
def filterbank(spark, sf):
    return spectral.filterbank(events(spark, sf), "x", [([0.2137777, 0.1093], [1.0, -0.4871, 0.2519])], KEY).withColumn("value", rounded("value", 5))


@query(f"""WITH p AS (SELECT CAST(p_partkey AS BIGINT) AS p_partkey, p_size * 0.05 AS w FROM part) SELECT p_partkey, {rsql('sqrt(pow(0.2 + 0.1 * cos(w), 2) + pow(0.1 * sin(w), 2)) / sqrt(pow(1 - 0.5 * cos(w) + 0.25 * cos(2 * w), 2) + pow(-0.5 * sin(w) + 0.25 * sin(2 * w), 2))')} AS gain FROM p""")
def frequency_response(spark, sf):
    points = load(spark, sf, "part").select(F.col("p_partkey").cast("long").alias("p_partkey"), (F.col("p_size") * 0.05).alias("w"))
    return spectral.frequency_response([0.2, 0.1], [1.0, -0.5, 0.25], points).select("p_partkey", rounded("gain").alias("gain"))


# ---- scalar functions


@query(f"SELECT p_partkey, {rsql('21.4 * log10(p_retailprice * 0.00437 + 1)')} AS erb, {rsql('(pow(10, p_size / 21.4) - 1) / 4.37e-3', 4)} AS hz, {rsql('24.7 * (p_retailprice * 0.00437 + 1) * 1.019', 4)} AS width FROM part")
def erb_scale(spark, sf):
    p = load(spark, sf, "part")
    f, e = F.col("p_retailprice"), F.col("p_size").cast("double")
    return p.select("p_partkey", rounded(scalars.hz_to_erb(f)).alias("erb"), rounded(scalars.erb_to_hz(e), 4).alias("hz"), rounded(scalars.erb_width(f), 4).alias("width"))


@query(f"""WITH e AS (SELECT 21.4 * log10(80 * 0.00437 + 1) AS a, 21.4 * log10(8000 * 0.00437 + 1) AS b) SELECT CAST(i AS INTEGER) AS channel, {rsql('(pow(10, (a + (b - a) * i / 31) / 21.4) - 1) / 4.37e-3', 5)} AS cf FROM e, range(0, 32) r(i)""")
def centre_freqs(spark, sf):
    return spark.createDataFrame([(i, round(f, 5) + 0.0) for i, f in enumerate(scalars.centre_freqs(80, 8000, 32))], "channel int, cf double")


@query(f"SELECT p_partkey, {rsql('5 / (1 + exp(0.3 * (20 - p_size)))')} AS s FROM part")
def sigmoid(spark, sf):
    return load(spark, sf, "part").select("p_partkey", rounded(scalars.sigmoid(F.col("p_size"), 5.0, 0.3, 20.0)).alias("s"))


@query(f"WITH s AS (SELECT p_partkey, 5 / (1 + exp(0.3 * (20 - p_size))) AS s FROM part) SELECT p_partkey, {rsql('0.3 * s * (1 - s)')} AS d FROM s")
def sigmoid_derivative(spark, sf):
    return load(spark, sf, "part").select("p_partkey", rounded(scalars.sigmoid_derivative(F.col("p_size"), 5.0, 0.3, 20.0)).alias("d"))


@query("SELECT 10.0::DOUBLE AS transition, 44100.0::DOUBLE AS srate, 23519 AS taps")
def fir_order(spark, sf):
    return spark.createDataFrame([(10.0, 44100.0, scalars.fir_order(10.0, 44100.0, ripples=1e-3))], "transition double, srate double, taps int")


@query(f"SELECT p_partkey, {rsql('pow(p_retailprice, 0.3)')} AS root, {rsql('greatest(20 * log10(p_retailprice), -200)')} AS log, {rsql('pow(p_retailprice, 0.5)')} AS power, {rsql('10 * log10(p_retailprice + 1e-16)')} AS db FROM part")
def compression(spark, sf):
    c = F.col("p_retailprice")
    return load(spark, sf, "part").select("p_partkey", rounded(scalars.compress(c)).alias("root"), rounded(scalars.compress(c, "log")).alias("log"), rounded(scalars.compress(c, 0.5)).alias("power"), rounded(scalars.decibels(c)).alias("db"))


@query("WITH p AS (SELECT p_partkey, pow(10, -p_size / 10.0) * 0.0499 * 3 AS p FROM part) SELECT p_partkey, CASE WHEN p < 0.05 THEN repeat('*', CAST(floor(log10(0.05 / p)) AS INTEGER) + 1) ELSE 'n. s.' END AS stars FROM p")
def significance_stars(spark, sf):
    p = F.pow(F.lit(10.0), -F.col("p_size") / 10.0) * F.lit(0.0499) * 3
    return load(spark, sf, "part").select("p_partkey", scalars.stars(p).alias("stars"))


# ---- solvers and group statistics

_LI = f"""WITH lo AS (SELECT 1.0 AS one, l_quantity / 50 AS q, l_discount AS d, l_tax AS x FROM lineitem), {sums_sql("g", "lo", ["one", "q", "d"], ["x"], alpha="2.0")}, {solve_sql("g", 3)}
 SELECT i AS name, {rsql('CASE i WHEN 0 THEN a_0_3 WHEN 1 THEN a_1_3 ELSE a_2_3 END', 7)} AS coef FROM s2, (SELECT CAST(unnest([0, 1, 2]) AS INTEGER) AS i)"""


def _lineitem(spark, sf):
    return load(spark, sf, "lineitem").select(F.lit(1.0).alias("one"), (F.col("l_quantity") / 50).alias("q"), F.col("l_discount").alias("d"), F.col("l_tax").alias("x"))


@query(_LI)
def solver_conjugate_gradient(spark, sf):
    df = _lineitem(spark, sf)
    columns = ["one", "q", "d"]
    b = np.array([v for v in df.agg(*[F.sum(F.col(c) * F.col("x")) for c in columns]).first()])
    diagonal = np.array([v for v in df.agg(*[F.sum(F.col(c) * F.col(c)) for c in columns]).first()])
    x = solvers.conjugate_gradient(solvers.normal_product(df, columns), b, ridge=2.0, precondition=solvers.jacobi(diagonal + 2.0))
    return spark.createDataFrame([(i, round(float(v), 7) + 0.0) for i, v in enumerate(x)], "name int, coef double")


@query(_LI)
def solver_svd(spark, sf):
    from ..operators.gram import gram_matrix

    g = gram_matrix(_lineitem(spark, sf), ["one", "q", "d", "x"])
    x = solvers.truncated(g[:3, :3], g[:3, 3], ridge=2.0)
    return spark.createDataFrame([(i, round(float(v), 7) + 0.0) for i, v in enumerate(x)], "name int, coef double")


@query(f"""SELECT event_type, {rsql('quantile_cont(value, 0.25)')} AS q1, {rsql('quantile_cont(value, 0.5)')} AS q2, {rsql('quantile_cont(value, 0.75)')} AS q3 FROM events GROUP BY 1""")
def quartiles(spark, sf):
    q = lambda p: rounded(F.percentile("value", p))
    return load(spark, sf, "events").groupBy("event_type").agg(q(0.25).alias("q1"), q(0.5).alias("q2"), q(0.75).alias("q3"))


@query(f"WITH {EV}, d AS (SELECT recording, x - y AS d FROM ev) SELECT recording, {rsql('avg(d) / (stddev_samp(d) / sqrt(count(*)))')} AS t, count(*) - 1 AS dof FROM d GROUP BY 1")
def paired_t(spark, sf):
    d = F.col("x") - F.col("y")
    return events(spark, sf).groupBy("recording").agg(rounded(F.avg(d) / (F.stddev_samp(d) / F.sqrt(F.count("*")))).alias("t"), (F.count("*") - 1).alias("dof"))


@query()
def cca_activation(spark, sf):
    df = embeddings(spark, sf, 6)
    _, b, _ = cv.canonical(df, ["e0", "e1", "e2"], ["e3", "e4", "e5"])
    n, _, s = cv.moments(df, ["e3", "e4", "e5"])
    a = cv.activation(s / (n - 1), b)
    return spark.createDataFrame([(i, j, round(float(a[i, j]), 6) + 0.0) for i in range(3) for j in range(3)], "channel int, component int, weight double")


# ---- words

_LINES = "ln AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line_no FROM documents)"
_WORDS = f"{_LINES}, wl AS (SELECT doc_id, line_no, list_filter(string_split_regex(line, '\\s+'), lambda w: w <> '') AS ws FROM ln), wd AS (SELECT doc_id, line_no, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS position FROM wl)"


@query(f"WITH {_WORDS} SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, word, CAST(position AS INTEGER) AS position FROM wd")
def sentence_position(spark, sf):
    return text_tables.sentence_positions(lines(spark, sf), ["doc_id"]).select("doc_id", "line_no", "word", "position")


_FREQ = f"{_WORDS}, fr AS (SELECT lower(word) AS word, count(*) AS frequency FROM wd GROUP BY 1), al AS (SELECT sum(frequency)::DOUBLE AS n FROM fr)"


def _frequencies(spark, sf):
    w = text_tables.sentence_positions(lines(spark, sf), ["doc_id"]).select("doc_id", F.lower("word").alias("word"))
    fr = w.groupBy("word").agg(F.count("*").alias("frequency"))
    total = fr.agg(F.sum("frequency").cast("double").alias("n"))  # one row
    return w, fr.crossJoin(F.broadcast(total))


@query(f"WITH {_FREQ} SELECT word, frequency, {rsql('-ln(CASE WHEN frequency < 2 THEN 0.5 ELSE frequency END / n)')} AS wordfrequency FROM fr, al")
def word_frequency(spark, sf):
    _, fr = _frequencies(spark, sf)
    fr = fr.withColumn("known", F.when(F.col("frequency") < 2, -1).otherwise(F.col("frequency")))
    out = text_tables.word_frequency(fr, "known", 0.5, 1.0).withColumn("wordfrequency", F.col("wordfrequency") + F.log("n"))
    return out.select("word", "frequency", rounded("wordfrequency").alias("wordfrequency"))


@query(f"WITH {_FREQ} SELECT doc_id, count(*) AS n_words, {rsql('avg(-ln(frequency / n + 1e-12))')} AS surprisal FROM (SELECT doc_id, lower(word) AS word FROM wd) JOIN fr USING (word), al WHERE word NOT IN ('</s>', '''') GROUP BY 1")
def surprisal(spark, sf):
    w, fr = _frequencies(spark, sf)
    table = w.join(fr.select("word", (F.col("frequency") / F.col("n")).alias("p")), "word")
    return text_tables.surprisal(table).groupBy("doc_id").agg(F.count("*").alias("n_words"), rounded(F.avg("surprisal")).alias("surprisal"))


_GRID = f"""{EV}, o AS (SELECT recording, t, x, CAST(round_even(t * 0.37 * 2.0, 0) AS BIGINT) AS s FROM ev), d AS (SELECT recording, t, x, CASE WHEN s = lag(s) OVER (PARTITION BY recording ORDER BY t) THEN s + 1 ELSE s END AS sample FROM o),
 l AS (SELECT recording, sample, max_by(x, t) AS x FROM d GROUP BY 1, 2), n AS (SELECT recording, CAST(ceil((count(*) * 0.37 + 1.0) * 2.0) AS BIGINT) AS n FROM ev GROUP BY 1), g AS (SELECT recording, unnest(range(0, n)) AS sample FROM n)"""


def _grid(spark, sf):
    df = events(spark, sf).withColumn("onset", F.col("t") * 0.37)
    n = df.groupBy("recording").agg((F.count("*") * F.lit(0.37) + 1.0).alias("duration"))
    return words.word_grid(df, ["x"], 2.0, n, KEY, order="t")


@query(f"WITH {_GRID} SELECT recording, sample, CASE WHEN x IS NULL THEN 0.0 ELSE 1.0 END AS word_onset, coalesce(x, 0.0) AS x FROM g LEFT JOIN l USING (recording, sample)")
def word_onsets_grid(spark, sf):
    return _grid(spark, sf)


@query(f"WITH {_GRID}, f AS (SELECT recording, sample, coalesce(x, 0.0) AS x FROM g LEFT JOIN l USING (recording, sample)) SELECT f.recording, f.sample, f.x, ev.y AS depth_0, ev.x AS depth_1 FROM f JOIN ev ON ev.recording = f.recording AND ev.t = f.sample")
def add_feature_join(spark, sf):
    new = events(spark, sf).select("recording", F.col("t").alias("sample"), F.array("y", "x").alias("v"))
    return words.add_feature(_grid(spark, sf).select("recording", "sample", "x"), new, ["recording", "sample"], "depth", "v", 2)


@query(f"""WITH {EV}, s AS (SELECT DISTINCT recording, recording % 3 AS segment, (recording % 7) * 0.5 + 0.125 AS onset FROM ev), f AS (SELECT *, CAST(round_even(onset * 4.0, 0) AS BIGINT) AS first, 13 AS samples FROM s)
 SELECT ev.recording, segment, t, t - first AS sample, x FROM ev JOIN f ON f.recording = ev.recording AND t >= first AND t < first + samples""")
def segment_slice(spark, sf):
    df = events(spark, sf)
    seg = df.select("recording").distinct().select("recording", (F.col("recording") % 3).alias("segment"), ((F.col("recording") % 7) * F.lit(0.5) + 0.125).alias("onset"), F.lit(3.2).alias("duration"))
    return words.slice_segments(df, seg, 4.0, KEY).select("recording", "segment", "t", "sample", "x")


@query(f"WITH {EV} SELECT recording, t, x, NULL::DOUBLE AS y FROM ev WHERE event_type = 'click' UNION ALL SELECT recording, t, NULL, y FROM ev WHERE event_type = 'error'")
def concat_segments(spark, sf):
    df = events(spark, sf)
    return words.append_segments(df.filter("event_type = 'click'").select("recording", "t", "x"), df.filter("event_type = 'error'").select("recording", "t", "y"))


@query(f"""WITH v AS (SELECT lower('W' || vec_id) AS word, embedding FROM embeddings), q AS (SELECT event_id, 'w' || (event_id % 3000) AS word FROM events)
 SELECT event_id, q.word, {rsql('coalesce(CAST(embedding[1] AS DOUBLE), 0.0)')} AS v0, {rsql('coalesce(CAST(embedding[64] AS DOUBLE), 0.0)')} AS v63 FROM q LEFT JOIN v USING (word)""")
def word_vector_lookup(spark, sf):
    vec = load(spark, sf, "embeddings").select(F.concat(F.lit("W"), F.col("vec_id")).alias("word"), F.col("embedding").alias("vec"))
    q = load(spark, sf, "events").select("event_id", F.concat(F.lit("w"), F.col("event_id") % 3000).alias("word"))
    return words.word_vectors(q, vec, dims=64).select("event_id", "word", rounded(F.col("vec")[0]).alias("v0"), rounded(F.col("vec")[63]).alias("v63"))


@query(f"SELECT event_type, count(*) AS n, {rsql('avg(value)')} AS mean, {rsql('stddev_samp(value)')} AS sd, min(value) AS low, {rsql('quantile_cont(value, 0.5)')} AS middle, max(value) AS top FROM events GROUP BY 1")
def summary_stats(spark, sf):
    v = F.col("value")
    return load(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"), rounded(F.avg(v)).alias("mean"), rounded(F.stddev_samp(v)).alias("sd"), F.min(v).alias("low"), rounded(F.percentile(v, 0.5)).alias("middle"), F.max(v).alias("top"))


from . import analysis, auditory, files, simulated  # noqa: E402, F401 (they register their queries, some with the SQL of those above)
