"""Queries of estimators that work on executors or choose their own parameters, with the SQL of cases that have a closed form."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..operators import connectivity as cn
from ..operators import covariance as cv
from ..operators import response, spectral, windows
from .queries import _EN, PI, _analytic_whole, _dft_whole
from .registry import query
from .tables import EV, KEY, ORDER, emb_sql, embeddings, events, lagged_sql, load, rounded, rsql, solve_sql, sums_sql

# ---- response models by subject

_ALPHAS = [0.0, 50.0, 100000.0]
_SUBJECT_CV = f"""WITH {EV}, {lagged_sql([0, 1])}, v AS (SELECT * FROM lg WHERE x_1 IS NOT NULL), i AS (SELECT *, row_number() OVER (PARTITION BY recording ORDER BY t) - 1 AS i, count(*) OVER (PARTITION BY recording) AS n FROM v),
 f AS (SELECT recording, x_0, x_1, y, CASE WHEN i < (n // 3 + 1) * (n % 3) THEN i // (n // 3 + 1) ELSE n % 3 + (i - (n // 3 + 1) * (n % 3)) // (n // 3) END AS fold FROM i),
 k AS (SELECT unnest({_ALPHAS}::DOUBLE[]) AS alpha, h.held FROM (SELECT unnest([0, 1, 2]) AS held) h), {sums_sql("g", "f, k", ["x_0", "x_1"], ["y"], keys="recording, alpha, held", alpha="alpha", where="fold <> held")}, {solve_sql("g", 2, 1, "recording, alpha, held")},
 sc AS (SELECT recording, alpha, 'y' AS channel, CAST(held AS INTEGER) AS fold, corr(a_0_2 * x_0 + a_1_2 * x_1, y) AS score FROM f JOIN s1 USING (recording) WHERE fold = held GROUP BY recording, alpha, held)"""


def _subject_cv(spark, sf):
    return response.ResponseModel([0, 1], _ALPHAS, intercept=False).cross_validate(events(spark, sf), ["x"], ["y"], KEY, ORDER, 3, by=KEY)


@query(f"{_SUBJECT_CV} SELECT recording, alpha, channel, fold, {rsql('score')} AS score FROM sc")
def trf_subject_scores(spark, sf):
    return _subject_cv(spark, sf).withColumn("score", rounded("score"))


@query(f"{_SUBJECT_CV}, m AS (SELECT recording, alpha, avg(score) AS score FROM sc GROUP BY 1, 2) SELECT recording, first(alpha ORDER BY round(score, 9) DESC, alpha) AS alpha, {rsql('max(score)')} AS score FROM m GROUP BY 1")
def trf_subject_alpha(spark, sf):
    scores = _subject_cv(spark, sf).groupBy("recording", "alpha", "channel").agg(F.round(F.avg("score"), 9).alias("score"))
    return response.best_alpha(scores, KEY).withColumn("score", rounded("score"))


@query(f"{_SUBJECT_CV} SELECT recording, {rsql('median(score)')} AS score, {rsql('sum(score)')} AS total FROM sc GROUP BY 1")
def trf_reduced_scores(spark, sf):
    scores = _subject_cv(spark, sf).cache()
    total = response.reduce_scores(scores, KEY, "sum").select("recording", rounded("score").alias("total"))
    return response.reduce_scores(scores, KEY, lambda c: F.median(c)).withColumn("score", rounded("score")).join(total, "recording")


@query("SELECT 2.0::DOUBLE AS alpha, l AS lag, 'x' AS feature, 'y' AS channel, CASE l WHEN 1 THEN 0.5 WHEN 3 THEN -1.5 ELSE 0.0 END::DOUBLE AS coef FROM (SELECT CAST(unnest([0, 1, 2, 3]) AS INTEGER) AS l)")
def model_from_array(spark, sf):
    return response.fill_lags(response.from_array(spark, np.array([0.5, -1.5]).reshape(2, 1, 1), [1, 3], ["x"], ["y"], 2.0), range(4))


_T = "(p_size / 10.0::DOUBLE)"


@query(f"SELECT p_partkey, {rsql(f'1 - {_T} / sqrt(2 + {_T} * {_T})', 9)} AS p2, {rsql(f'1 - {_T} / sqrt(4 + {_T} * {_T}) * (1 + 2 / (4 + {_T} * {_T}))', 9)} AS p4 FROM part")
def student_p(spark, sf):
    t = F.col("p_size") / F.lit(10.0)
    return load(spark, sf, "part").select("p_partkey", rounded(response.p_value(t, F.lit(2.0)), 9).alias("p2"), rounded(response.p_value(t, F.lit(4.0)), 9).alias("p4"))


# ---- covariances


@query(f"WITH {emb_sql(3)} " + " UNION ALL ".join(f"SELECT label, 'e{i}' AS i, 'e{j}' AS j, {rsql(f'avg(e{i} * e{j})', 7)} AS v FROM em GROUP BY label" for i in range(3) for j in range(i, 3)))
def cov_function(spark, sf):
    out = cv.covariance(embeddings(spark, sf, 3), ["e0", "e1", "e2"], ["label"], lambda x: x.T @ x / len(x))
    return out.withColumn("v", rounded("v", 7))


@query(f"""WITH {emb_sql(1)}, o AS (SELECT label, e0, row_number() OVER (PARTITION BY label ORDER BY e0) AS r, count(*) OVER (PARTITION BY label) AS n FROM em), h AS (SELECT *, (n + 2) // 2 AS h FROM o),
 s AS (SELECT a.label, a.r, var_pop(b.e0) AS v FROM h a JOIN h b ON a.label = b.label AND b.r >= a.r AND b.r < a.r + a.h WHERE a.r <= a.n - a.h + 1 GROUP BY 1, 2) SELECT label, 'e0' AS i, 'e0' AS j, {rsql('min(v)', 7)} AS v FROM s GROUP BY 1""")
def cov_mcd_single(spark, sf):
    return cv.covariance(embeddings(spark, sf, 1), ["e0"], ["label"], "mcd").withColumn("v", rounded("v", 7))


@query(f"""WITH {emb_sql(2)}, c AS (SELECT label, covar_samp(e0, e0) - 0.012 AS a, covar_samp(e0, e1) AS b, covar_samp(e1, e1) - 0.012 AS c FROM em GROUP BY 1) SELECT label, a > 0 AND a * c - b * b > 0 AS definite FROM c""")
def positive_definite(spark, sf):
    return cv.definite(cv.covariance(embeddings(spark, sf, 2), ["e0", "e1"], ["label"]), ["label"], 0.012)


@query(f"""WITH {EV}, v AS (SELECT var_samp(x) FILTER (event_type = 'error') AS sy, var_samp(x) FILTER (event_type <> 'error') AS sc FROM ev)
 SELECT recording, t, {rsql('x - x * greatest(sy - sc, 0) / sy')} AS clean0 FROM ev, v""")
def wiener_filter_one_component(spark, sf):
    out = cv.ArtefactFilter(1).fit(events(spark, sf), ["x"], F.col("event_type") == "error").transform(events(spark, sf))
    return out.select("recording", "t", rounded("clean0").alias("clean0"))


@query(f"WITH {emb_sql(2)}, r AS (SELECT abs(corr(e0, e1)) AS r FROM em) SELECT 0 AS component, {rsql('1 + r')} AS variance FROM r UNION ALL SELECT 1, {rsql('1 - r')} FROM r")
def mcca_pair(spark, sf):
    _, v = cv.multiway(embeddings(spark, sf, 2), [["e0"], ["e1"]], 1)
    return spark.createDataFrame([(i, round(float(x), 6) + 0.0) for i, x in enumerate(v)], "component int, variance double")


# of two single columns each component holds half of a column
@query(f"WITH {emb_sql(2)} SELECT vec_id, {rsql('e0 / 2')} AS one, {rsql('e0')} AS both FROM em")
def mcca_denoise(spark, sf):
    df = embeddings(spark, sf, 2)
    transforms, _ = cv.multiway(df, [["e0"], ["e1"]], 1)
    out = cv.project(cv.project(df, ["e0"], cv.denoiser(transforms[0], 1), ["one"]), ["e0"], cv.denoiser(transforms[0], 2), ["both"])
    return out.select("vec_id", rounded("one").alias("one"), rounded("both").alias("both"))


@query(f"WITH {emb_sql(2)}, g AS (SELECT var_samp(e0) AS a, covar_samp(e0, e1) AS b, var_samp(e1) AS c FROM em) SELECT 0 AS component, {rsql('(a + c) / 2 + sqrt((a - c) * (a - c) / 4 + b * b)', 8)} AS variance FROM g UNION ALL SELECT 1, {rsql('(a + c) / 2 - sqrt((a - c) * (a - c) / 4 + b * b)', 8)} FROM g")
def pca_variances(spark, sf):
    _, v = cv.pca(embeddings(spark, sf, 2), ["e0", "e1"])
    return spark.createDataFrame([(i, round(float(x), 8) + 0.0) for i, x in enumerate(v)], "component int, variance double")


_W = {"u0": (0.6, 0.8), "u1": (1.0, -0.5)}


@query(f"WITH {emb_sql(2)} " + " UNION ALL ".join(f"SELECT 'e{i}' AS channel, '{u}' AS component, {rsql(f'corr(e{i}, {a!r}::DOUBLE * e0 + ({b!r})::DOUBLE * e1)')} AS r FROM em" for u, (a, b) in _W.items() for i in range(2)))
def component_correlations(spark, sf):
    df = cv.project(embeddings(spark, sf, 2), ["e0", "e1"], np.array(list(_W.values())).T, list(_W))
    return cv.component_correlations(df, ["e0", "e1"], list(_W)).withColumn("r", rounded("r"))


@query(f"WITH {emb_sql(2)}, g AS (SELECT var_samp(e0) AS a, covar_samp(e0, e1) AS b, var_samp(e1) AS c FROM em), m AS (SELECT *, 0.36 * a + 0.96 * b + 0.64 * c AS w FROM g) SELECT 0 AS channel, {rsql('(0.6 * a + 0.8 * b) / w')} AS activation FROM m UNION ALL SELECT 1, {rsql('(0.6 * b + 0.8 * c) / w')} FROM m")
def activation_map(spark, sf):
    n, _, s = cv.moments(embeddings(spark, sf, 2), ["e0", "e1"])
    a = cv.activation(s / (n - 1), np.array([[0.6], [0.8]]))
    return spark.createDataFrame([(i, round(float(v), 6) + 0.0) for i, v in enumerate(a[:, 0])], "channel int, activation double")


# one feature at lag 1 against both of y at lags 0 and 1: the correlation is the multiple one
_MULTIPLE = f"""WITH {EV}, {lagged_sql([0, 1], ("x", "y"))}, v AS (SELECT x_1 - avg(x_1) OVER () AS x, y_0 - avg(y_0) OVER () AS a, y_1 - avg(y_1) OVER () AS b FROM lg WHERE x_1 IS NOT NULL AND y_1 IS NOT NULL),
 {sums_sql("g", "v", ["a", "b"], ["x"])}, {solve_sql("g", 2)} SELECT 0 AS component, {rsql('sqrt(sum((a_0_2 * a + a_1_2 * b) * x) / sum(x * x))')} AS r FROM v, s1"""


def _lagged_cca(spark, sf, method: str, **options):
    m = cv.CanonicalModel([1], [0, 1], method, **options).fit(events(spark, sf), ["x"], ["y"], KEY, ORDER)
    return m, spark.createDataFrame([(i, round(float(v), 6) + 0.0) for i, v in enumerate(m.r)], "component int, r double")


@query(_MULTIPLE)
def cca_lagged(spark, sf):
    return _lagged_cca(spark, sf, "svd")[1]


@query(_MULTIPLE)
def cca_lagged_nt(spark, sf):
    return _lagged_cca(spark, sf, "nt")[1]


@query(_MULTIPLE)
def cca_lagged_nipals(spark, sf):
    return _lagged_cca(spark, sf, "nipals")[1]


@query(_MULTIPLE)
def cca_lagged_components(spark, sf):
    m, _ = _lagged_cca(spark, sf, "svd")
    out = m.transform(events(spark, sf), KEY, ORDER)
    return out.agg(F.lit(0).alias("component"), rounded(F.abs(F.corr("u0", "v0"))).alias("r"))


# ---- scalers, filters, spectra


@query(f"WITH {EV}, s AS (SELECT avg(x) AS m, stddev_pop(x) AS s FROM ev WHERE recording % 2 = 0) SELECT recording, t, {rsql('(x - m) / s')} AS z, {rsql('ln(1 + abs(y))')} AS g FROM ev, s")
def scaled_by_function(spark, sf):
    df = events(spark, sf)
    fitted = windows.Scaler().fit(df.filter(F.col("recording") % 2 == 0), "x")
    out = windows.scaled(windows.scaled(df, "x", fitted), "y", lambda c: F.log1p(F.abs(c)), "g")
    return out.select("recording", "t", rounded("z").alias("z"), rounded("g").alias("g"))


@query(f"WITH {EV} SELECT recording, t, CAST(unnest([0, 1]) AS INTEGER) AS band, {rsql('unnest([0.5 * x + 0.5 * coalesce(lag(x) OVER w, 0), x - coalesce(lag(x) OVER w, 0)])')} AS value FROM ev WINDOW w AS (PARTITION BY recording ORDER BY t)")
def filterbank_function(spark, sf):
    bank = [([0.5, 0.5], [1.0]), ([1.0, -1.0], [1.0])]
    out = spectral.filterbank(events(spark, sf), "x", bank, KEY, apply=lambda b, a, x: np.convolve(x, b)[: len(x)])
    return out.select("recording", "t", "band", rounded("value").alias("value"))


@query(f"WITH {_dft_whole('max(n)')} SELECT recording, first({rsql('freq', 4)} ORDER BY round((xr * xr + xi * xi) / d, 6) DESC, freq) AS freq FROM cs WHERE freq > 0 GROUP BY 1")
def dominant_frequency(spark, sf):
    out = spectral.cross_spectra(events(spark, sf), ["x"], 100.0, KEY)
    return spectral.dominant(out, KEY).select("recording", rounded("freq", 4).alias("freq"))


def _phase_bins_sql() -> str:
    return f"""{_EN}, {_analytic_whole('x', 'z1')}, {_analytic_whole('y', 'z2')}, ph AS (SELECT z1.recording, z1.t, z1.n, atan2(z1.im, z1.re) AS px, atan2(z2.im, z2.re) AS py FROM z1 JOIN z2 ON z1.recording = z2.recording AND z1.t = z2.t),
 sg AS (SELECT recording, t, CAST(coalesce(lag(px) OVER w * lead(px) OVER w < 0, false) AS INTEGER) + CAST(coalesce(lag(py) OVER w * lead(py) OVER w < 0, false) AS INTEGER) AS f FROM ph WINDOW w AS (PARTITION BY recording ORDER BY t)),
 dl AS (SELECT recording, CAST(round_even((count(*) - 2) * 2 / nullif(sum(f), 0)::DOUBLE, 0) AS BIGINT) AS delay FROM sg GROUP BY 1),
 wd AS (SELECT recording, 3.49 * (stddev_pop(px) + stddev_pop(py)) / 2 * pow(count(*), -1.0::DOUBLE / 3) AS width FROM ph GROUP BY 1),
 nb AS (SELECT recording, delay, width, CAST(ceil(2 * {PI} / width) AS INTEGER) AS bins FROM wd JOIN dl USING (recording)),
 bn AS (SELECT recording, t, delay, bins, least(CAST(floor((px + {PI}) / width) AS INTEGER), bins - 1) AS bx, least(CAST(floor((py + {PI}) / width) AS INTEGER), bins - 1) AS b FROM ph JOIN nb USING (recording)),
 fu AS (SELECT a.recording, a.bins, a.bx, a.b, z.bx AS fx, z.b AS fy FROM bn a JOIN bn z ON z.recording = a.recording AND z.t = a.t + a.delay)"""


def _h(cols: str) -> str:
    return f"(SELECT recording, bins, -sum(p * log2(p)) AS h FROM (SELECT recording, bins, count(*) / sum(count(*)) OVER (PARTITION BY recording) AS p FROM fu GROUP BY recording, bins, {cols}) GROUP BY 1, 2)"


def _pte(x: str, y: str, f: str) -> str:
    return f"(SELECT h1.recording, (h1.h - h2.h - h3.h + h4.h) / log2(h1.bins) AS v FROM {_h(y)} h1 JOIN {_h(f'{y}, {x}')} h2 USING (recording) JOIN {_h(f'{f}, {y}')} h3 USING (recording) JOIN {_h(f'{f}, {y}, {x}')} h4 USING (recording))"


@query(f"""WITH {_phase_bins_sql()}, a AS {_pte("bx", "b", "fy")}, z AS {_pte("b", "bx", "fx")}
 SELECT recording, 'x' AS src, 'y' AS dst, {rsql('a.v', 5)} AS pte, {rsql('a.v / nullif(a.v + z.v, 0)', 4)} AS dpte FROM a JOIN z USING (recording) UNION ALL SELECT recording, 'y', 'x', {rsql('z.v', 5)}, {rsql('z.v / nullif(a.v + z.v, 0)', 4)} FROM a JOIN z USING (recording)""")
def transfer_entropy(spark, sf):
    out = cn.transfer_entropy(events(spark, sf), ["x", "y"], KEY)
    return out.select("recording", "src", "dst", rounded("pte", 5).alias("pte"), rounded("dpte", 4).alias("dpte"))
