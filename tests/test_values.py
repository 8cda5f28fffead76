"""Queries and estimators without SQL against formulas written out."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavelake.operators import covariance as cv
from wavelake.operators import response
from wavelake.plans import queries as plans


def vectors(spark, sf, dims):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").collect()
    return np.array([r["embedding"][:dims] for r in rows], float), np.array([r["label"] for r in rows])


def rows(spark, sf, name):
    return plans.queries()[name](spark, sf).collect()


def sphere(x):
    """Orthonormal columns that span the centred columns of x."""
    x = x - x.mean(axis=0)
    u, s, _ = np.linalg.svd(x, full_matrices=False)
    return u[:, s > s[0] * 1e-10]


def test_cca_halves(spark, sf):
    x, _ = vectors(spark, sf, 64)
    r = np.linalg.svd(sphere(x[:, :32]).T @ sphere(x[:, 32:]), compute_uv=False)
    got = sorted(((v["component"], v["r"]) for v in rows(spark, sf, "cca_halves")))
    assert np.allclose([v for _, v in got], np.minimum(r, 1)[: len(got)], atol=2e-6)


def test_cca_activation(spark, sf):
    x, _ = vectors(spark, sf, 6)
    y = x[:, 3:] - x[:, 3:].mean(axis=0)
    a = np.zeros((3, 3))
    for v in rows(spark, sf, "cca_activation"):
        a[v["channel"], v["component"]] = v["weight"]
    # activations are the covariances of channels with components of variance 1 / (n - 1), over that variance: each is a combination that inverts the weights
    qx, qy = sphere(x[:, :3]), sphere(x[:, 3:])
    _, _, b = np.linalg.svd(qx.T @ qy)
    parts = qy @ b.T
    want = y.T @ parts
    assert np.allclose(np.abs(a), np.abs(want), atol=1e-5)


def test_mcca_variance(spark, sf):
    x, _ = vectors(spark, sf, 12)
    white = []
    for g in (0, 4, 8):
        y = x[:, g : g + 4] - x[:, g : g + 4].mean(axis=0)
        u, s, _ = np.linalg.svd(y, full_matrices=False)
        white.append(u[:, :3] * np.sqrt(len(x) - 1))
    want = np.linalg.eigvalsh(np.cov(np.concatenate(white, axis=1), rowvar=False))[::-1]
    got = sorted((v["component"], v["variance"], v["percent"]) for v in rows(spark, sf, "mcca_variance"))
    assert np.allclose([v for _, v, _ in got], want, atol=2e-6) and np.allclose([p for *_, p in got], want / 3 * 100, atol=2e-4)


def test_wiener_filter_of_low_rank(spark, sf):
    x, label = vectors(spark, sf, 4)
    sy, sc = np.cov(x[label < 3], rowvar=False), np.cov(x[label >= 3], rowvar=False)
    half = np.linalg.cholesky(sc)
    value, vector = np.linalg.eigh(np.linalg.inv(half) @ sy @ np.linalg.inv(half).T)
    gain = np.maximum(value - 1, 0) * (np.arange(4) >= 2)
    w = np.linalg.inv(sy) @ (half @ vector @ np.diag(gain) @ vector.T @ half.T)
    want = {i: row for i, row in enumerate(x - x @ w)}
    for r in rows(spark, sf, "wiener_filter_low_rank"):
        assert np.allclose([r[f"clean{i}"] for i in range(4)], want[r["vec_id"]], atol=2e-6)


def test_mcd_finds_the_tightest_half(spark):
    rng = np.random.default_rng(6)
    x = np.r_[rng.normal(size=(8, 2)) * 0.1, rng.normal(size=(3, 2)) * 3 + 9]
    df = spark.createDataFrame([(0, float(a), float(b)) for a, b in x], "g int, a double, b double")
    h = (len(x) + 3) // 2
    best = min((np.cov(x[list(pick)], rowvar=False, ddof=0) for pick in itertools.combinations(range(len(x)), h)), key=np.linalg.det)
    got = {(r["i"], r["j"]): r["v"] for r in cv.covariance(df, ["a", "b"], ["g"], "mcd").collect()}
    assert np.allclose([got["a", "a"], got["a", "b"], got["b", "b"]], [best[0, 0], best[0, 1], best[1, 1]])


def test_envelope_by_hilbert_and_resampling(spark, sf):
    from wavelake.operators import spectral
    from wavelake.plans.tables import KEY, events

    df = events(spark, sf)
    signals = {}
    for r in df.orderBy("recording", "t").collect():
        signals.setdefault(r["recording"], []).append(r["x"])
    h = np.asarray(spectral.nm.low_pass(9, 10.0, 100.0))
    got = {}
    for r in spectral.envelope(df, "x", 100.0, 10.0, KEY, method="hilbert", taps=9).collect():
        got.setdefault(r["recording"], {})[r["t"]] = r["envelope"]
    for k, x in signals.items():
        x = np.array(x)
        n = spectral.nm.fast_length(len(x))
        f = np.fft.fft(x, n)
        gain = np.zeros(n)
        gain[0], gain[1 : (n + 1) // 2] = 1, 2
        if n % 2 == 0:
            gain[n // 2] = 1
        a = (np.abs(np.fft.ifft(f * gain))[: len(x)] + np.finfo(float).eps) ** (1 / 3)
        y = np.array([sum(h[j] * a[min(max(t - j + 4, 0), len(a) - 1)] for j in range(9)) for t in range(len(a))])
        assert np.allclose([got[k][t] for t in range(len(x))], (y - y.min()) / (y.max() - y.min()))
    whole = rows(spark, sf, "envelope_hilbert_resampled")
    assert all(0 <= r["envelope"] <= 1 for r in whole) and len(whole) == sum(-(-len(x) // 4) for x in signals.values())


@pytest.mark.parametrize("method", ["svd", "nipals", "nt"])
def test_canonical_correlations_of_known_populations(spark, method):
    rng = np.random.default_rng(1)
    n = 4000
    x = rng.normal(size=(n, 7))
    y = np.column_stack([x[:, 0], x[:, 1], x[:, 2] + rng.normal(size=n), x[:, 3] + rng.normal(size=n), x[:, 4] + 3 * rng.normal(size=n), x[:, 5] + 3 * rng.normal(size=n), rng.normal(size=(n, 2))])
    names = [f"x{i}" for i in range(7)] + [f"y{i}" for i in range(8)]
    df = spark.createDataFrame([(0, t, *map(float, v)) for t, v in enumerate(np.c_[x, y])], ["recording", "t", *names])
    m = cv.CanonicalModel(method=method).fit(df, names[:7], names[7:], ["recording"], ["t"])
    assert np.allclose(m.r, [1, 1, 0.707, 0.707, 0.316, 0.316, 0], atol=0.06)
    out = m.transform(df, ["recording"], ["t"]).agg(*[F.abs(F.corr(f"u{i}", f"v{i}")) for i in range(5)]).first()
    assert np.allclose(out, m.r[:5], atol=1e-4)


def test_cross_validation_in_one_pass(spark):
    """Scores from fold Gram matrices are the correlations on the held-out rows; 60 lags make wide matrices, and subjects don't mix."""
    rng, lags = np.random.default_rng(4), list(range(60))
    data = {s: rng.normal(size=(400, 1)) for s in (1, 2)}
    kernel = {s: rng.normal(size=60) for s in data}
    table, want = [], {}
    for s, x in data.items():
        y = np.convolve(x[:, 0], kernel[s])[:400] + rng.normal(size=400)
        table += [(s, t, float(a), float(b)) for t, (a, b) in enumerate(zip(x[:, 0], y, strict=True))]
        design = np.stack([x[59 - k : 400 - k, 0] for k in lags], axis=1)
        target = y[59:]
        for f, held in enumerate(np.array_split(np.arange(len(target)), 3)):
            rest = np.setdiff1d(np.arange(len(target)), held)
            for alpha in (1.0, 1000.0):
                beta = np.linalg.solve(design[rest].T @ design[rest] + alpha * np.eye(60), design[rest].T @ target[rest])
                want[s, alpha, f] = np.corrcoef(design[held] @ beta, target[held])[0, 1]
    df = spark.createDataFrame(table, "recording long, t long, x double, y double")
    model = response.ResponseModel(lags, [1.0, 1000.0], intercept=False)
    got = {(r["recording"], r["alpha"], r["fold"]): r["score"] for r in model.cross_validate(df, ["x"], ["y"], ["recording"], ["t"], 3, by=["recording"]).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)
