"""Signal queries read every sample of every recording, however long it is."""

import datetime

import numpy as np
import pytest

from wavelake.functions import numeric as nm
from wavelake.plans import queries as plans

COUNTS = {1: 1, 2: 2, 3: 31, 4: 45, 5: 64, 6: 101}


@pytest.fixture(scope="module")
def signals():
    rng = np.random.default_rng(11)
    return {u: (rng.normal(size=n) * 3, rng.integers(0, 99, n).astype(float)) for u, n in COUNTS.items()}


@pytest.fixture(scope="module")
def uneven(spark, signals, tmp_path_factory):
    """An events table of recordings of 1 to 101 samples."""
    folder, rows = str(tmp_path_factory.mktemp("uneven")), []
    for u, (x, y) in signals.items():
        rows += [(u * 1000 + t, datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=t), u, "click", float(a), f'{{"k": {int(b)}}}') for t, (a, b) in enumerate(zip(x, y, strict=True))]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{folder}/events.parquet")
    return folder


@pytest.mark.parametrize("name", ["csd_whole", "wpli_whole", "hilbert_whole", "plm_whole"])
def test_sql_of_uneven_recordings(spark, uneven, name):
    import duckdb

    c = duckdb.connect()
    c.sql(f"CREATE VIEW events AS SELECT * FROM '{uneven}/events.parquet/*.parquet'")
    mine, theirs = plans.queries()[name](spark, uneven), c.sql(plans.oracle_sql()[name])
    at = [theirs.columns.index(x) for x in mine.columns]
    near = lambda rows: sorted([tuple(-1.0 if v is None or v != v else round(v, 3) + 0.0 if isinstance(v, float) else v for v in r) for r in rows], key=str)
    got, want = near(map(tuple, mine.collect())), near(tuple(r[i] for i in at) for r in theirs.fetchall())
    assert len(got) == len(want) and got
    for a, b in zip(got, want, strict=True):
        assert a == pytest.approx(b, abs=2e-3)


def test_spectra_and_analytic_signals_of_whole_recordings(spark, uneven, signals):
    csd = plans.queries()["csd_whole"](spark, uneven).collect()
    assert {u: sum(r["recording"] == u for r in csd) for u in COUNTS} == {u: 3 * n for u, n in COUNTS.items()}
    h = plans.queries()["hilbert_whole"](spark, uneven).collect()
    for u, (x, _) in signals.items():
        got = np.array([r["im"] for r in sorted((r for r in h if r["recording"] == u), key=lambda r: r["t"])])
        assert np.allclose(got, nm.analytic(x).imag, atol=1e-5)


def test_wpli_of_trials_on_one_grid(spark, uneven, signals):
    n = max(COUNTS.values())
    parts = []
    for x, y in signals.values():
        w = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(len(x)) / len(x)) if len(x) > 1 else np.ones(1)
        fx, fy = np.fft.fft((x - x.mean()) * w, n), np.fft.fft((y - y.mean()) * w, n)
        parts.append((np.conj(fx) * fy).imag / (100 * (w**2).sum()))
    s, freq = np.array(parts), np.fft.fftfreq(n, 0.01)
    band = (freq > 4) & (freq < 30)
    want = (s.sum(axis=0) / np.abs(s).sum(axis=0))[band].mean()
    assert abs(plans.queries()["wpli_whole"](spark, uneven).filter("src = 0 AND dst = 1").first()["wpli"] - want) < 1e-5


def test_auditory_queries_take_short_and_long_recordings_whole(spark, uneven, signals):
    out = plans.queries()["gammatone"](spark, uneven).collect()
    for u, (x, _) in signals.items():
        got = [r["envelope"] for r in sorted((r for r in out if r["recording"] == u), key=lambda r: r["t"])]
        assert len(got) == len(x) and np.allclose(got, nm.gammatone(x, 4000.0, 400.0)["envelope"], atol=1e-5)
    frames = plans.queries()["cochleogram"](spark, uneven).groupBy("recording").count().collect()
    assert {r["recording"]: r["count"] for r in frames} == {u: 32 * -(-n // 16) for u, n in COUNTS.items()}
