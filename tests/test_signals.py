"""Golden values, algebra and recovery of known parameters."""

import math
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavelake.functions import numeric as nm
from wavelake.functions.scalars import fir_order
from wavelake.operators import autoregressive as ar
from wavelake.operators import covariance as cv
from wavelake.operators import lags, response, simulate, windows, words
from wavelake.operators.gram import gram_matrix, ridge
from wavelake.sources import audio, mat5, models, text_tables


def frame(spark, *columns, names):
    rows = [(0, t, *[float(v) for v in r]) for t, r in enumerate(zip(*columns, strict=True))]
    return spark.createDataFrame(rows, "recording long, t long, " + ", ".join(f"{n} double" for n in names))


def test_lag_example(spark):
    df = frame(spark, range(1, 7), range(7, 13), names=["a", "b"])
    rows = lags.lag_features(df, ["a", "b"], [0, 1], ["recording"], ["t"]).orderBy("t").collect()
    assert (rows[0]["a_0"], rows[0]["b_0"], rows[0]["a_1"]) == (1, 7, None)
    assert [r["b_1"] for r in rows[1:]] == [7, 8, 9, 10, 11]
    with pytest.raises(ValueError):
        lags.lag_features(df, ["a"], [0], ["recording"], ["t"], fill=0.0, drop=True)


def test_nan_counts_as_missing(spark):
    df = frame(spark, [1, math.nan, 3], names=["a"])
    assert lags.lag_features(df, ["a"], [0, 1], ["recording"], ["t"], drop=True).count() == 0


def test_lag_span_rounds_up_in_doubles():
    assert lags.lag_span(0.07, 0.1, 100) == [8, 9]
    assert lags.lag_sparse([0.07], 100) == [8]


def test_gammatone_golden():
    t = np.arange(4000)
    out = nm.gammatone(np.sin(2 * np.pi * 350 * t / 4000), 4000, 400)["displacement"]
    assert np.allclose(out[:3], [0, 2.42658114e-05, 1.82263060e-04], atol=1e-10)
    assert np.allclose(out[-3:], [0.336750713, 0.466512862, 0.458784493], atol=1e-8)


def test_fir_order_is_odd():
    assert fir_order(10, 44100, ripples=1e-3) == 23519
    assert fir_order(10, 100) % 2 == 1


def test_chebyshev_gains():
    b, a = nm.chebyshev2(4, 40, (4, 8), 100)
    gain = lambda f: abs(np.polyval(b[::-1], np.exp(-2j * np.pi * f / 100)) / np.polyval(a[::-1], np.exp(-2j * np.pi * f / 100)))
    assert gain(math.sqrt(32)) > 0.9 and gain(1) < 0.02 and gain(30) < 0.02


def test_resampling_keeps_a_sine():
    t = np.arange(200) / 100
    assert np.allclose(nm.resampled(np.sin(2 * np.pi * 5 * t), 100), np.sin(2 * np.pi * 5 * t[::2]), atol=1e-8)


def test_positive_definite():
    assert nm.positive_definite(np.eye(2)) and not nm.positive_definite(-np.eye(2)) and not nm.positive_definite(np.array([[1, 0.1], [0, 1]]))


def test_student_t():
    assert abs(nm.t_two_sided(2.228138852, 10) - 0.05) < 1e-8
    assert abs(nm.t_two_sided(1.0, 1) - 0.5) < 1e-12


def test_wide_gram_matches_numpy(spark):
    x = np.random.default_rng(0).normal(size=(300, 14))
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], ", ".join(f"a{i} double" for i in range(14))).repartition(3)
    assert np.allclose(gram_matrix(df, df.columns), x.T @ x)


def test_ridge_and_least_squares():
    rng = np.random.default_rng(1)
    x, b = rng.normal(size=(50, 4)), np.array([1.0, -2, 0.5, 3])
    g = np.column_stack([x, x @ b]).T @ np.column_stack([x, x @ b])
    assert np.allclose(ridge(g, [0, 1, 2, 3], [4], [0.0])[0, :, 0], b)
    assert np.allclose(ridge(g, [0, 1, 2, 3], [4], [7.0])[0, :, 0], np.linalg.solve(x.T @ x + 7 * np.eye(4), x.T @ x @ b))
    with pytest.raises(ValueError):
        ridge(g, [0], [4], [-1.0])


def test_kernel_recovery_save_and_load(spark, tmp_path):
    rng = np.random.default_rng(3)
    x = rng.normal(size=2000)
    kernel = np.array([0.0, 0.5, 1.0, -0.7])
    y = np.convolve(x, kernel)[:2000] + 0.01 * rng.normal(size=2000) + 2
    df = frame(spark, x, y, names=["x", "y"])
    model = response.ResponseModel(range(-1, 4), 0.0)
    table = model.fit(df, ["x"], ["y"], ["recording"], ["t"])
    coef = {r["lag"]: r["coef"] for r in table.collect()}
    assert all(abs(coef[k] - kernel[k]) < 0.01 for k in range(4)) and abs(coef[-1]) < 0.01 and abs(coef[None] - 2) < 0.01
    models.save(model, table, str(tmp_path / "m"), 100.0)
    again, back, srate = models.load(spark, str(tmp_path / "m"))
    assert again.lags == model.lags and srate == 100.0 and {r["lag"]: r["coef"] for r in back.collect()} == coef
    hat = again.predict(df, back, ["x"], ["recording"], ["t"])
    assert response.score(hat.filter("t between 5 and 1990"), "y", "y_hat", ["recording"]).first()["score"] > 0.999


def test_ar_and_var_recovery(spark):
    df = simulate.simulate_ar(spark, [1.2, -0.8], 4000, seeds=[1]).withColumnRenamed("seed", "recording")
    coef = {r["lag"]: r["coef"] for r in ar.fit_ar(df, "x", 2, ["recording"], ["t"]).collect()}
    assert abs(coef[1] - 1.2) < 0.05 and abs(coef[2] + 0.8) < 0.05
    v = simulate.simulate_var(spark, [[[0.8, -0.2], [0.5, -0.4]]], 4000, [1]).select(F.col("seed").alias("recording"), "t", F.col("x")[0].alias("a"), F.col("x")[1].alias("b"))
    got = {(r["source"], r["target"]): r["coef"] for r in ar.fit_var(v, ["a", "b"], 1, ["recording"], ["t"]).collect()}
    assert abs(got["a", "a"] - 0.8) < 0.05 and abs(got["b", "a"] - 0.5) < 0.06
    assert {r["value"] for r in ar.granger(v, ["a", "b"], 1, ["recording"], ["t"]).filter("source = target").collect()} == {0.0}


def test_canonical_correlations(spark):
    rng = np.random.default_rng(5)
    n = 4000
    x = rng.normal(size=(n, 3))
    y = np.column_stack([x[:, 0], x[:, 1] + rng.normal(size=n), rng.normal(size=n)])
    df = spark.createDataFrame([tuple(map(float, r)) for r in np.column_stack([x, y])], ", ".join(f"c{i} double" for i in range(6)))
    for method in ("svd", "nt"):
        _, _, r = cv.canonical(df, ["c0", "c1", "c2"], ["c3", "c4", "c5"], method)
        assert np.allclose(r, [1, 0.707, 0], atol=0.05)


def test_padded_chunks_are_full(spark):
    df = frame(spark, range(9), names=["a"])
    n = windows.chunks(df, 4, 1, ["recording"], pad=True).groupBy("window").count().collect()
    assert {r["window"]: r["count"] for r in n} == {0: 4, 1: 4, 2: 4}


def test_word_grid_collision_and_range(spark):
    w = spark.createDataFrame([(0, 0, 0.0, 1.0), (0, 1, 0.1, 2.0), (0, 2, 9.0, 3.0)], "recording long, word_pos long, onset double, v double")
    d = spark.createDataFrame([(0, 2.0)], "recording long, duration double")
    rows = words.word_grid(w, ["v"], 2.0, d, ["recording"]).orderBy("sample").collect()
    assert [r["v"] for r in rows] == [1, 2, 0, 0] and [r["word_onset"] for r in rows] == [1, 1, 0, 0]


def test_random_vectors_have_unit_length(spark):
    w = spark.createDataFrame([("Known",), ("other",)], "word string")
    v = spark.createDataFrame([("known", [1.0, 2.0, 2.0])], "word string, vec array<float>")
    got = {r["word"]: r["vec"] for r in words.word_vectors(w, v, unknown="rdm").collect()}
    assert got["Known"] == [1, 2, 2] and abs(sum(x * x for x in got["other"]) - 1) < 1e-9


def test_text_sources(spark, tmp_path):
    (tmp_path / "d.txt").write_text("a\nb\nc\nd\n 12.5 \n")
    (tmp_path / "on.csv").write_text("Word,Onset\nHi,0.5\nyou,1.25\n")
    (tmp_path / "syn.txt").write_text("Word Depth Open Close ton toff\nHi 1 2 3 0.5 0.7\n")
    (tmp_path / "plain.txt").write_text("Hi 3 0.5 0.7\n")
    (tmp_path / "vec.txt").write_text("2 2\na 1 2\nb 3 4\n")
    read = lambda n: text_tables.whole_lines(spark, str(tmp_path / n))
    assert text_tables.praat_duration(read("d.txt")).first()["duration"] == 12.5
    assert [(r["word"], r["onset"]) for r in text_tables.word_onsets(read("on.csv")).orderBy("word_pos").collect()] == [("Hi", 0.5), ("you", 1.25)]
    assert text_tables.word_onsets(read("syn.txt")).first()["onset"] == 0.5
    assert text_tables.syntactic(read("syn.txt"), "open").first()["open"] == 2
    assert text_tables.syntactic(read("plain.txt"), "depth").first()["onset"] == 0.5
    assert text_tables.vectors(read("vec.txt"), 1).collect() == [("a", [1.0, 2.0])]


def test_audio(spark, tmp_path):
    with wave.open(str(tmp_path / "a.wav"), "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(100)
        w.writeframes(np.array([0, 16384, -32768], "<i2").tobytes())
    assert audio.wav_durations(spark, str(tmp_path)).first()["duration"] == 0.02
    assert [r["x"] for r in audio.wav_samples(spark, str(tmp_path)).orderBy("t").collect()] == [[0.0], [0.5], [-1.0]]


def test_mat5_roundtrip(spark, tmp_path):
    import struct
    import zlib

    x = np.arange(6.0).reshape(3, 2)
    element = lambda k, raw: struct.pack("<II", k, len(raw)) + raw + b"\0" * (-len(raw) % 8)
    body = element(6, struct.pack("<II", 6, 0)) + element(5, struct.pack("<ii", 3, 2)) + element(1, b"eeg") + element(9, x.tobytes(order="F"))
    packed = zlib.compress(element(14, body))
    head = b"MATLAB 5.0 MAT-file".ljust(124) + struct.pack("<H", 0x0100) + b"IM"
    (tmp_path / "a.mat").write_bytes(head + struct.pack("<II", 15, len(packed)) + packed)
    assert np.array_equal(mat5.read((tmp_path / "a.mat").read_bytes())["eeg"], x)
    assert [r["x"] for r in mat5.signal(spark, str(tmp_path), "eeg").orderBy("t").collect()] == x.tolist()
