"""Filters, envelopes, spectra, auditory channels: grouped kernels where time is sequential or spectral, windows and joins where it isn't."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numeric as nm
from ..functions.scalars import centre_freqs, compress


def grouped(df: DataFrame, key: list[str], t: str, column: str, extra: str, function) -> DataFrame:
    """Run function(values) -> dict of arrays once for each recording; rows in the order of t, which comes along."""
    kinds = dict(df.dtypes)
    names = [x.strip().split(" ")[0] for x in extra.split(",")]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(t)
        out = function(pdf[column].to_numpy(float))
        n = len(next(iter(out.values())))
        base = {k: [pdf[k].iloc[0]] * n for k in key}
        base[t] = pdf[t].to_numpy() if n == len(pdf) else np.arange(n)
        return pd.DataFrame(base | {c: out[c] for c in names})

    schema = ", ".join([*[f"{k} {kinds[k]}" for k in key], f"{t} {kinds[t]}", extra])
    return df.select(*key, t, column).groupBy(*key).applyInPandas(run, schema)


def hilbert(df: DataFrame, column: str, key: list[str], t: str = "t", fast: bool = False) -> DataFrame:
    """Analytic signal: re, im, amplitude, phase. fast pads with zeros to a fast length, which changes values near the end."""

    def run(x):
        z = nm.analytic(x, nm.fast_length(len(x)) if fast else None)
        return {"re": z.real, "im": z.imag, "amplitude": np.abs(z), "phase": np.angle(z)}

    return grouped(df, key, t, column, "re double, im double, amplitude double, phase double", run)


def fir(df: DataFrame, column: str, taps: list[float], key: list[str], t: str = "t", name: str = "filtered") -> DataFrame:
    """FIR filter of odd length with edge values repeated beyond the ends: one frame, one expression; for long filters see fir_grouped()."""
    half = len(taps) // 2
    rows, frame = Window.partitionBy(*key), Window.partitionBy(*key).orderBy(t)
    data = df.select("*", F.min_by(column, t).over(rows).alias("__first"), F.max_by(column, t).over(rows).alias("__last"))
    terms = [F.lit(float(h)) * F.coalesce(F.lag(column, k - half).over(frame), F.col("__first") if k > half else F.col("__last")) for k, h in enumerate(taps)]
    total = terms[0]
    for x in terms[1:]:
        total = total + x
    return data.withColumn(name, total).drop("__first", "__last")


def fir_grouped(df: DataFrame, column: str, taps: np.ndarray, key: list[str], t: str = "t") -> DataFrame:
    return grouped(df, key, t, column, "filtered double", lambda x: {"filtered": nm.edge_filtered(x, taps)})


def filterbank(df: DataFrame, column: str, bank: list[tuple[list[float], list[float]]], key: list[str], t: str = "t", apply: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray] = nm.recursive) -> DataFrame:
    """Every band's filter over every recording: (key, t, band, value). apply: function of a band's b and a and the samples, by default the recursive filter."""
    kinds = dict(df.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(t)
        b, a = bank[int(pdf["band"].iloc[0])]
        return pdf[[*key, t, "band"]].assign(value=apply(np.array(b, float), np.array(a, float), pdf[column].to_numpy(float)))

    schema = ", ".join([*[f"{k} {kinds[k]}" for k in key], f"{t} {kinds[t]}", "band int", "value double"])
    # a filter bank is a design of the caller: some bands, and a task for each recording and band
    rows = df.select(*key, t, column, F.explode(F.array(*[F.lit(i) for i in range(len(bank))])).alias("band"))
    return rows.groupBy(*key, "band").applyInPandas(run, schema)


def chebyshev_bank(edges: list[tuple[float, float]], srate: float, order: int = 4, ripple: float = 40.0) -> list[tuple[list[float], list[float]]]:
    return [tuple(x.tolist() for x in nm.chebyshev2(order, ripple, e, srate)) for e in edges]


def envelope(df: DataFrame, column: str, srate: float, cutoff: float, key: list[str], t: str = "t", method: str = "rectify", power: float = 1 / 3, taps: int | None = None, resample: float | None = None) -> DataFrame:
    """Amplitude envelope, compressed, low-passed, resampled on request, scaled to [0, 1]."""
    if resample is not None and not 2 * cutoff < resample < srate:
        raise ValueError("2 * cutoff < resample < srate")
    n_taps = taps or (lambda n: n if n % 2 else n + 1)(math.ceil(2 / 3 * math.log10(1 / (10 * 1e-6)) * srate / 10))
    h = nm.low_pass(n_taps, cutoff, srate)

    def run(x):
        a = np.abs(x) if method == "rectify" else np.abs(nm.analytic(x, nm.fast_length(len(x))))
        y = nm.edge_filtered((a + np.finfo(float).eps) ** power, h)
        if resample is not None:
            ratio = srate / resample
            y = nm.decimated(y, round(ratio)) if abs(ratio - round(ratio)) < 1e-9 else nm.resampled(y, math.ceil(resample * (len(y) - 1) / srate))
        low, top = y.min(), y.max()
        return {"envelope": (y - low) / (top - low) if top > low else y * 0}

    return grouped(df, key, t, column, "envelope double", run)


def convolve_table(df: DataFrame, column: str, kernel: list[complex], key: list[str], t: str = "t") -> DataFrame:
    """'same' convolution with a complex kernel, zeros outside: one window, two weighted sums (re, im)."""
    half = (len(kernel) - 1) // 2
    over = Window.partitionBy(*key).orderBy(t)
    shifted = [F.coalesce(F.lag(column, k - half).over(over), F.lit(0.0)) for k in range(len(kernel))]
    data = df.select("*", F.array(*shifted).alias("__x"))
    dot = lambda w: F.aggregate(F.zip_with("__x", F.array(*[F.lit(float(v)) for v in w]), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    return data.select(*df.columns, dot([k.real for k in kernel]).alias("re"), dot([k.imag for k in kernel]).alias("im"))


def wavelets(df: DataFrame, column: str, freqs: list[float], srate: float, key: list[str], t: str = "t", cycles: float = 7.0) -> DataFrame:
    """(key, t, freq, re, im) of complex Morlet wavelets."""
    out = None
    for f in freqs:
        part = convolve_table(df.select(*key, t, column), column, nm.morlet(f, srate, cycles).tolist(), key, t).withColumn("freq", F.lit(float(f)))
        out = part if out is None else out.unionByName(part)
    return out.select(*key, t, "freq", "re", "im")


def gammatone(df: DataFrame, column: str, srate: float, centre: float, key: list[str], t: str = "t", rectify: bool = False) -> DataFrame:
    return grouped(df, key, t, column, "displacement double, envelope double, phase double, frequency double", lambda x: nm.gammatone(x, srate, centre, rectify))


def rate_map(df: DataFrame, column: str, srate: float, key: list[str], t: str = "t", low: float = 80.0, high: float = 8000.0, channels: int = 32, shift: float = 8.0, leak: float = 8.0, how: str | float = "cuberoot") -> DataFrame:
    """(key, channel, cf, frame, value): envelopes of gammatone channels, leaky sums, frame means times 1 - decay, compressed."""
    freqs = [float(f) for f in centre_freqs(low, high, channels)]
    decay, size, each = math.exp(-1000 / (srate * leak)), max(1, round(shift * srate / 1000)), 8
    kinds = dict(df.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(t)
        x, parts = pdf[column].to_numpy(float), []
        for channel in range(int(pdf["__block"].iloc[0]) * each, min(channels, (int(pdf["__block"].iloc[0]) + 1) * each)):
            env = nm.gammatone(x, srate, freqs[channel])["envelope"]
            frames = -(-len(env) // size)
            s = nm.recursive(np.array([1.0]), np.array([1.0, -decay]), np.pad(env, (0, frames * size - len(env))))
            parts.append(pd.DataFrame({"channel": channel, "cf": freqs[channel], "frame": np.arange(frames), "value": s.reshape(frames, size).mean(axis=1) * (1 - decay)}))
        out = pd.concat(parts)
        for k in key:
            out[k] = pdf[k].iloc[0]
        return out[[*key, "channel", "cf", "frame", "value"]]

    schema = ", ".join([*[f"{k} {kinds[k]}" for k in key], "channel int, cf double, frame long, value double"])
    # samples go once to each block of channels, not to each channel
    rows = df.select(*key, t, column, F.explode(F.array(*[F.lit(i) for i in range(-(-channels // each))])).alias("__block"))
    return rows.groupBy(*key, "__block").applyInPandas(run, schema).withColumn("value", compress(F.col("value"), how))


def cross_spectra(df: DataFrame, columns: list[str], srate: float, key: list[str], t: str = "t", points: int | None = None) -> DataFrame:
    """(key, src, dst, freq, re, im) of one Hann segment of each recording, src <= dst. Recordings of different lengths share frequencies where points, at
    least the longest one's samples, pads them with zeros."""
    kinds = dict(df.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(t)
        freq, s = nm.cross_spectrum(pdf[columns].to_numpy(float), srate, points)
        rows = [(*[pdf[k].iloc[0] for k in key], i, j, f, s[i, j, m].real, s[i, j, m].imag) for i in range(len(columns)) for j in range(i, len(columns)) for m, f in enumerate(freq)]
        return pd.DataFrame(rows, columns=[*key, "src", "dst", "freq", "re", "im"])

    schema = ", ".join([*[f"{k} {kinds[k]}" for k in key], "src int, dst int, freq double, re double, im double"])
    return df.select(*key, t, *columns).groupBy(*key).applyInPandas(run, schema)


def dominant(spectra: DataFrame, key: list[str]) -> DataFrame:
    """(key, src, freq): the positive frequency with the most power in each spectrum; of equal ones the lowest."""
    power = F.struct(F.round("re", 6).alias("p"), (-F.col("freq")).alias("f"))
    return spectra.filter((F.col("src") == F.col("dst")) & (F.col("freq") > 0)).groupBy(*key, "src").agg((-F.max(power)["f"]).alias("freq"))


def frequency_response(b: list[float], a: list[float], points: DataFrame, w: str = "w") -> DataFrame:
    """|H| of a filter at angular frequencies w."""

    def part(c, f):
        out = F.lit(0.0)
        for k, v in enumerate(c):
            out = out + F.lit(float(v)) * f(F.col(w) * k)
        return out

    top = F.sqrt(part(b, F.cos) * part(b, F.cos) + part(b, F.sin) * part(b, F.sin))
    low = F.sqrt(part(a, F.cos) * part(a, F.cos) + part(a, F.sin) * part(a, F.sin))
    return points.withColumn("gain", top / low)
