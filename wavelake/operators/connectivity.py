"""Connectivity between channels: phase transfer entropy, weighted phase lag index, phase linearity, jackknife."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numeric as nm
from .spectral import hilbert


def binned(phase: Column, width: Column | float, bins: Column | int) -> Column:
    """Bin of a phase in [0, 2 pi]; the last bin is closed."""
    return F.least(F.floor(phase / width), F.lit(bins) - 1 if isinstance(bins, int) else bins - 1).cast("int")


def histogram(df: DataFrame, bins: list[str], by: list[str]) -> DataFrame:
    return df.groupBy(*by, *bins).agg(F.count("*").alias("n"))


def entropy(df: DataFrame, bins: list[str], by: list[str]) -> DataFrame:
    """Shannon entropy in bits of the joint bins; empty bins count 0."""
    n = histogram(df, bins, by)
    total = n.groupBy(*by).agg(F.sum("n").alias("__all"))
    p = F.col("n") / F.col("__all")
    joined = n.join(total, by) if by else n.crossJoin(F.broadcast(total))
    return joined.groupBy(*by).agg((-F.sum(p * F.log2(p))).alias("entropy"))


def scott_width(spread: Column, n: Column) -> Column:
    return F.lit(3.49) * spread * F.pow(n, F.lit(-1.0 / 3))


def pte_delay(df: DataFrame, channels: list[str], key: list[str], t: str = "t") -> DataFrame:
    """round((n - 2) * channels / sign changes): a change is phase[t - 1] * phase[t + 1] < 0 at an inner sample, phases centred on 0."""
    over = Window.partitionBy(*key).orderBy(t)
    flips = None
    for c in channels:
        flip = F.coalesce((F.lag(c).over(over) * F.lead(c).over(over) < 0).cast("long"), F.lit(0).cast("long"))
        flips = flip if flips is None else flips + flip
    data = df.select(*key, flips.alias("__flips"))
    return data.groupBy(*key).agg(F.rint((F.count("*") - 2) * len(channels) / F.nullif(F.sum("__flips"), F.lit(0))).cast("long").alias("delay"))


def _entropies(rows: DataFrame, key: list[str]) -> DataFrame:
    """(key, src, dst, pte, dpte) of rows (key, bins, src, dst, x, y, z = y later). All four histograms come from the joint one, side by side; the sample
    count's logarithms cancel."""
    by = [*key, "src", "dst"]
    joint = rows.groupBy(*by, "bins", "x", "y", "z").agg(F.count("*").alias("n"))
    none = F.lit(-1)
    kinds = F.array(*[F.struct(F.lit(s).alias("sign"), a.alias("a"), b.alias("b"), c.alias("c")) for s, a, b, c in ((1, F.col("y"), none, none), (-1, F.col("y"), F.col("x"), none), (-2, F.col("y"), none, F.col("z")), (2, F.col("y"), F.col("x"), F.col("z")))])
    cells = joint.select(*by, "bins", "n", F.explode(kinds).alias("k")).groupBy(*by, "bins", "k").agg(F.sum("n").alias("n"))
    sign = F.signum("k.sign")
    sums = cells.groupBy(*by, "bins").agg(F.sum(sign * F.col("n") * F.log2("n")).alias("s"), F.sum(F.when(F.col("k.sign") == 1, F.col("n"))).alias("all"))
    pte = sums.select(*by, (-F.col("s") / F.col("all") / F.log2("bins")).alias("pte"))
    both = F.sum("pte").over(Window.partitionBy(*key, F.least("src", "dst"), F.greatest("src", "dst")))
    return pte.select(*by, "pte", (F.col("pte") / F.nullif(both, F.lit(0.0))).alias("dpte"))


def _directed(data: DataFrame, channels: list[str], key: list[str]) -> DataFrame:
    """Both directions of each pair from columns b0.. (now) and f0.. (later)."""
    pairs = F.array(*[F.struct(F.lit(a).alias("src"), F.lit(b).alias("dst"), F.col(f"b{i}").alias("x"), F.col(f"b{j}").alias("y"), F.col(f"f{j}").alias("z")) for i, a in enumerate(channels) for j, b in enumerate(channels) if i != j])
    return data.select(*key, "bins", F.explode(pairs).alias("p")).select(*key, "bins", "p.*")


def phase_transfer_entropy(df: DataFrame, channels: list[str], delay: int, key: list[str], width: float, t: str = "t") -> DataFrame:
    """(key, src, dst, pte, dpte) from phases in [0, 2 pi]: (H(y) - H(y, x) - H(y', y) + H(y', y, x)) / log2(bins), y' = y[t + delay];
    dpte = pte / (pte + pte of the other direction)."""
    bins = math.ceil(2 * math.pi / width)
    over = Window.partitionBy(*key).orderBy(t)
    cols = [binned(F.col(c), width, bins).alias(f"b{i}") for i, c in enumerate(channels)]
    data = df.select(*key, t, F.lit(bins).alias("bins"), *cols)
    data = data.select("*", *[F.lead(f"b{i}", delay).over(over).alias(f"f{i}") for i in range(len(channels))]).filter(F.col("f0").isNotNull())
    return _entropies(_directed(data, channels, key), key)


def transfer_entropy(df: DataFrame, channels: list[str], key: list[str], t: str = "t", delay: int | None = None) -> DataFrame:
    """(key, src, dst, pte, dpte) from signals: phases of the analytic signals, a delay for each recording from its sign changes (or the given one), bins of
    Scott's width from the mean deviation of the phases. t counts a recording's samples."""
    phases = None
    for c in channels:
        one = hilbert(df.select(*key, t, c), c, key, t).select(*key, t, F.atan2("im", "re").alias(c))
        phases = one if phases is None else phases.join(one, [*key, t])
    spread = F.stddev_pop(F.col(channels[0]))
    for c in channels[1:]:
        spread = spread + F.stddev_pop(F.col(c))
    sizes = phases.groupBy(*key).agg(scott_width(spread / len(channels), F.count("*")).alias("width"))
    sizes = sizes.withColumn("bins", F.ceil(F.lit(2 * math.pi) / F.col("width")).cast("int"))
    given = pte_delay(phases, channels, key, t) if delay is None else sizes.select(*key, F.lit(delay).cast("long").alias("delay"))
    data = phases.join(sizes.join(given, key), key)
    data = data.select(*key, t, "delay", "bins", *[binned(F.col(c) + math.pi, F.col("width"), F.col("bins")).alias(f"b{i}") for i, c in enumerate(channels)])
    later = data.select(*key, (F.col(t) - F.col("delay")).alias(t), *[F.col(f"b{i}").alias(f"f{i}") for i in range(len(channels))])
    return _entropies(_directed(data.join(later, [*key, t]), channels, key), key)


def wpli(spectra: DataFrame, low: float, high: float) -> DataFrame:
    """(src, dst, wpli): signed weighted phase lag index over trials, averaged over frequencies strictly inside the band; null on the diagonal."""
    by = spectra.groupBy("src", "dst", "freq").agg(F.sum("im").alias("s"), F.sum(F.abs("im")).alias("a"))
    inside = by.filter((F.col("freq") > low) & (F.col("freq") < high) & (F.col("src") != F.col("dst")))
    return inside.groupBy("src", "dst").agg(F.avg(F.col("s") / F.nullif(F.col("a"), F.lit(0.0))).alias("wpli"))


def phase_linearity(df: DataFrame, columns: list[str], band: float, srate: float, key: list[str], t: str = "t") -> DataFrame:
    """(key, src, dst, plm): share of the power of the unit phase difference's spectrum within the band, the first sample set to 0 power."""
    kinds = dict(df.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(t)
        z = nm.analytic(pdf[columns].to_numpy(float))
        freq, rows = np.fft.fftfreq(len(z), 1 / srate), []
        for i in range(len(columns)):
            for j in range(i + 1, len(columns)):
                c = z[:, i] * np.conj(z[:, j])
                f = np.fft.fft(c / np.maximum(np.abs(c), 1e-300))
                f[0] = 0
                p = np.abs(f) ** 2
                rows.append((*[pdf[k].iloc[0] for k in key], columns[i], columns[j], p[np.abs(freq) < band].sum() / p.sum()))
        return pd.DataFrame(rows, columns=[*key, "src", "dst", "plm"])

    schema = ", ".join([*[f"{k} {kinds[k]}" for k in key], "src string, dst string, plm double"])
    return df.select(*key, t, *columns).groupBy(*key).applyInPandas(run, schema)


def jackknife_means(df: DataFrame, column: str, by: list[str]) -> DataFrame:
    """Each row's leave-one-out mean of its group: (S - x) / (n - 1), instead of n copies of n - 1 rows."""
    over = Window.partitionBy(*by)
    return df.withColumn("jackknife", (F.sum(column).over(over) - F.col(column)) / F.nullif(F.count(column).over(over) - 1, F.lit(0)))
