"""Scalar functions as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def present(c: Column) -> Column:
    """NaN counts as missing."""
    return F.when(~F.isnan(c), c)


def hz_to_erb(f: Column) -> Column:
    return 21.4 * F.log10(f * 0.00437 + 1)


def erb_to_hz(e: Column) -> Column:
    return (F.pow(F.lit(10.0), e / 21.4) - 1) / 4.37e-3


def erb_width(f: Column) -> Column:
    """Equivalent rectangular bandwidth of a gammatone channel at f."""
    return 24.7 * (f * 0.00437 + 1) * 1.019


def centre_freqs(low: float, high: float, n: int) -> list[float]:
    """n frequencies from low to high, equally spaced on the ERB scale."""
    erb = lambda f: 21.4 * math.log10(0.00437 * f + 1)
    a, b = erb(low), erb(high)
    return [(10 ** ((a + (b - a) * i / max(n - 1, 1)) / 21.4) - 1) / 4.37e-3 for i in range(n)]


def sigmoid(x: Column, top: float = 1.0, slope: float = 1.0, middle: float = 0.0) -> Column:
    return top / (1 + F.exp(slope * (middle - x)))


def sigmoid_derivative(x: Column, top: float = 1.0, slope: float = 1.0, middle: float = 0.0) -> Column:
    """slope * s * (1 - s), whatever the top is."""
    s = sigmoid(x, top, slope, middle)
    return slope * s * (1 - s)


def fir_order(transition: float, srate: float, attenuation: float = 60.0, ripples: float | None = None) -> int:
    """Taps of a low-pass from its stop-band attenuation (dB), by the rule with pass-band ripples if they are given; always odd."""
    if ripples:
        n = math.floor(2.0 / 3.0 * (-math.log10(10 * ripples) + attenuation / 10) * srate / transition + 1e-9)
    else:
        n = math.floor(attenuation * srate / (22.0 * transition))
    return n if n % 2 else n - 1


def compress(x: Column, how: str | float = "cuberoot") -> Column:
    """Compression of a rate map: 'cuberoot' is the power 0.3, 'log' has a floor of -200, 'none' keeps x; a number is a power."""
    if how == "none":
        return x
    if how == "log":
        return F.when(x > 0, F.greatest(20 * F.log10(x), F.lit(-200.0))).otherwise(F.lit(-200.0))
    return F.pow(x, F.lit(0.3 if how == "cuberoot" else float(how)))


def decibels(x: Column) -> Column:
    return 10 * F.log10(x + 1e-16)


def stars(p: Column) -> Column:
    """One star for each factor of 10 below .05, else 'n. s.'."""
    count = F.when(p < 0.05, F.floor(F.log10(F.lit(0.05) / p)).cast("int") + 1).otherwise(0)
    return F.when(count > 0, F.repeat(F.lit("*"), F.least(count, F.lit(20)))).otherwise("n. s.")
