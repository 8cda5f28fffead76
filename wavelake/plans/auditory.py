"""Recursive filters and auditory channels over whole recordings, and the same recursions as SQL."""

from __future__ import annotations

import math

import numpy as np

from ..functions.scalars import centre_freqs
from ..operators import spectral
from .queries import PI
from .registry import query
from .tables import EV, KEY, events, rounded, rsql


def _list(values) -> str:
    return f"{[float(v) for v in values]!r}::DOUBLE[]"


def filter_sql(bank: list[tuple[list[float], list[float]]]) -> str:
    """CTEs up to f (recording, band, t, y): every band's difference equation, from a row of zeros before the first sample."""
    n = max(max(len(b), len(a)) for b, a in bank) - 1
    pad = lambda v: [*np.asarray(v, float), *[0.0] * (n + 1 - len(v))]
    cf = ", ".join([*[f"unnest({_list([pad(b)[k] / a[0] for b, a in bank])}) AS b{k}" for k in range(n + 1)], *[f"unnest({_list([pad(a)[k] / a[0] for b, a in bank])}) AS a{k}" for k in range(1, n + 1)]])
    names = [f"b{k}" for k in range(n + 1)] + [f"a{k}" for k in range(1, n + 1)]
    zeros = ", ".join([*[f"0::DOUBLE AS x{k}" for k in range(1, n + 1)], *[f"0::DOUBLE AS y{k}" for k in range(1, n + 1)]])
    y = "f.b0 * e.x" + "".join(f" + f.b{k} * f.x{k} - f.a{k} * f.y{k}" for k in range(1, n + 1))
    shift = ", ".join(["e.x", *[f"f.x{k}" for k in range(1, n)], y, *[f"f.y{k}" for k in range(1, n)]])
    coefs = ", ".join(names)
    return f"""WITH RECURSIVE {EV}, cf AS (SELECT CAST(unnest(range(0, {len(bank)})) AS INTEGER) AS band, {cf}),
 f AS (SELECT recording, band, CAST(-1 AS BIGINT) AS t, {coefs}, {zeros} FROM (SELECT DISTINCT recording FROM ev), cf UNION ALL SELECT e.recording, f.band, e.t, {', '.join(f'f.{c}' for c in names)}, {shift} FROM f JOIN ev e ON e.recording = f.recording AND e.t = f.t + 1)"""


_BANK = spectral.chebyshev_bank([(4.0, 8.0), (8.0, 13.0)], 100.0, 3)


@query(f"{filter_sql(_BANK)} SELECT recording, t, band, {rsql('y1', 3)} AS value FROM f WHERE t >= 0")
def filterbank_chebyshev(spark, sf):
    return spectral.filterbank(events(spark, sf), "x", _BANK, KEY).withColumn("value", rounded("value", 3))


def ear_sql(freqs: list[float], srate: float, size: int = 1, decay: float = 0.0) -> str:
    """CTEs up to g (recording, channel, t, n, w, cf, uc, us, k, leak): gammatone channels as four poles on the signal shifted down by the centre frequency,
    leaky sums of the envelope, over samples filled up with zeros to whole frames."""
    width = [2 * math.pi / srate * 24.7 * (0.00437 * f + 1) * 1.019 for f in freqs]
    columns = {"cf": freqs, "w": [2 * math.pi * f / srate for f in freqs], "a": [math.exp(-b) for b in width], "k": [b**4 / 3 for b in width]}
    chosen = ", ".join(f"unnest({_list(v)}) AS {c}" for c, v in columns.items())
    new = lambda s, p: f"({s} + 4 * g.a * g.{p}1 - 6 * g.a * g.a * g.{p}2 + 4 * g.a * g.a * g.a * g.{p}3 - g.a * g.a * g.a * g.a * g.{p}4)"
    c, s = new("e.x * cos(g.w * e.t)", "c"), new("-e.x * sin(g.w * e.t)", "s")
    uc, us = (f"({v} + 4 * g.a * g.{p}1 + g.a * g.a * g.{p}2)" for v, p in ((c, "c"), (s, "s")))
    state = [f"{p}{i}" for p in "cs" for i in range(1, 5)]
    moved = f"{c}, g.c1, g.c2, g.c3, {s}, g.s1, g.s2, g.s3, {uc}, {us}, CASE WHEN e.t < e.n THEN g.k * sqrt({uc} * {uc} + {us} * {us}) ELSE 0 END + {decay!r}::DOUBLE * g.leak"
    return f"""WITH RECURSIVE {EV}, nn AS (SELECT recording, count(*) AS n FROM ev GROUP BY 1), pe AS (SELECT recording, t, x, n FROM ev JOIN nn USING (recording) UNION ALL SELECT recording, unnest(range(n, CAST(ceil(n / {size}.0) * {size} AS BIGINT))), 0.0, n FROM nn),
 ch AS (SELECT CAST(unnest(range(0, {len(freqs)})) AS INTEGER) AS channel, {chosen}),
 g AS (SELECT recording, channel, CAST(-1 AS BIGINT) AS t, n, cf, w, a, k, {', '.join(f'0::DOUBLE AS {v}' for v in state)}, 0::DOUBLE AS uc, 0::DOUBLE AS us, 0::DOUBLE AS leak FROM nn, ch
 UNION ALL SELECT e.recording, g.channel, e.t, e.n, g.cf, g.w, g.a, g.k, {moved} FROM g JOIN pe e ON e.recording = g.recording AND e.t = g.t + 1)"""


@query(f"""{ear_sql([400.0], 4000.0)}, p AS (SELECT *, atan2(us, uc) AS p FROM g WHERE t >= 0), d AS (SELECT *, lead(p) OVER (PARTITION BY recording ORDER BY t) - p AS d FROM p)
 SELECT recording, t, {rsql('k * (uc * cos(w * t) - us * sin(w * t))')} AS displacement, {rsql('k * sqrt(uc * uc + us * us)')} AS envelope, {rsql(f'cf + coalesce(atan2(sin(d), cos(d)), 0) * 4000.0 / (2 * {PI})', 4)} AS frequency FROM d""")
def gammatone(spark, sf):
    out = spectral.gammatone(events(spark, sf), "x", 4000.0, 400.0, KEY)
    return out.select("recording", "t", rounded("displacement").alias("displacement"), rounded("envelope").alias("envelope"), rounded("frequency", 4).alias("frequency"))


def map_sql(srate: float, low: float, high: float, channels: int, shift: float, digits: int) -> str:
    size, decay = max(1, round(shift * srate / 1000)), math.exp(-1000 / (srate * 8.0))
    value = f"pow(sum(leak) / {size} * (1 - {decay!r}::DOUBLE), 0.3::DOUBLE)"
    return f"{ear_sql(centre_freqs(low, high, channels), srate, size, decay)} SELECT recording, channel, cf, CAST(t // {size} AS BIGINT) AS frame, {rsql(value, digits)} AS value FROM g WHERE t >= 0 GROUP BY recording, channel, cf, t // {size}"


@query(f"SELECT recording, channel, {rsql('cf', 4)} AS cf, frame, value FROM ({map_sql(4000.0, 80.0, 1600.0, 4, 2.0, 5)})")
def rate_map(spark, sf):
    out = spectral.rate_map(events(spark, sf), "x", 4000.0, KEY, low=80.0, high=1600.0, channels=4, shift=2.0)
    return out.withColumns({"cf": rounded("cf", 4), "value": rounded("value", 5)})


@query(f"SELECT recording, channel, frame, value FROM ({map_sql(16000.0, 80.0, 8000.0, 32, 1.0, 3)})")
def cochleogram(spark, sf):
    out = spectral.rate_map(events(spark, sf), "x", 16000.0, KEY, low=80.0, high=8000.0, channels=32, shift=1.0)
    return out.select("recording", "channel", "frame", rounded("value", 3).alias("value"))
