"""Simulators. What drives a run is a table: noise and inputs are columns, one row a step, so a run is reproduced from its input and many runs go side by side.

A run is a recursion in time, so each run (a key's rows, in order) is one task; `noise` makes inputs of seeds.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession


def noise(spark: SparkSession, seeds: list[int], n: int, names: list[str], scale: float = 1.0) -> DataFrame:
    """(seed, t, names): n rows of normal numbers for each seed, in rows of the generator's stream."""

    def run(batches):
        for pdf in batches:
            for seed in pdf["seed"]:
                e = np.random.default_rng(int(seed)).standard_normal((n, len(names))) * scale
                yield pd.DataFrame({"seed": int(seed), "t": np.arange(n), **{name: e[:, i] for i, name in enumerate(names)}})

    table = spark.createDataFrame([(int(s),) for s in seeds], "seed long").repartition(len(seeds), "seed")
    return table.mapInPandas(run, f"seed long, t long, {', '.join(f'{c} double' for c in names)}")


def _driven(df: DataFrame, key: list[str], order: str, inputs: list[str], schema: str, path: Callable, skip: int = 0) -> DataFrame:
    """path(inputs as an n x m array) -> columns of the result, for each key's rows in order; the first skip rows are left out."""
    kinds = dict(df.dtypes)
    keep = [*key, order]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        out = pdf[keep].iloc[skip:].reset_index(drop=True)
        for name, value in path(pdf[inputs].to_numpy(float)).items():
            out[name] = list(value[skip:])
        return out

    return df.select(*keep, *dict.fromkeys(inputs)).groupBy(*key).applyInPandas(run, f"{', '.join(f'{c} {kinds[c]}' for c in keep)}, {schema}")


def autoregressive(df: DataFrame, e: str, coefs: list[float], key: list[str], order: str = "t") -> DataFrame:
    """x[t] = sum coefs[k] x[t - 1 - k] + e[t]; the first len(coefs) samples are noise and left out."""
    p, back = len(coefs), np.asarray(coefs, float)[::-1]

    def path(v: np.ndarray) -> dict:
        x = v[:, 0].copy()
        for t in range(p, len(x)):
            x[t] += back @ x[t - p : t]
        return {"x": x}

    return _driven(df, key, order, [e], "x double", path, p)


def vector_autoregressive(df: DataFrame, e: list[str], matrices, key: list[str], order: str = "t") -> DataFrame:
    """x[t] = e[t] + sum x[t - 1 - k] @ matrices[k]: entry (i, j) is the part of i in j. The first len(matrices) samples are noise and left out."""
    a = np.asarray(matrices, float)

    def path(v: np.ndarray) -> dict:
        x = v.copy()
        for t in range(len(a), len(x)):
            x[t] += sum(x[t - 1 - k] @ m for k, m in enumerate(a))
        return {"x": x}

    return _driven(df, key, order, e, "x array<double>", path, len(a))


def from_covariances(covariances) -> np.ndarray:
    """Coefficients of a vector autoregression: the Cholesky factor of each lag's covariance (order x n x n, or one n x n)."""
    c = np.asarray(covariances, float)
    return np.stack([np.linalg.cholesky(m) for m in (c[None] if c.ndim == 2 else c)])


def simulate_ar(spark: SparkSession, coefs: list[float], n: int, sigma: float = 1.0, seeds: list[int] | None = None) -> DataFrame:
    df = autoregressive(noise(spark, seeds or [42], n + len(coefs), ["e"], sigma), "e", coefs, ["seed"])
    return df.withColumn("t", df["t"] - len(coefs))


def simulate_var(spark: SparkSession, matrices, n: int, seeds: list[int] | None = None) -> DataFrame:
    a = np.asarray(matrices, float)
    names = [f"e{i}" for i in range(a.shape[1])]
    df = vector_autoregressive(noise(spark, seeds or [42], n + len(a), names), names, a, ["seed"])
    return df.withColumn("t", df["t"] - len(a))


def logistic(x, top: float = 1.0, slope: float = 1.0, middle: float = 0.0):
    return top / (1 + np.exp(slope * (middle - x)))


def recurrent(df: DataFrame, e: list[str], inputs: list[str], w, w_in, w_out, theta, x0, dt: float, spread: float, key: list[str], order: str = "t", nonlinearity: Callable = logistic) -> DataFrame:
    """Continuous-time recurrent network by Euler steps: x += dt (-x + W o + W_in I) + sqrt(dt) spread e, o = s(x + theta), out = 2 s(W_out o) - 1.
    e: a noise column for each node. The first row is x0 with o and out 0."""
    w, w_in, w_out, theta, x0 = (np.asarray(v, float) for v in (w, w_in, w_out, theta, x0))
    k = len(w)

    def path(v: np.ndarray) -> dict:
        x, o, out = np.tile(x0, (len(v), 1)), np.zeros((len(v), k)), np.zeros(len(v))
        for t in range(1, len(v)):
            x[t] = x[t - 1] + dt * (-x[t - 1] + w @ o[t - 1] + w_in @ v[t, k:]) + np.sqrt(dt) * spread * v[t, :k]
            o[t] = nonlinearity(x[t] + theta)
            out[t] = 2 * nonlinearity(w_out @ o[t]) - 1
        return {"state": x, "rate": o, "out": out}

    return _driven(df, key, order, [*e, *inputs], "state array<double>, rate array<double>, out double", path)


#: Fixed values of a cortical column: synapses, shares of them, and a population's gains (mV) and time constants (s), excitatory and inhibitory; the second
#: one is the fast population of the dual-kinetics column. RATE: top, slope and middle of the firing rate. REST: mean rate that a network takes off.
SYNAPSES, SHARES = 135.0, (1.0, 0.8, 0.25, 0.25)
SLOW = (3.25, 1 / 100, 22.0, 1 / 50)
FAST = (6.5, 0.0046, 150.0, 0.0029)
RATE, REST = (5.0, 0.56, 6.0), 3.84


def column_rates(potentials) -> np.ndarray:
    return logistic(np.asarray(potentials), *RATE)


def column_step(x: np.ndarray, drive: float, populations: tuple, mix: np.ndarray, dt: float) -> np.ndarray:
    """One Euler step of a column: x holds six states (three potentials, three slopes) for each population. Populations share their firing rates, which come
    from their mixed potentials; drive enters the excitatory cells."""
    c1, c2, c3, c4 = (SYNAPSES * s for s in SHARES)
    v, z = x[:, :3], x[:, 3:]
    pyramid = mix @ v[:, 0]
    rates = column_rates([mix @ (v[:, 1] - v[:, 2]), c1 * pyramid, c3 * pyramid])
    come = np.array([rates[0], c2 * rates[1] + drive, c4 * rates[2]])
    out = np.empty_like(x)
    for p, (gain_e, tau_e, gain_i, tau_i) in enumerate(populations):
        gain, tau = np.array([gain_e, gain_e, gain_i]), np.array([tau_e, tau_e, tau_i])
        out[p, :3] = v[p] + dt * z[p]
        out[p, 3:] = z[p] + dt * (gain * come - 2 * z[p] - v[p] / tau) / tau
    return out


def column_readout(x: np.ndarray, mix: np.ndarray) -> float:
    return float(mix @ (x[:, 1] - x[:, 2]))


def _column(df: DataFrame, drive: str, populations: tuple, mix: list[float], x0, dt: float, key: list[str], order: str) -> DataFrame:
    share, start = np.asarray(mix, float), np.zeros(6 * len(populations)) if x0 is None else np.asarray(x0, float)

    def path(v: np.ndarray) -> dict:
        x = start.reshape(len(populations), 6)
        states, out = [start], [column_readout(x, share)]
        for t in range(1, len(v)):
            x = column_step(x, v[t, 0], populations, share, dt)
            states.append(x.ravel())
            out.append(column_readout(x, share))
        return {"state": states, "out": out}

    return _driven(df, key, order, [drive], "state array<double>, out double", path)


def cortical_column(df: DataFrame, drive: str, key: list[str], order: str = "t", x0=None, dt: float = 1e-4) -> DataFrame:
    """A Jansen-Rit column: six states and out (excitatory less inhibitory potential) for each row's drive. The first row is x0, by default at rest."""
    return _column(df, drive, (SLOW,), [1.0], x0, dt, key, order)


def dual_column(df: DataFrame, drive: str, key: list[str], order: str = "t", x0=None, dt: float = 1e-4, mix: float = 0.5) -> DataFrame:
    """A column with a slow and a fast population, mixed by mix and 1 - mix: twelve states and the mixed out."""
    return _column(df, drive, (SLOW, FAST), [mix, 1 - mix], x0, dt, key, order)


def column_network(df: DataFrame, e: list[str], weights, key: list[str], order: str = "t", delay: float = 0.01, dt: float = 1e-3, mix: float = 0.8, mean: float = 220.0, spread: float = 22.0) -> DataFrame:
    """Dual columns that drive each other; out holds every node's potential. weights (i, j): the part of i in j's input, 0 to 1.

    A node's input is mean, its noise times spread and what its connections leave (1 - sum of weights), and the other nodes' rates less REST, held for delay
    seconds, times spread sqrt(2 w - w^2) / deviation of the sender's rate over the run so far (1 before there are two samples).
    """
    w, share = np.asarray(weights, float), np.array([mix, 1 - mix])
    k, hold = len(w), max(1, int(np.ceil(delay / dt - 1e-9)))
    gain, own = np.sqrt(2 * w - w**2), np.eye(k, dtype=bool)

    def path(v: np.ndarray) -> dict:
        x, late, first = np.zeros((k, 2, 6)), np.zeros(k), np.zeros(k)
        centre, squares, outs = np.zeros(k), np.zeros(k), np.zeros((len(v), k))
        for t in range(len(v)):
            deviation = np.sqrt(squares / t) if t > 1 else np.ones(k)
            through = np.where(own, w, spread * gain / deviation[:, None])
            drive = mean + spread * v[t] * (1 - w.sum(axis=0)) + (column_rates(late) - REST) @ through
            for i in range(k):
                x[i] = column_step(x[i], drive[i], (SLOW, FAST), share, dt)
                outs[t, i] = column_readout(x[i], share)
            rate = column_rates(outs[t])
            new = centre + (rate - centre) / (t + 1)
            squares += (rate - centre) * (rate - new)
            centre = new
            first = outs[t].copy() if t % hold == 0 else first
            late = first if (t + 1) % hold == 0 else late
        return {"out": outs}

    return _driven(df, key, order, e, "out array<double>", path)
