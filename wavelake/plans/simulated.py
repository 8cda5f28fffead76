"""Simulators driven by columns of the events, and the same recursions as SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..operators import simulate
from .registry import query
from .tables import EV, KEY, events, rounded, rsql

_NOISE = f"{EV}, nz AS (SELECT recording, t, (x - 50) / 30 AS e0, (y - 50) / 30 AS e1, 120 + 2 * x AS p FROM ev)"


def driven(spark, sf):
    return events(spark, sf).select("recording", "t", ((F.col("x") - 50) / 30).alias("e0"), ((F.col("y") - 50) / 30).alias("e1"), (F.lit(120) + 2 * F.col("x")).alias("p"))


def recursion(first: dict[str, str], step: dict[str, str]) -> str:
    """CTEs up to s: state columns of the first row, and of a row n from the state s of the row before."""
    a = ", ".join(f"CAST({v} AS DOUBLE) AS {k}" for k, v in first.items())
    b = ", ".join(f"CAST({step[k]} AS DOUBLE)" for k in first)
    return f"WITH RECURSIVE {_NOISE}, s AS (SELECT recording, t, {a} FROM nz WHERE t = 0 UNION ALL SELECT n.recording, n.t, {b} FROM s JOIN nz n ON n.recording = s.recording AND n.t = s.t + 1)"


def items(column: str, names: list[str], digits: int = 6):
    return [rounded(F.col(column)[i], digits).alias(n) for i, n in enumerate(names)]


def chosen(names: list[str], digits: int = 6) -> str:
    return ", ".join(f"{rsql(n, digits)} AS {n}" for n in names)


AR = [1.2, -0.8]


@query(f"{recursion({'x': 'e0', 'x1': '0'}, {'x': 'e0 + CASE WHEN n.t >= 2 THEN 1.2 * s.x - 0.8 * s.x1 ELSE 0 END', 'x1': 's.x'})} SELECT recording, t, {rsql('x')} AS x FROM s WHERE t >= 2")
def simulate_ar(spark, sf):
    return simulate.autoregressive(driven(spark, sf), "e0", AR, KEY).select("recording", "t", rounded("x").alias("x"))


def _var_sql(matrices) -> str:
    """Two variables, any order: states a, b and their former values."""
    p = len(matrices)
    first = {"a": "e0", "b": "e1"} | {f"{c}{k}": "0" for k in range(1, p) for c in "ab"}
    was = lambda c, k: f"s.{c}" if k == 0 else f"s.{c}{k}"
    new = {c: f"e{j} + CASE WHEN n.t >= {p} THEN " + " + ".join(f"{was(d, k)} * {float(m[i][j])!r}" for k, m in enumerate(matrices) for i, d in enumerate("ab")) + " ELSE 0 END" for j, c in enumerate("ab")}
    new |= {f"{c}{k}": was(c, k - 1) for k in range(1, p) for c in "ab"}
    return f"{recursion(first, new)} SELECT recording, t, {chosen(['a', 'b'])} FROM s WHERE t >= {p}"


VAR = [[[0.8, -0.2], [0.5, -0.4]]]
COVARIANCES = [[[0.25, 0.05], [0.05, 0.2]], [[0.04, 0.01], [0.01, 0.09]]]


@query(_var_sql(VAR))
def simulate_var(spark, sf):
    return simulate.vector_autoregressive(driven(spark, sf), ["e0", "e1"], VAR, KEY).select("recording", "t", *items("x", ["a", "b"]))


@query(_var_sql(simulate.from_covariances(COVARIANCES)))
def simulate_var_from_cov(spark, sf):
    out = simulate.vector_autoregressive(driven(spark, sf), ["e0", "e1"], simulate.from_covariances(COVARIANCES), KEY)
    return out.select("recording", "t", *items("x", ["a", "b"]))


def _net(a: str, b: str) -> tuple[str, str]:
    return f"0.5 * {a} - 1.0 * {b}", f"1.0 * {a} + 0.5 * {b}"


def _ctrnn_sql() -> str:
    noise = f"{float(np.sqrt(0.01) * 0.3)!r}"
    s = lambda v: f"1 / (1 + exp(-({v})))"
    x = [f"(s.x{i} + 0.01 * (-s.x{i} + {w} + {c} * n.p) + {noise} * n.e{i})" for i, (w, c) in enumerate(zip(_net("s.o0", "s.o1"), ("0.02", "0.0"), strict=True))]
    o = [s(f"{x[0]} + 0.0"), s(f"{x[1]} + 0.1")]
    step = {"x0": x[0], "x1": x[1], "o0": o[0], "o1": o[1], "r": f"2 * ({s(f'1.0 * {o[0]} - 1.0 * {o[1]}')}) - 1"}
    return f"{recursion({'x0': '0.1', 'x1': '-0.2', 'o0': '0', 'o1': '0', 'r': '0'}, step)} SELECT recording, t, {chosen(['x0', 'x1', 'o0', 'o1'])}, {rsql('r')} AS r FROM s"


@query(_ctrnn_sql())
def ctrnn(spark, sf):
    out = simulate.recurrent(driven(spark, sf), ["e0", "e1"], ["p"], [[0.5, -1.0], [1.0, 0.5]], [[0.02], [0.0]], [1.0, -1.0], [0.0, 0.1], [0.1, -0.2], 0.01, 0.3, KEY)
    return out.select("recording", "t", *items("state", ["x0", "x1"]), *items("rate", ["o0", "o1"]), rounded("out").alias("r"))


def _rate_sql(v: str) -> str:
    return f"5.0 / (1 + exp(0.56 * (6.0 - ({v}))))"


def column_sql(populations: list[tuple], mix: list[str], drive: str, dt: str, name: str = "x") -> tuple[dict[str, str], str]:
    """Next states (name + population + state) of a column, and its potential, from the states of s."""
    at = lambda p, i: f"s.{name}{p}{i}"
    pyramid = " + ".join(f"{m} * {at(p, 0)}" for p, m in enumerate(mix))
    spread = " + ".join(f"{m} * ({at(p, 1)} - {at(p, 2)})" for p, m in enumerate(mix))
    come = [_rate_sql(spread), f"108.0 * ({_rate_sql(f'135.0 * ({pyramid})')}) + {drive}", f"33.75 * ({_rate_sql(f'33.75 * ({pyramid})')})"]
    out = {}
    for p, (gain_e, tau_e, gain_i, tau_i) in enumerate(populations):
        for i, (g, t) in enumerate(((gain_e, tau_e), (gain_e, tau_e), (gain_i, tau_i))):
            out[f"{name}{p}{i}"] = f"{at(p, i)} + {dt} * {at(p, i + 3)}"
            out[f"{name}{p}{i + 3}"] = f"{at(p, i + 3)} + {dt} * ({g!r}::DOUBLE * ({come[i]}) - 2 * {at(p, i + 3)} - {at(p, i)} / {t!r}::DOUBLE) / {t!r}::DOUBLE"
    return out, " + ".join(f"{m} * ({out[f'{name}{p}1']} - ({out[f'{name}{p}2']}))" for p, m in enumerate(mix))


def _one_column_sql(populations: list[tuple], mix: list[str], start: list[float]) -> str:
    step, _ = column_sql(populations, mix, "n.p", "0.001")
    names = sorted(step)
    out = " + ".join(f"{m} * (x{p}1 - x{p}2)" for p, m in enumerate(mix))
    return f"{recursion(dict(zip(names, map(repr, start), strict=True)), step)} SELECT recording, t, {chosen(names)}, {rsql(f'{out}')} AS potential FROM s"


_STATES = [f"x{p}{i}" for p in range(2) for i in range(6)]
_START = [0.05, 10.0, 8.0, 0.1, -0.2, 0.3]


@query(_one_column_sql([simulate.SLOW], ["1.0"], _START))
def jansen_rit(spark, sf):
    out = simulate.cortical_column(driven(spark, sf), "p", KEY, x0=_START, dt=1e-3)
    return out.select("recording", "t", *items("state", _STATES[:6]), rounded("out").alias("potential"))


@query(_one_column_sql([simulate.SLOW, simulate.FAST], ["0.7", "0.3"], [*_START, *_START]))
def jansen_rit_ext(spark, sf):
    out = simulate.dual_column(driven(spark, sf), "p", KEY, x0=[*_START, *_START], dt=1e-3, mix=0.7)
    return out.select("recording", "t", *items("state", _STATES), rounded("out").alias("potential"))


def _network_sql(hold: int) -> str:
    """Two nodes, the first drives the second with weight 0.4. States of both nodes, held potentials d and f, running mean c and squares q of the rates. A row
    before the first one (t = -1) holds the resting state."""
    leave, gain = ("1.0", "0.6"), "0.8"
    inner = ["220 + 22 * n.e0 * 1.0", f"220 + 22 * n.e1 * {leave[1]} + ({_rate_sql('s.d0')} - 3.84) * 22 * {gain} / CASE WHEN n.t > 1 THEN sqrt(s.q0 / n.t) ELSE 1 END"]
    names, step = [f"{c}{i}" for i in range(2) for c in "odfcq"], {}
    for i in range(2):
        states, out = column_sql([simulate.SLOW, simulate.FAST], ["0.8", "(1 - 0.8::DOUBLE)"], inner[i], "0.001", f"n{i}_")
        step |= states
        rate = f"({_rate_sql(out)})"
        new = f"(s.c{i} + ({rate} - s.c{i}) / (n.t + 1))"
        first = f"CASE WHEN n.t % {hold} = 0 THEN {out} ELSE s.f{i} END"
        step |= {f"o{i}": out, f"f{i}": first, f"d{i}": f"CASE WHEN (n.t + 1) % {hold} = 0 THEN {first} ELSE s.d{i} END", f"c{i}": new, f"q{i}": f"s.q{i} + ({rate} - s.c{i}) * ({rate} - {new})"}
    zero = ", ".join(f"0::DOUBLE AS {k}" for k in step)
    new = ", ".join(f"CAST({v} AS DOUBLE)" for v in step.values())
    assert set(names) <= set(step)
    return f"""WITH RECURSIVE {_NOISE}, s AS (SELECT recording, CAST(-1 AS BIGINT) AS t, {zero} FROM nz WHERE t = 0 UNION ALL SELECT n.recording, n.t, {new} FROM s JOIN nz n ON n.recording = s.recording AND n.t = s.t + 1)
 SELECT recording, t, {rsql('o0', 3)} AS o0, {rsql('o1', 3)} AS o1 FROM s WHERE t >= 0"""


@query(_network_sql(10))
def jr_network(spark, sf):
    out = simulate.column_network(driven(spark, sf), ["e0", "e1"], [[0.0, 0.4], [0.0, 0.0]], KEY)
    return out.select("recording", "t", *items("out", ["o0", "o1"], 3))
