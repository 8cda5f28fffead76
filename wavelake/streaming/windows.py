"""Windowed statistics and recursive filters on streams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def moving_power(stream: DataFrame, time: str, value: str, key: list[str], size: str, step: str, late: str) -> DataFrame:
    """Mean and mean square by sliding event-time windows; rows later than late are dropped by the watermark."""
    return stream.withWatermark(time, late).groupBy(F.window(time, size, step), *key).agg(F.avg(value).alias("mean"), F.avg(F.col(value) * F.col(value)).alias("power"), F.count(value).alias("n"))


def gram(stream: DataFrame, columns: list[str], key: list[str]) -> DataFrame:
    """Sums of products, kept up to date: what a periodic re-fit of a response model needs."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    return stream.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col(a) * F.col(b)).alias(f"{a}__{b}") for a, b in pairs])


def recursive_filter(stream: DataFrame, key: str, order: str, value: str, b: list[float], a: list[float]) -> DataFrame:
    """A recursive filter whose state (a few numbers a key) lives in the state store; rows of a batch go in the order of order."""
    n = max(len(a), len(b))
    bb, aa = np.pad(np.array(b, float) / a[0], (0, n - len(b))), np.pad(np.array(a, float) / a[0], (0, n - len(a)))
    kinds = dict(stream.dtypes)

    def run(k: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        z = np.array(state.get[0]) if state.exists else np.zeros(n)
        rows = pd.concat(list(parts)).sort_values(order)
        out = []
        for x in rows[value].to_numpy(float):
            y = bb[0] * x + z[0]
            for i in range(1, n):
                z[i - 1] = bb[i] * x - aa[i] * y + (z[i] if i < n - 1 else 0.0)
            out.append(y)
        state.update((z.tolist(),))
        yield pd.DataFrame({key: rows[key], order: rows[order], "filtered": out})

    schema = f"{key} {kinds[key]}, {order} {kinds[order]}, filtered double"
    return stream.select(key, order, value).groupBy(key).applyInPandasWithState(run, schema, "z array<double>", "append", "NoTimeout")
