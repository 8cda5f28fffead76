"""Lagged designs. A positive lag is the past."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import present


def lag_span(tmin: float, tmax: float, srate: float) -> list[int]:
    """Samples from tmin to tmax, the end excluded; both ends round up in doubles."""
    return list(range(math.ceil(tmin * srate), math.ceil(tmax * srate)))


def lag_sparse(times: Sequence[float], srate: float) -> list[int]:
    return [math.ceil(t * srate) for t in times]


def indexed(df: DataFrame, key: list[str], order: list[str], name: str = "t") -> DataFrame:
    """The sample index 0, 1, ... of each recording, in the order of unique columns."""
    return df.withColumn(name, (F.row_number().over(Window.partitionBy(*key).orderBy(*order)) - 1).cast("long"))


def lag_name(column: str, lag: int) -> str:
    return f"{column}_m{-lag}" if lag < 0 else f"{column}_{lag}"


def lag_features(df: DataFrame, columns: list[str], lags: Sequence[int], key: list[str], order: list[str], fill: float | None = None, drop: bool = False) -> DataFrame:
    """df with a column for each lag and column (lag first, then column). Missing is what lies over a recording's edge and what was NaN or null before.

    All lags share one sort and one window. For long spans use lag_array().
    """
    if fill is not None and drop:
        raise ValueError("either fill or drop")
    over = Window.partitionBy(*key).orderBy(*order)
    names = [lag_name(c, k) for k in lags for c in columns]
    new = [F.lag(present(F.col(c)), k).over(over).alias(lag_name(c, k)) for k in lags for c in columns]
    out = df.select("*", *new)
    if drop:
        return out.na.drop(subset=names)
    return out.na.fill(fill, subset=names) if fill is not None else out


def lag_array(df: DataFrame, column: str, low: int, high: int, key: list[str], order: list[str], name: str = "lagged") -> DataFrame:
    """One array for each row whose lags low..high are all there, oldest (lag high) first: a single frame for spans of any length."""
    over = Window.partitionBy(*key).orderBy(*order).rowsBetween(-high, -low)
    return df.withColumn(name, F.collect_list(F.struct(present(F.col(column)).alias("v"))).over(over)).filter(F.size(name) == high - low + 1).withColumn(name, F.transform(name, lambda s: s["v"]))


def design_lags(df: DataFrame, columns: list[str], order_p: int, key: list[str], order: list[str]) -> DataFrame:
    """Lags 1..p, without the first p rows of a recording."""
    return lag_features(df, columns, range(1, order_p + 1), key, order, drop=True)


def valid_samples(df: DataFrame, lags: Sequence[int], key: list[str], t: str = "t") -> DataFrame:
    """Rows whose lags all lie inside their recording."""
    before, after = max(0, *lags), max(0, *(-k for k in lags))
    n = F.count(F.lit(1)).over(Window.partitionBy(*key))
    return df.withColumn("__n", n).filter((F.col(t) >= before) & (F.col(t) < F.col("__n") - after)).drop("__n")


def haloed(df: DataFrame, size: int, before: int, after: int, key: list[str], t: str = "t") -> DataFrame:
    """Cut recordings into blocks of size samples, each with the neighbours' rows that lags need (own is false there): one huge recording is then as
    parallel as many. Lag inside (key, block), then keep own rows."""
    block = F.floor(F.col(t) / size)
    first = F.greatest(F.lit(0), F.floor((F.col(t) - after) / size))
    return df.withColumn("block", F.explode(F.sequence(first, F.floor((F.col(t) + before) / size)))).withColumn("own", F.col("block") == block)
