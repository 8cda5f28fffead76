"""Windows over samples: chunks, moving statistics, power, phases, onsets, knees."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def chunks(df: DataFrame, size: int, overlap: int, key: list[str], t: str = "t", pad: bool = False) -> DataFrame:
    """Each row once for each window of size samples that holds it (column window; step size - overlap). Windows over the end are left out, or with pad
    filled with copies of the last sample."""
    step = size - overlap
    n = F.count(F.lit(1)).over(Window.partitionBy(*key))
    full = F.greatest(F.floor((F.col("__n") - size) / step) + 1, F.lit(0))
    count = F.when(F.col("__n") > 0, F.greatest(F.ceil((F.col("__n") - size) / step) + 1, F.lit(1))) if pad else full
    out = df.withColumn("__n", n).withColumn("__windows", count)
    low = F.greatest(F.lit(0), F.ceil((F.col(t) - size + 1) / step))
    high = F.least(F.floor(F.col(t) / step), F.col("__windows") - 1)
    out = out.withColumn("window", F.explode(F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<bigint>"))))
    if pad:
        missing = F.when(F.col(t) == F.col("__n") - 1, F.greatest(F.lit(0), F.col("window") * step + size - F.col("__n"))).otherwise(F.lit(0))
        out = out.withColumn("__copy", F.explode(F.sequence(F.lit(0).cast("long"), missing))).drop("__copy")
    return out.drop("__n", "__windows")


def rolling(df: DataFrame, size: int, overlap: int, key: list[str], aggs: list[Column], t: str = "t", pad: bool = False) -> DataFrame:
    return chunks(df, size, overlap, key, t, pad).groupBy(*key, "window").agg(*aggs)


def rolling_function(df: DataFrame, function, schema: str, size: int, overlap: int, key: list[str], t: str = "t") -> DataFrame:
    """Any function of a window's rows (pandas), always padded."""
    return chunks(df, size, overlap, key, t, True).groupBy(*key, "window").applyInPandas(function, schema)


def sliding(df: DataFrame, column: str, size: int, key: list[str], t: str = "t") -> DataFrame:
    """All windows with step 1 as arrays."""
    over = Window.partitionBy(*key).orderBy(t).rowsBetween(0, size - 1)
    return df.select(*key, t, F.collect_list(column).over(over).alias("values")).filter(F.size("values") == size)


def moving_average(df: DataFrame, column: str, size: int, key: list[str], t: str = "t", name: str = "average") -> DataFrame:
    """Means of whole windows, at their first sample."""
    over = Window.partitionBy(*key).orderBy(t).rowsBetween(0, size - 1)
    return df.select("*", F.avg(column).over(over).alias(name), F.count(column).over(over).alias("__n")).filter(F.col("__n") == size).drop("__n")


def power(df: DataFrame, column: str, size: int, key: list[str], t: str = "t", db: bool = False, name: str = "power") -> DataFrame:
    """Squares smoothed by a boxcar of size samples, zeros outside."""
    over = Window.partitionBy(*key).orderBy(t).rowsBetween(-(size // 2), (size - 1) // 2)
    value = F.sum(F.col(column) * F.col(column)).over(over) / size
    return df.withColumn(name, 10 * F.log10(value + 1e-16) if db else value)


def frame_mean(df: DataFrame, column: str, size: int, key: list[str], t: str = "t") -> DataFrame:
    """Sums of frames of size samples over size: the last frame counts zeros after the end."""
    return df.groupBy(*key, F.floor(F.col(t) / size).cast("long").alias("frame")).agg((F.sum(column) / size).alias("value"))


def minmax(df: DataFrame, column: str, key: list[str], name: str = "scaled") -> DataFrame:
    over = Window.partitionBy(*key)
    low, high = F.min(column).over(over), F.max(column).over(over)
    return df.withColumn(name, F.when(high > low, (F.col(column) - low) / (high - low)).otherwise(F.lit(0.0)))


def zscore(df: DataFrame, column: str, key: list[str], name: str = "z") -> DataFrame:
    over = Window.partitionBy(*key)
    sd = F.stddev_pop(column).over(over)
    return df.withColumn(name, F.when(sd > 0, (F.col(column) - F.avg(column).over(over)) / sd).otherwise(F.lit(0.0)))


class Scaler:
    """A scaler fitted on one table and used on others: (x - mean) / deviation."""

    def fit(self, df: DataFrame, column: str) -> Scaler:
        row = df.agg(F.avg(column).alias("m"), F.stddev_pop(column).alias("s")).first()
        self.mean, self.spread = row["m"], row["s"]
        return self

    def __call__(self, x: Column) -> Column:
        return (x - self.mean) / self.spread if self.spread else F.lit(0.0)


def scaled(df: DataFrame, column: str, scaler: Callable[[Column], Column], name: str = "z") -> DataFrame:
    """A column through a scaler: a fitted one, or any function of the column."""
    return df.withColumn(name, scaler(F.col(column)))


def separate_onsets(df: DataFrame, sample: str, key: list[str], order: str, name: str = "sample") -> DataFrame:
    """An onset on the sample of the onset before it moves on by one; the original samples decide, once."""
    before = F.lag(sample).over(Window.partitionBy(*key).orderBy(order))
    return df.withColumn(name, F.when(F.col(sample) == before, F.col(sample) + 1).otherwise(F.col(sample)))


def unwrap(df: DataFrame, phase: str, key: list[str], t: str = "t", name: str = "unwrapped") -> DataFrame:
    """Phase without jumps: the first phase and the running sum of steps, each taken into (-pi, pi]."""
    over = Window.partitionBy(*key).orderBy(t)
    step = F.col(phase) - F.lag(phase).over(over)
    turned = df.withColumn("__step", F.coalesce(F.atan2(F.sin(step), F.cos(step)), F.col(phase)))
    return turned.withColumn(name, F.sum("__step").over(over.rowsBetween(Window.unboundedPreceding, 0))).drop("__step")


def instantaneous_frequency(df: DataFrame, phase: str, srate: float, centre: float, key: list[str], t: str = "t", name: str = "frequency") -> DataFrame:
    """Steps of an unwrapped phase around a centre frequency; the last sample has the centre itself."""
    ahead = F.lead(phase).over(Window.partitionBy(*key).orderBy(t))
    return df.withColumn(name, F.coalesce(centre + (ahead - F.col(phase)) * srate / (2 * math.pi), F.lit(centre)))


def knee(df: DataFrame, x: str, y: str, key: list[str], tolerance: float = 0.0) -> DataFrame:
    """x of the knee of a curve: y goes to [0, 1], angles between neighbours over pi go to [0, 1], the first interior point whose angle exceeds the
    tolerance is the knee; without one, the first interior point."""
    all_rows, over = Window.partitionBy(*key), Window.partitionBy(*key).orderBy(x)
    low, top = F.min(y).over(all_rows), F.max(y).over(all_rows)
    df = df.select(*key, x, ((F.col(y) - low) / F.nullif(top - low, F.lit(0.0))).alias("__y"))
    dx1, dy1 = F.lag(x).over(over) - F.col(x), F.lag("__y").over(over) - F.col("__y")
    dx2, dy2 = F.lead(x).over(over) - F.col(x), F.lead("__y").over(over) - F.col("__y")
    df = df.withColumn("__angle", (F.atan2(dy2, dx2) - F.atan2(dy1, dx1)) / math.pi).filter("__angle is not null")
    low, top = F.min("__angle").over(all_rows), F.max("__angle").over(all_rows)
    df = df.withColumn("__scaled", (F.col("__angle") - low) / F.nullif(top - low, F.lit(0.0)))
    return df.groupBy(*key).agg(F.coalesce(F.min(F.when(F.col("__scaled") > tolerance, F.col(x))), F.min(x)).alias("knee"))
