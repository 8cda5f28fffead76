"""Streams give what batches give."""

import numpy as np
from pyspark.sql import functions as F

from wavelake.functions.numeric import recursive
from wavelake.streaming import windows


def test_stateful_filter_over_batches(spark, tmp_path):
    x = np.random.default_rng(0).normal(size=60)
    for k in range(3):
        rows = [(1, t, float(x[t])) for t in range(20 * k, 20 * k + 20)]
        spark.createDataFrame(rows, "recording long, t long, x double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("recording long, t long, x double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = windows.recursive_filter(stream, "recording", "t", "x", [0.2, 0.1], [1.0, -0.5, 0.25])
    q = out.writeStream.format("memory").queryName("filtered").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    got = [r["filtered"] for r in spark.table("filtered").orderBy("t").collect()]
    assert np.allclose(got, recursive(np.array([0.2, 0.1]), np.array([1, -0.5, 0.25]), x))


def test_moving_power_and_gram(spark, sf, tmp_path):
    df = spark.read.parquet(f"{sf}/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), "user_id", "value")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    for name, out in (("power", windows.moving_power(stream, "ts", "value", [], "1 day", "12 hours", "1 day")), ("sums", windows.gram(stream, ["value"], ["user_id"]))):
        q = out.writeStream.format("memory").queryName(name).outputMode("complete").option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
    assert spark.table("power").agg(F.sum("n")).first()[0] == 2 * df.count()
    assert spark.table("sums").agg(F.sum("n")).first()[0] == df.count()
