"""Saved response models: Parquet tables of coefficients beside a row of settings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.response import SCHEMA, ResponseModel


def save(model: ResponseModel, table: DataFrame, path: str, srate: float) -> None:
    table.write.mode("overwrite").parquet(f"{path}/coefficients")
    settings = [(model.lags, model.alphas, model.intercept, float(srate))]
    table.sparkSession.createDataFrame(settings, "lags array<int>, alphas array<double>, intercept boolean, srate double").coalesce(1).write.mode("overwrite").parquet(f"{path}/settings")


def load(spark: SparkSession, path: str) -> tuple[ResponseModel, DataFrame, float]:
    s = spark.read.parquet(f"{path}/settings").first()
    return ResponseModel(s["lags"], list(s["alphas"]), s["intercept"]), spark.read.schema(SCHEMA).parquet(f"{path}/coefficients"), s["srate"]
