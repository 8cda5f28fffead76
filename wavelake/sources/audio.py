"""PCM WAV files through Spark's binary reader."""

from __future__ import annotations

import io
import wave

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession


def _open(raw: bytes) -> tuple[np.ndarray, int]:
    with wave.open(io.BytesIO(raw)) as w:
        width, channels, rate, data = w.getsampwidth(), w.getnchannels(), w.getframerate(), w.readframes(w.getnframes())
    if width == 1:
        x = np.frombuffer(data, np.uint8).astype(float) - 128
    elif width == 3:
        b = np.frombuffer(data, np.uint8).reshape(-1, 3).astype(np.int32)
        x = ((b[:, 0] | b[:, 1] << 8 | b[:, 2] << 16) ^ 0x800000) - 0x800000
    else:
        x = np.frombuffer(data, {2: "<i2", 4: "<i4"}[width])
    return x.reshape(-1, channels).astype(float) / (1 << (8 * width - 1)), rate


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def decoded(files: DataFrame, block: int = 65_536) -> DataFrame:
    """(path, rate, t, x) of files (path, content): one row a sample, all channels in x, full scale 1."""

    def run(batches):
        for pdf in batches:
            for p, raw in zip(pdf["path"], pdf["content"], strict=True):
                x, rate = _open(raw)
                for a in range(0, len(x), block):
                    part = x[a : a + block]
                    yield pd.DataFrame({"path": p, "rate": rate, "t": np.arange(a, a + len(part)), "x": list(part)})

    return files.select("path", "content").mapInPandas(run, "path string, rate int, t long, x array<double>")


def durations(files: DataFrame) -> DataFrame:
    """(path, duration) of files (path, content): (samples - 1) / rate."""

    def run(batches):
        for pdf in batches:
            out = []
            for raw in pdf["content"]:
                with wave.open(io.BytesIO(raw)) as w:
                    out.append((w.getnframes() - 1) / w.getframerate())
            yield pd.DataFrame({"path": pdf["path"], "duration": out})

    return files.select("path", "content").mapInPandas(run, "path string, duration double")


def encoded(df: DataFrame, x: str, rate: int, key: str, order: str = "t") -> DataFrame:
    """(path, content): a 16-bit PCM file of one channel for each key, from samples in full scale 1."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = io.BytesIO()
        with wave.open(out, "wb") as w:
            w.setnchannels(1)
            w.setsampwidth(2)
            w.setframerate(rate)
            values = np.rint(np.clip(pdf.sort_values(order)[x].to_numpy(float) * 32768, -32768, 32767))
            w.writeframes(values.astype("<i2").tobytes())
        return pd.DataFrame({"path": [str(pdf[key].iloc[0])], "content": [out.getvalue()]})

    return df.select(key, order, x).groupBy(key).applyInPandas(run, "path string, content binary")


def wav_samples(spark: SparkSession, path: str) -> DataFrame:
    return decoded(_files(spark, path))


def wav_durations(spark: SparkSession, path: str) -> DataFrame:
    return durations(_files(spark, path))
