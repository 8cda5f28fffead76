"""MATLAB level 5 files (numeric, char and logical arrays, compressed or not) by the public format description. HDF5-based files need a reader that isn't here."""

from __future__ import annotations

import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession

#: Fixed values of the format: numpy types by data type number.
KINDS = {1: "i1", 2: "u1", 3: "i2", 4: "u2", 5: "i4", 6: "u4", 7: "f4", 9: "f8", 12: "i8", 13: "u8", 16: "u1", 17: "u2", 18: "u4"}


def _element(raw: memoryview, at: int, order: str) -> tuple[int, memoryview, int]:
    kind, size = struct.unpack_from(order + "II", raw, at)
    if kind >> 16:  # small element: both in four bytes
        return kind & 0xFFFF, raw[at + 4 : at + 4 + (kind >> 16)], at + 8
    end = at + 8 + size
    return kind, raw[at + 8 : end], end if kind == 15 else end + (-size) % 8


def read(raw: bytes) -> dict[str, np.ndarray]:
    view = memoryview(raw)
    if len(raw) < 128 or raw[126:128] not in (b"IM", b"MI"):
        raise ValueError("not a level 5 file")
    order, at, out = "<" if raw[126:128] == b"IM" else ">", 128, {}
    while at < len(view):
        kind, data, at = _element(view, at, order)
        if kind == 15:
            kind, data, _ = _element(memoryview(zlib.decompress(data)), 0, order)
        if kind != 14:
            continue
        _, flags, p = _element(data, 0, order)
        cls = struct.unpack_from(order + "I", flags)[0]
        _, dims, p = _element(data, p, order)
        _, name, p = _element(data, p, order)
        shape = np.frombuffer(dims, order + "i4")
        if cls & 0xFF in (1, 2, 3, 5):
            continue  # cells, structs, objects and sparse arrays
        k, real, p = _element(data, p, order)
        x = np.frombuffer(real, order + KINDS[k]).reshape(shape, order="F")
        if cls & 0x800:
            k, imag, p = _element(data, p, order)
            x = x + 1j * np.frombuffer(imag, order + KINDS[k]).reshape(shape, order="F")
        out[bytes(name).decode("latin1")] = x
    return out


def signal(spark: SparkSession, path: str, variable: str) -> DataFrame:
    """(path, t, x): rows of a two-dimensional variable of each file."""
    import pandas as pd

    def run(batches):
        for pdf in batches:
            for p, raw in zip(pdf["path"], pdf["content"], strict=True):
                x = read(raw)[variable].astype(float)
                yield pd.DataFrame({"path": p, "t": np.arange(len(x)), "x": list(x.reshape(len(x), -1))})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, t long, x array<double>")
