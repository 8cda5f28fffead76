"""Gram matrices: sums of products, aggregated where the data are. The lagged design itself is never stored."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

#: A matrix comes to the driver only up to this many columns.
MOST = 5_000
#: Up to this many columns the sums are plain SQL aggregates.
SQL_MOST = 10


def gram_table(df: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """Long table (by, i, j, v) of sums of products, i <= j, by one aggregation with partial sums."""
    by = by or []
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    sums = df.groupBy(*by).agg(*[F.sum(F.col(columns[i]).cast("double") * F.col(columns[j]).cast("double")).alias(f"__{i}_{j}") for i, j in pairs])
    items = F.array(*[F.struct(F.lit(columns[i]).alias("i"), F.lit(columns[j]).alias("j"), F.col(f"__{i}_{j}").alias("v")) for i, j in pairs])
    return sums.select(*by, F.explode(items).alias("__p")).select(*by, "__p.i", "__p.j", "__p.v")


def gram_matrix(df: DataFrame, columns: list[str]) -> np.ndarray:
    """The p x p matrix on the driver. Few columns: SQL sums; more: partial matrices by partition, added row by row on the executors."""
    p = len(columns)
    if p > MOST:
        raise ValueError(f"{p} columns are too many for one dense solve")
    data = df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)])
    out = np.zeros((p, p))
    if p <= SQL_MOST:
        row = data.agg(*[F.sum(F.col(f"c{i}") * F.col(f"c{j}")).alias(f"g{i}_{j}") for i in range(p) for j in range(i, p)]).first()
        for i in range(p):
            for j in range(i, p):
                out[i, j] = out[j, i] = row[f"g{i}_{j}"] or 0.0
        return out

    def partial(batches):
        total = np.zeros((p, p))
        for b in batches:
            x = np.column_stack([b.column(i).to_numpy(zero_copy_only=False) for i in range(p)])
            total += x.T @ x
        yield pa.RecordBatch.from_pydict({"i": pa.array(range(p), pa.int32()), "row": pa.array(list(total), pa.list_(pa.float64()))})

    def add(table):
        rows = table["row"].to_pylist()
        return pa.table({"i": table["i"].slice(0, 1), "row": pa.array([np.sum(rows, axis=0)], pa.list_(pa.float64()))})

    parts = data.mapInArrow(partial, "i int, row array<double>")
    for r in parts.groupBy("i").applyInArrow(add, "i int, row array<double>").collect():
        out[r["i"]] = r["row"]
    return out


def gram_groups(df: DataFrame, columns: list[str], by: list[str]) -> DataFrame:
    """(by, gram as one array of p * p): partial matrices by partition and group, added on the executors, however many columns there are."""
    p, kinds = len(columns), dict(df.dtypes)
    schema = ", ".join([*[f"{b} {kinds[b]}" for b in by], "gram array<double>"])
    data = df.select(*by, F.array(*[F.col(c).cast("double") for c in columns]).alias("__x"))
    kind = {c: to_arrow_type(data.schema[c].dataType) for c in by}

    def partial(batches):
        total: dict[tuple, np.ndarray] = {}
        for b in batches:
            x = b["__x"].values.to_numpy(zero_copy_only=False)[b["__x"].offset * p :].reshape(-1, p)[: b.num_rows]
            keys = list(zip(*[b[c].to_pylist() for c in by], strict=True))
            names = {k: i for i, k in enumerate(dict.fromkeys(keys))}
            code = np.array([names[k] for k in keys], np.int64)
            for k, i in names.items():
                mine = x[code == i]
                total[k] = total.get(k, 0) + mine.T @ mine
        if total:
            cols = {c: [k[j] for k in total] for j, c in enumerate(by)}
            yield pa.RecordBatch.from_pydict({**{c: pa.array(v, kind[c]) for c, v in cols.items()}, "gram": pa.array([g.ravel() for g in total.values()], pa.list_(pa.float64()))})

    def add(table):
        return table.slice(0, 1).select(by).append_column("gram", pa.array([np.sum(table["gram"].to_pylist(), axis=0)], pa.list_(pa.float64())))

    return data.mapInArrow(partial, schema).groupBy(*by).applyInArrow(add, schema)


def ridge(g: np.ndarray, xs: list[int], ys: list[int], alphas: list[float]) -> np.ndarray:
    """(alphas, len(xs), len(ys)) coefficients of (X'X + alpha I)^-1 X'Y from one factorisation; alpha 0 is least squares (smallest norm if singular)."""
    if min(alphas) < 0:
        raise ValueError("alpha must not be negative")
    value, vector = np.linalg.eigh(g[np.ix_(xs, xs)])
    side = vector.T @ g[np.ix_(xs, ys)]
    tiny = value.max(initial=0.0) * len(xs) * np.finfo(float).eps
    out = []
    for a in alphas:
        inverse = np.where(value + a > tiny, 1 / np.where(value + a > tiny, value + a, 1), 0.0)
        out.append(vector @ (inverse[:, None] * side))
    return np.array(out)
