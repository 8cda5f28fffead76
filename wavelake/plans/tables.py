"""The driver tables as signals, and SQL text for the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lags import indexed

KEY, ORDER = ["recording"], ["t"]


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One recording a user: sample t, x = value, y = k of the properties."""
    df = load(spark, sf_dir, "events").select("event_id", "ts", F.col("user_id").alias("recording"), F.col("value").alias("x"), F.get_json_object("props", "$.k").cast("double").alias("y"), "event_type")
    return indexed(df, KEY, ["ts", "event_id"]).select("event_id", "recording", "t", "x", "y", "event_type")


def embeddings(spark: SparkSession, sf_dir: str, dims: int) -> DataFrame:
    df = load(spark, sf_dir, "embeddings")
    return df.select("vec_id", "label", *[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(dims)])


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.text_tables import numbered

    return numbered(load(spark, sf_dir, "documents"), "text", ["doc_id"])


def rounded(c, digits: int = 6):
    return F.round(c, digits) + F.lit(0.0)


def rsql(x: str, digits: int = 6) -> str:
    return f"(round({x}, {digits}) + 0.0)"


EV = """ev AS (SELECT event_id, user_id AS recording, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS t, value AS x,
 CAST(props::json->>'k' AS DOUBLE) AS y, event_type FROM events)"""


def lagged_sql(lags: list[int], columns: tuple[str, ...] = ("x",), source: str = "ev") -> str:
    name = lambda c, k: f"{c}_m{-k}" if k < 0 else f"{c}_{k}"
    cols = ", ".join(f"lag({c}, {k}) OVER w AS {name(c, k)}" for k in lags for c in columns)
    return f"lg AS (SELECT *, {cols} FROM {source} WINDOW w AS (PARTITION BY recording ORDER BY t))"


def emb_sql(dims: int) -> str:
    return "em AS (SELECT vec_id, label, " + ", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) AS e{i}" for i in range(dims)) + " FROM embeddings)"


def sums_sql(name: str, source: str, xs: list[str], ys: list[str], keys: str = "", alpha: str = "0", where: str = "true") -> str:
    """A CTE of Gram sums a_i_j, the ridge on the diagonal, right sides in the last columns."""
    cols = []
    for i, a in enumerate(xs):
        for j, b in enumerate([*xs, *ys]):
            cols.append(f"sum(({a}) * ({b}))" + (f" + {alpha}" if i == j else "") + f" AS a_{i}_{j}")
    k = f"{keys}, " if keys else ""
    return f"{name} AS (SELECT {k}{', '.join(cols)} FROM {source} WHERE {where}" + (f" GROUP BY {keys}" if keys else "") + ")"


def solve_sql(source: str, p: int, m: int = 1, keys: str = "") -> str:
    """CTEs s0..s(p-1) of elimination; solutions are a_i_(p+c) of the last."""
    k_, out, cur = f"{keys}, " if keys else "", [], source
    for k in range(p):
        cols = [f"a_{k}_{j} / a_{k}_{k} AS a_{k}_{j}" if i == k else f"a_{i}_{j} - a_{i}_{k} * a_{k}_{j} / a_{k}_{k} AS a_{i}_{j}" for i in range(p) for j in range(k + 1, p + m)]
        out.append(f"s{k} AS (SELECT {k_}{', '.join(cols)} FROM {cur})")
        cur = f"s{k}"
    return ", ".join(out)
