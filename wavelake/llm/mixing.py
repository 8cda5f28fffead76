"""Mixing sources to target weights by Efraimidis-Spirakis sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, running


#: With more sources than this the table of targets, one row a source, isn't broadcast.
MOST_BROADCAST = 100_000


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: dict, weights: dict, cap: float = 3.0) -> dict:
    """Share all sizes by weight; no source gets over cap times its size, and what is above is shared again by weight until none is above."""
    out, budget, free = {}, float(sum(sizes.values())), set(sizes)
    while free:
        total = sum(weights[s] for s in free)
        part = {s: budget * weights[s] / total for s in free} if total else dict.fromkeys(free, 0.0)
        above = {s for s in free if part[s] > cap * sizes[s]}
        if not above:
            return out | part
        out |= {s: cap * sizes[s] for s in above}
        budget -= sum(out[s] for s in above)
        free -= above
    return out


def by_code_point(source) -> tuple:
    return (source is None, [ord(c) for c in source or ""])


def draw(key: Column, seed: int) -> Column:
    """A number between 0 and 1 from a hash."""
    return (F.shiftrightunsigned(F.xxhash64(key, F.lit(seed)), 11).cast("double") + 0.5) / float(2**53)


def shares(units: DataFrame, source_weights, cap: float, quality: DataFrame | None, seed: int, rows_per_bucket: int) -> DataFrame:
    """units (doc_id, source, size, hash, held: how many rows are alike) with source_size, target, epochs and rest: the words that the last, broken epoch takes
    of the unit's rows, one row after the other."""
    spark = units.sparkSession
    words = F.col("size") * F.col("held")
    stats = {r["source"]: (r["words"], r["n"]) for r in units.groupBy("source").agg(F.sum(words).alias("words"), F.count("*").alias("n")).collect()}
    names = sorted(stats, key=by_code_point)
    weight = {s: float(source_weights[s] if isinstance(source_weights, dict) else source_weights[i % len(source_weights)]) for i, s in enumerate(names)}
    target = targets({s: stats[s][0] for s in names}, weight, cap)
    plan = spark.createDataFrame([(s, int(stats[s][0]), float(target[s])) for s in names], "source string, source_size long, target double")
    if quality is None:
        df = units.withColumn("__weight", F.lit(1.0))
    else:
        q = quality.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("weight").cast("double")).alias("__weight"))
        df = units.join(q, "doc_id", "left").withColumn("__weight", F.when(F.col("__weight") > 0, F.col("__weight")).otherwise(F.lit(1.0)))
    df = df.withColumn("__key", -F.ln(draw(F.struct("doc_id", "hash"), seed)) / F.col("__weight"))
    spread = max(64, -(-sum(n for _, n in stats.values()) // rows_per_bucket))
    df = df.withColumn("__bucket", F.floor((1 - F.exp(-F.col("__key"))) * spread).cast("int"))
    df = running(df, ["source"], "__bucket", ["__key", "doc_id", "hash", *[c for c in ("__h1", "__h2") if c in units.columns]], {"__before": words})
    if len(names) <= MOST_BROADCAST:
        plan = F.broadcast(plan)
    df = df.join(plan, df["source"].eqNullSafe(plan["source"]), "inner").drop(plan["source"])
    budget = F.rint("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rest = budget - epochs * F.col("source_size") - F.col("__before")
    return df.withColumns({"epochs": epochs, "rest": F.greatest(F.lit(0).cast("long"), F.least(words, rest))}).drop("__weight", "__key", "__bucket", "__before")


def mix(docs: DataFrame, source_weights=(1.0, 2.0, 3.0), cap: float = 3.0, quality: DataFrame | None = None, seed: int = 11, rows_per_bucket: int = 50_000, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """How many words of each document the mix takes: doc_id, size, source_size, target, taken, epochs.

    source_weights: a dict by source, or a tuple that repeats over the sources by code point, null last. A source takes whole epochs while its target
    allows; the rest goes to documents in the order of the exponential key -ln(u) / quality, u from a hash of doc_id and text (Efraimidis-Spirakis: the
    smallest keys are a sample without replacement by quality), up to the budget by a running sum; the document at its edge gives its first words only, so a
    source's words meet its target to a word. quality: (doc_id, weight > 0), others weigh 1.

    The sums by source, one row each, come to the driver; sources are labels, not documents. Rows alike in doc_id, source and text are one unit, which gives
    its rows in turn; units are cut into buckets by key, so that a hot source, id or text is spread. Null texts have no words and take none; null sources are
    a source; null ids are ids like others; an empty table gives no rows; other columns are ignored.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"), n_words(F.col(text)).alias("size"), F.xxhash64(F.col(text)).alias("hash"))
    units = rows.groupBy("doc_id", "source", "size", "hash").agg(F.count("*").alias("held"))
    df = shares(units, source_weights, cap, quality, seed, rows_per_bucket).withColumn("__row", F.explode(F.sequence(F.lit(0).cast("long"), F.col("held") - 1)))
    part = F.greatest(F.lit(0).cast("long"), F.least("size", F.col("rest") - F.col("__row") * F.col("size")))
    return df.select("doc_id", "size", "source_size", "target", (F.col("epochs") * F.col("size") + part).cast("long").alias("taken"), "epochs")


def take(docs: DataFrame, source_weights=(1.0, 2.0, 3.0), cap: float = 3.0, quality: DataFrame | None = None, seed: int = 11, rows_per_bucket: int = 50_000, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The rows of docs as often as the mix takes them, with docs' columns: the pipeline's stage. A document's whole text comes once for each epoch and once
    more where the rest reaches it; documents without words cost nothing and stay. Each row counts by itself, whether its id is null, repeated or neither."""
    hashes = {"__h1": F.xxhash64(*docs.columns), "__h2": F.xxhash64(F.lit(1), *docs.columns)}
    slim = docs.select(*[v.alias(k) for k, v in hashes.items()], F.col(doc_id).cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"), n_words(F.col(text)).alias("size"), F.xxhash64(F.col(text)).alias("hash"))
    units = slim.groupBy("__h1", "__h2", "doc_id", "source", "size", "hash").agg(F.count("*").alias("held"))
    df = shares(units, source_weights, cap, quality, seed, rows_per_bucket)
    copies = F.when(F.col("size") == 0, F.col("held")).otherwise(F.col("epochs") * F.col("held") + F.ceil(F.col("rest") / F.col("size")))
    plan = df.select("__h1", "__h2", copies.cast("int").alias("__copies")).filter("__copies > 0")
    whole = docs.select(*[v.alias(k) for k, v in hashes.items()], F.struct(*docs.columns).alias("__row")).groupBy("__h1", "__h2").agg(F.first("__row").alias("__row"))
    out = whole.join(plan, ["__h1", "__h2"]).withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies"))))
    return out.select(*[F.col("__row")[c].alias(c) for c in docs.columns])
