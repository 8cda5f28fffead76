"""Word-level features on the sample grid of a recording."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sample_of(onset: Column, srate: float) -> Column:
    """Half-even rounding of onset * srate."""
    return F.rint(onset * srate).cast("long")


def word_grid(words: DataFrame, features: list[str], srate: float, durations: DataFrame, key: list[str], onset: str = "onset", order: str = "word_pos") -> DataFrame:
    """(key, sample, onset indicator, features): ceil(srate * duration) samples a story, zeros between words. A word on the sample of the word before moves
    on by one; of words on one sample the last wins; words past the end are dropped. durations: (key, duration)."""
    over = Window.partitionBy(*key).orderBy(order)
    at = words.withColumn("__s", sample_of(F.col(onset), srate)).withColumn("sample", F.when(F.col("__s") == F.lag("__s").over(over), F.col("__s") + 1).otherwise(F.col("__s")))
    last = at.groupBy(*key, "sample").agg(*[F.max_by(f, order).alias(f) for f in features], F.lit(1.0).alias("word_onset"))
    n = F.ceil(F.col("duration") * srate).cast("long")
    grid = durations.select(*key, F.explode(F.when(n > 0, F.sequence(F.lit(0).cast("long"), n - 1)).otherwise(F.array().cast("array<bigint>"))).alias("sample"))
    out = grid.join(last, [*key, "sample"], "left")
    return out.select(*key, "sample", *[F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f) for f in ["word_onset", *features]])


def add_feature(features: DataFrame, new: DataFrame, keys: list[str], name: str, vector: str | None = None, dims: int = 0) -> DataFrame:
    """Inner join of a feature by recording and sample; an array becomes name_0.. ."""
    if vector:
        new = new.select(*keys, *[F.col(vector)[i].alias(f"{name}_{i}") for i in range(dims)])
    return features.join(new, keys, "inner")


def segment_samples(segments: DataFrame, srate: float) -> DataFrame:
    """First sample and number of samples of each segment: half-even rounding of the onset, and the steps of 1 / srate below the duration."""
    n = F.ceil(F.col("duration") / F.lit(1.0 / srate)).cast("long")
    return segments.withColumn("first", sample_of(F.col("onset"), srate)).withColumn("samples", n)


def slice_segments(recording: DataFrame, segments: DataFrame, srate: float, key: list[str], t: str = "t") -> DataFrame:
    """Rows of the recording inside segments, with the sample inside each (sample). Segments explode to their samples and meet rows by equality, so no
    range join is needed."""
    at = segment_samples(segments, srate).filter("samples > 0")
    at = at.withColumn("sample", F.explode(F.sequence(F.lit(0).cast("long"), F.col("samples") - 1))).withColumn(t, F.col("first") + F.col("sample"))
    return recording.join(at.drop("first", "samples"), [*key, t])


def append_segments(first: DataFrame, *more: DataFrame) -> DataFrame:
    """Rows one after another, columns by name, missing ones null."""
    for m in more:
        first = first.unionByName(m, allowMissingColumns=True)
    return first


def word_vectors(words: DataFrame, vectors: DataFrame, word: str = "word", unknown: str = "skip", dims: int | None = None) -> DataFrame:
    """Each word's vector by its lower-cased form; unknown words get zeros ('skip') or a unit vector drawn by the word's hash ('rdm')."""
    if unknown not in ("skip", "rdm"):
        raise ValueError("unknown words: 'skip' or 'rdm'")
    dims = dims or vectors.select(F.size("vec")).first()[0]
    table = vectors.select(F.lower("word").alias("__word"), "vec")
    joined = words.join(table, F.lower(F.col(word)) == F.col("__word"), "left").drop("__word")
    if unknown == "skip":
        other = F.array_repeat(F.lit(0.0), dims)
    else:
        u = lambda i, s: (F.shiftrightunsigned(F.xxhash64(F.lower(F.col(word)), F.lit(i), F.lit(s)), 11).cast("double") + 0.5) / float(2**53)
        g = F.array(*[F.sqrt(-2 * F.ln(u(i, 0))) * F.cos(2 * math.pi * u(i, 1)) for i in range(dims)])
        norm = F.sqrt(F.aggregate(g, F.lit(0.0), lambda a, x: a + x * x))
        other = F.transform(g, lambda x: x / norm)
    return joined.withColumn("vec", F.coalesce(F.col("vec").cast("array<double>"), other))


def story_features(onsets: DataFrame, tables: dict[str, DataFrame], srate: float, durations: DataFrame, key: list[str], vectors: DataFrame | None = None, dims: int = 0) -> DataFrame:
    """All word-level features of stories on their sample grid: onsets (key, word_pos, word, onset), tables by feature (key, word_pos, feature), and the
    words' vectors as vec_0.. ; words that a table lacks count 0 there."""
    words = onsets
    for name, table in tables.items():
        words = words.join(table.select(*key, "word_pos", F.col(name).cast("double").alias(name)), [*key, "word_pos"], "left")
    names = list(tables)
    if vectors is not None:
        words = word_vectors(words, vectors, dims=dims).select("*", *[F.col("vec")[i].alias(f"vec_{i}") for i in range(dims)])
        names += [f"vec_{i}" for i in range(dims)]
    return word_grid(words, names, srate, durations, key)


def aligned_speech(segments: DataFrame, durations: DataFrame, srate: float, key: list[str]) -> DataFrame:
    """Segments (key, onset) with the duration of their audio, first sample and number of samples."""
    return segment_samples(segments.join(durations, key), srate)
