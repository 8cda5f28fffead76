"""Word-level text files as DataFrames. Lines keep their number, so that an order that a file has is a column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def whole_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line_no from 1, line) of text files; a file is one transcript or word list and is numbered in one piece."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.regexp_replace("value", r"\r\n?", "\n").alias("v"))
    return numbered(files, "v", ["path"])


def transcripts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): every file's whole text."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def numbered(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    lines = df.select(*keep, F.posexplode(F.split(text, "\n")).alias("p", "line"))
    return lines.select(*keep, (F.col("p") + 1).cast("int").alias("line_no"), "line")


def fields(line: Column, separator: str = r"\s+") -> Column:
    return F.split(F.trim(line) if separator == r"\s+" else line, separator)


def praat_duration(lines: DataFrame) -> DataFrame:
    """The number on the fifth line of a header."""
    return lines.filter("line_no = 5").select("path", F.trim("line").cast("double").alias("duration"))


def surprisal(table: DataFrame, word: str = "word", p: str = "p", eps: float = 1e-12) -> DataFrame:
    """-ln(p + eps) of a model's probabilities, without the sentence end and stray apostrophes."""
    return table.filter(~F.col(word).isin("</s>", "'")).withColumn("surprisal", -F.log(F.col(p) + eps))


def word_frequency(table: DataFrame, column: str = "frequency", unknown: float = 111773390.0, norm: float = 3.2137e12) -> DataFrame:
    """-ln(frequency / norm); -1 stands for an unknown word."""
    return table.withColumn("wordfrequency", -F.log(F.when(F.col(column) == -1, F.lit(unknown)).otherwise(F.col(column)) / norm))


def header_table(lines: DataFrame, separator: str | None = None, lower: bool = True) -> DataFrame:
    """A table with a header line: comma separated, or by white space if the header has the column ton, which then is called onset."""
    head = lines.filter("line_no = 1").select("line").first()["line"]
    spaced = "ton" in head.split() if separator is None else separator != ","
    names = head.split() if spaced else [x.strip() for x in head.split(",")]
    names = ["onset" if spaced and x == "ton" else x for x in names]
    parts = fields(F.col("line"), r"\s+" if spaced else ",")
    rows = lines.filter("line_no > 1 and trim(line) <> ''").withColumn("__f", parts)
    return rows.select("path", (F.col("line_no") - 1).alias("word_pos"), *[F.trim(F.col("__f")[i]).alias(n.lower() if lower else n) for i, n in enumerate(names)])


def word_onsets(lines: DataFrame) -> DataFrame:
    return header_table(lines).select("path", "word_pos", "word", F.col("onset").cast("double").alias("onset"))


def syntactic(lines: DataFrame, what: str) -> DataFrame:
    """depth, open or close by word; without a header (depth only): word, depth, onset, offset."""
    head = lines.filter("line_no = 1").select("line").first()["line"]
    if "ton" in head.split():
        return header_table(lines).select("path", "word_pos", "word", F.col(what).cast("double").alias(what))
    if what != "depth":
        raise ValueError("without a header there is only depth")
    f = fields(F.col("line"))
    return lines.filter("trim(line) <> ''").select("path", F.col("line_no").alias("word_pos"), f[0].alias("word"), f[1].cast("double").alias("depth"), f[2].cast("double").alias("onset"), f[3].cast("double").alias("offset"))


def sentence_positions(lines: DataFrame, keep: list[str]) -> DataFrame:
    """(word, position from 1) of one sentence a line; blank lines are none."""
    words = F.filter(F.split("line", r"\s+"), lambda w: w != "")
    return lines.select(*keep, "line_no", F.posexplode(words).alias("p", "word")).select(*keep, "line_no", "word", (F.col("p") + 1).cast("int").alias("position"))


def vectors(lines: DataFrame, most: int | None = 30_000) -> DataFrame:
    """Word vectors of text files: a first line 'count dim', then word and numbers; the first most of each file, with None all."""
    f = F.split(F.trim("line"), " ")
    rows = lines.filter((F.col("line_no") > 1) & (F.trim("line") != ""))
    rows = rows if most is None else rows.filter(F.col("line_no") <= most + 1)
    return rows.select(f[0].alias("word"), F.transform(F.slice(f, 2, 1 << 20), lambda x: x.cast("float")).alias("vec"))


def by_position(table: DataFrame, place: int | str) -> Column:
    """A column by its name or its position."""
    return F.col(place) if isinstance(place, str) else F.col(table.columns[place])


def from_code_points(points: Column) -> Column:
    """The string of an array of code points."""
    return F.array_join(F.transform(points, lambda p: F.char(p)), "")
