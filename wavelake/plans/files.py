"""Sources as queries: driver tables are written as the files that a source reads, and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import words
from ..sources import audio, models, text_tables
from ..sources.scratch import scratch
from .registry import SQL, query
from .tables import EV, KEY, ORDER, events, load, rounded


def written(rows, name: str) -> str:
    """rows (story, line_no, line) as one text file a story."""
    path = scratch(rows.sparkSession, name)
    rows.repartition("story").sortWithinPartitions("story", "line_no").select("story", "line").write.partitionBy("story").text(path)
    return path


def story(path="path"):
    return F.regexp_extract(path, "story=([0-9]+)", 1).cast("long").alias("story")


def with_header(rows, header):
    """rows numbered from 1 in a story's order, the header as line 0. Header and first line come from one row: the sides of a union may be packed into tasks
    differently (the repartition of written() is dropped where both are already dealt by story), and the header then gets a file of its own."""
    from pyspark.sql import Window

    at = F.row_number().over(Window.partitionBy("story").orderBy("line_no")).cast("long")
    line = lambda no, text: F.struct(no.alias("line_no"), text.alias("line"))
    own = line(F.col("line_no"), F.col("line"))
    both = F.array(line(F.lit(0).cast("long"), F.col("head")), own)
    rows = rows.select("story", at.alias("line_no"), "line", F.lit(header).alias("head"))
    return rows.select("story", F.inline(F.when(F.col("line_no") == 1, both).otherwise(F.array(own))))


def stories(spark, sf):
    """Parts as words: seven stories, a word a line."""
    from pyspark.sql import Window

    df = load(spark, sf, "part").select((F.col("p_partkey") % 7).alias("story"), "p_partkey", F.regexp_replace("p_brand", " ", "_").alias("word"), "p_size")
    pos = F.row_number().over(Window.partitionBy("story").orderBy("p_partkey"))
    return df.select("story", pos.cast("int").alias("word_pos"), "word", "p_size", (pos * 0.25).cast("double").alias("onset"))


_STORIES = """st AS (SELECT p_partkey % 7 AS story, CAST(row_number() OVER (PARTITION BY p_partkey % 7 ORDER BY p_partkey) AS INTEGER) AS word_pos, replace(p_brand, ' ', '_') AS word, p_size FROM part),
 sw AS (SELECT *, CAST(word_pos * 0.25 AS DOUBLE) AS onset FROM st)"""


@query("SELECT CAST(n_nationkey AS BIGINT) AS story, n_nationkey / 8.0::DOUBLE + 1.5 AS duration FROM nation")
def praat_durations(spark, sf):
    df = load(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("story"))
    lines = F.array(F.lit("ooTextFile"), F.lit("Object class = TextGrid"), F.lit(""), F.lit("0"), (F.col("story") / 8.0 + 1.5).cast("string"), F.lit("<exists>"))
    path = written(df.select("story", F.posexplode(lines).alias("line_no", "line")), "praat")
    return text_tables.praat_duration(text_tables.whole_lines(spark, path)).select(story(), "duration")


def _syntax(spark, sf):
    rows = stories(spark, sf).select("story", F.col("word_pos").alias("line_no"), F.concat_ws(" ", "word", "p_size", F.col("p_size") % 5, F.col("p_size") % 3, "onset", F.col("onset") + 0.2).alias("line"))
    return text_tables.whole_lines(spark, written(with_header(rows, "Word Depth Open Close ton toff"), "syntax"))


def _syntax_sql(what: str, value: str) -> str:
    return f"WITH {_STORIES} SELECT story, word_pos, word, CAST({value} AS DOUBLE) AS {what} FROM sw"


@query(_syntax_sql("depth", "p_size"))
def depth_values(spark, sf):
    return text_tables.syntactic(_syntax(spark, sf), "depth").select(story(), "word_pos", "word", "depth")


@query(_syntax_sql("open", "p_size % 5"))
def open_values(spark, sf):
    return text_tables.syntactic(_syntax(spark, sf), "open").select(story(), "word_pos", "word", "open")


@query(_syntax_sql("close", "p_size % 3"))
def close_values(spark, sf):
    return text_tables.syntactic(_syntax(spark, sf), "close").select(story(), "word_pos", "word", "close")


@query(f"WITH {_STORIES} SELECT story, word_pos, word, CAST(p_size AS DOUBLE) AS depth, onset FROM sw")
def depth_headerless(spark, sf):
    rows = stories(spark, sf).select("story", F.col("word_pos").alias("line_no"), F.concat_ws("\t", "word", "p_size", "onset", F.col("onset") + 0.2).alias("line"))
    lines = text_tables.whole_lines(spark, written(rows, "depth"))
    return text_tables.syntactic(lines, "depth").select(story(), "word_pos", "word", "depth", "onset")


def _onsets(spark, sf):
    rows = stories(spark, sf).select("story", F.col("word_pos").alias("line_no"), F.concat_ws(",", "word", "onset", "p_size").alias("line"))
    lines = text_tables.whole_lines(spark, written(with_header(rows, "Word,Onset,Size"), "onsets"))
    return text_tables.word_onsets(lines).select(story(), "word_pos", "word", "onset")


@query(f"WITH {_STORIES} SELECT story, word_pos, word, onset FROM sw")
def word_onsets_csv(spark, sf):
    return _onsets(spark, sf)


@query(f"WITH {_STORIES} SELECT story, word_pos, word, onset FROM sw")
def word_onsets_spaced(spark, sf):
    return text_tables.word_onsets(_syntax(spark, sf)).select(story(), "word_pos", "word", "onset")


def _vectors(spark, sf, most=None):
    """Word vectors in one file by vec_id, or dealt by the hash of vec_id to files of about most vectors, as a file is written and numbered in one piece."""
    from pyspark.sql import Window

    df = load(spark, sf, "embeddings")
    files = -(-df.count() // most) if most else 1
    line = F.concat_ws(" ", F.concat(F.lit("w"), "vec_id"), F.concat_ws(" ", F.transform("embedding", lambda v: v.cast("string"))))
    rows = df.select(F.pmod(F.xxhash64("vec_id"), F.lit(max(1, files))).alias("story"), (F.col("vec_id") + 1).alias("line_no"), line.alias("line"))
    header = F.concat(F.count("*").over(Window.partitionBy("story")).cast("string"), F.lit(" 64"))
    return text_tables.whole_lines(spark, written(with_header(rows, header), "vectors"))


@query("SELECT 'w' || vec_id AS word, len(embedding) AS dims, embedding[1] AS first, embedding[64] AS last FROM embeddings")
def word_vectors_text(spark, sf):
    return text_tables.vectors(_vectors(spark, sf, 4096), None).select("word", F.size("vec").cast("long").alias("dims"), F.col("vec")[0].alias("first"), F.col("vec")[63].alias("last"))


@query("SELECT 'w' || vec_id AS word, embedding[1] AS first FROM embeddings ORDER BY vec_id LIMIT 200")
def word_vectors_limit(spark, sf):
    return text_tables.vectors(_vectors(spark, sf), 200).select("word", F.col("vec")[0].alias("first"))


@query("SELECT conv_id AS story, string_agg(text, chr(10) ORDER BY turn) || chr(10) AS text FROM conversations GROUP BY 1")
def transcript_text(spark, sf):
    rows = load(spark, sf, "conversations").select(F.col("conv_id").alias("story"), F.col("turn").alias("line_no"), F.col("text").alias("line"))
    return text_tables.transcripts(spark, written(rows, "transcripts")).select(story(), "text")


def _audio(spark, sf):
    df = events(spark, sf).select("recording", "t", ((F.col("x") - 50) / 128).alias("s"))
    return audio.encoded(df, "s", 100, "recording")


@query(f"WITH {EV} SELECT recording, 100 AS rate, t, greatest(least(round_even((x - 50) / 128 * 32768, 0), 32767), -32768) / 32768 AS s FROM ev")
def wav_samples(spark, sf):
    return audio.decoded(_audio(spark, sf)).select(F.col("path").cast("long").alias("recording"), "rate", "t", F.col("x")[0].alias("s"))


@query(f"WITH {EV} SELECT recording, (count(*) - 1) / 100.0::DOUBLE AS duration FROM ev GROUP BY 1")
def wav_durations(spark, sf):
    return audio.durations(_audio(spark, sf)).select(F.col("path").cast("long").alias("recording"), "duration")


@query(f"""WITH {EV}, d AS (SELECT recording, (count(*) - 1) / 100.0::DOUBLE AS duration FROM ev GROUP BY 1)
 SELECT recording, duration, CAST(round_even(recording * 0.03::DOUBLE * 50, 0) AS BIGINT) AS first, CAST(ceil(duration / 0.02::DOUBLE) AS BIGINT) AS samples FROM d""")
def aligned_speech(spark, sf):
    durations = audio.durations(_audio(spark, sf)).select(F.col("path").cast("long").alias("recording"), "duration")
    segments = events(spark, sf).select("recording").distinct().withColumn("onset", F.col("recording") * F.lit(0.03))
    return words.aligned_speech(segments, durations, 50.0, KEY).select("recording", "duration", "first", "samples")


@query(f"""WITH {_STORIES}, d AS (SELECT story, max(onset) + 0.5 AS duration FROM sw GROUP BY 1), g AS (SELECT story, unnest(range(0, CAST(ceil(duration * 8) AS BIGINT))) AS sample FROM d)
 SELECT g.story, g.sample, CASE WHEN w.word IS NULL THEN 0.0::DOUBLE ELSE 1.0 END AS word_onset, coalesce(CAST(w.p_size AS DOUBLE), 0.0) AS depth, coalesce(CAST(w.p_size % 5 AS DOUBLE), 0.0) AS open FROM g LEFT JOIN sw w ON w.story = g.story AND CAST(round_even(w.onset * 8, 0) AS BIGINT) = g.sample""")
def story_word_features(spark, sf):
    onsets, lines = _onsets(spark, sf), _syntax(spark, sf)
    tables = {c: text_tables.syntactic(lines, c).select(story(), "word_pos", c) for c in ("depth", "open")}
    durations = onsets.groupBy("story").agg((F.max("onset") + 0.5).alias("duration"))
    return words.story_features(onsets, tables, 8.0, durations, ["story"])


@query("SELECT c_custkey, upper(substr(c_name, 1, 3)) AS word, lower(substr(c_name, 1, 3)) AS small FROM customer")
def code_points(spark, sf):
    name = F.substring("c_name", 1, 3)
    df = load(spark, sf, "customer").select("c_custkey", name.alias("name"))
    points = F.transform(F.split(F.upper("name"), ""), lambda c: F.ascii(c))
    return df.select("c_custkey", text_tables.from_code_points(points).alias("word"), F.lower("name").alias("small"))


@query("SELECT p_partkey, p_size AS by_name, p_size AS by_place FROM part")
def feature_by_place(spark, sf):
    df = load(spark, sf, "part").select("p_partkey", "p_size", "p_retailprice")
    return df.select("p_partkey", text_tables.by_position(df, "p_size").alias("by_name"), text_tables.by_position(df, 1).alias("by_place"))


@query("SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 5")
def first_five(spark, sf):
    return load(spark, sf, "customer").select("c_custkey", "c_name").orderBy("c_custkey").limit(5)


@query(SQL.get("trf_segments"))
def model_saved_and_loaded(spark, sf):
    from ..operators.response import ResponseModel

    model, path = ResponseModel([-1, 0, 1], 10.0), scratch(spark, "model")
    models.save(model, model.fit(events(spark, sf), ["x"], ["y"], KEY, ORDER), path, 100.0)
    again, table, rate = models.load(spark, path)
    if (again.lags, again.alphas, again.intercept, rate) != (model.lags, model.alphas, model.intercept, 100.0):
        raise ValueError("the settings changed")
    return table.withColumns({"lag": F.coalesce("lag", F.lit(0)), "feature": F.coalesce("feature", F.lit("intercept")), "coef": rounded("coef")})
