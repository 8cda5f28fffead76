"""Files written from tables whose shuffles Spark packs into several tasks."""

import duckdb
import pytest

from wavelake.plans import queries as plans

SF = "/root/testdata/sf0.01"


@pytest.fixture
def many_tasks(spark):
    """A list of stories fits in one task, their words don't: as with tables of 64 MB and more."""
    sizes = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "2k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1k"}
    for k, v in sizes.items():
        spark.conf.set(k, v)
    yield spark
    for k in sizes:
        spark.conf.unset(k)


@pytest.mark.parametrize("name", ["close_values", "depth_values", "story_word_features", "word_onsets_spaced", "open_values", "word_onsets_csv"])
def test_header_stays_with_its_words(many_tasks, name):
    mine = plans.queries()[name](many_tasks, SF)
    c = duckdb.connect()
    c.execute(f"CREATE VIEW part AS SELECT * FROM '{SF}/part.parquet'")
    want = c.execute(f"SELECT {', '.join(mine.columns)} FROM ({plans.oracle_sql()[name]})").fetchall()
    assert sorted(map(tuple, mine.collect())) == sorted(want)


def test_more_vectors_than_a_model_keeps(spark, tmp_path):
    n = 30_500
    spark.range(n).selectExpr("id * 3 + 7 AS vec_id", "transform(sequence(1, 64), i -> CAST(sin(id * 64 + i) AS FLOAT)) AS embedding").write.parquet(str(tmp_path / "embeddings.parquet"))
    mine = plans.queries()["word_vectors_text"](spark, str(tmp_path))
    c = duckdb.connect()
    c.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = c.execute(f"SELECT {', '.join(mine.columns)} FROM ({plans.oracle_sql()['word_vectors_text']})").fetchall()
    got = sorted(map(tuple, mine.collect()))
    assert len(got) == n and got == sorted(want)
