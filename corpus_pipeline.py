"""A corpus pipeline of five stages, each one operator of wavelake.llm.

Each stage takes (spark, docs, sf_dir) and returns what it keeps, with the columns of documents; the last returns shards. The classifier is fitted on the
labelled rows of the table itself, outside the held-out third. Empty tables give empty tables; null texts count as empty; rows without an id, or that share
one, are each judged by their own text, and of a group of near copies the row without an id goes last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavelake.llm import decontaminate, jaccard_join, line_quality, mixing, sharding
from wavelake.llm.common import saved


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line classifier doesn't reject."""
    model = line_quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return line_quality.keep_good(docs, model)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, the one with the smallest id, of each group of near copies."""
    return jaccard_join.keep_one(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    quality = labels.select("doc_id", F.when(F.col("quality") == 1, 1.5).when(F.col("quality") == 0, 0.5).otherwise(1.0).alias("weight"))
    return mixing.take(docs, quality=quality)


def hash_tree_sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row's shard."""
    return sharding.shard_documents(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("benchmark_decontamination", benchmark_decontamination),
    ("source_mixing", source_mixing),
    ("hash_tree_sharding", hash_tree_sharding),
]

#: A fitted classifier isn't SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's result is written and read again, so a lost executor costs one stage at most."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = saved(docs, name)
    return docs
