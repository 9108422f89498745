"""A corpus pipeline of five stages: quality, near duplicates, benchmark passages, mixture, shards.

Each stage sees all that the one before kept. Null and empty texts, rows without an id, repeated rows, very long texts and ties
are dealt with as the stage's operator says: a null text is scored as an empty one, has no near copies and no passages, is
taken no words from and gets a shard. Empty tables pass through as empty tables. Extra columns stay up to the mixture; the
shards have columns of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pairlace.llm.common import stored
from pairlace.llm.decontaminate import drop_contaminated
from pairlace.llm.mixing import mix_documents
from pairlace.llm.near_dedup import keep_one
from pairlace.llm.quality_classifier import keep_good
from pairlace.llm.sharding import assign_shards


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as the mixture takes them, a row for each copy."""
    return mix_documents(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A shard and a slot for each row."""
    return assign_shards(docs).drop("grp")


STAGES = [("quality classifier", quality), ("near duplicates", near_dedup), ("decontamination", decontaminate), ("mixture", mix), ("shards", shard)]
#: Trained and randomised stages have no SQL form; the tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
