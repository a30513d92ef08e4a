"""The corpus pipeline: language ID, near duplicates, decontamination, mixing, sharding.

Every stage takes (spark, docs, sf_dir) and works on all rows the stage before it kept.  Stages that filter keep rows as
they are.  No stage of this chain but the last two could be told in SQL, so there is no SQL for run(); the tests hold the
stages against brute-force versions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peakfold.llm import decontaminate, jaccard, langid, mixing, sharding
from peakfold.llm.common import Scratch


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without letters, texts of which no language has three tenths of the letters, and texts whose words are too
    unlikely in every learned language: other languages, other scripts, codes and noise."""
    return langid.keep_identified(docs, langid.fit(docs, F.lit(True), most=4000, normal=True), least=0.3)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each component of five-word shingle sets with a similarity of 0.8 or more."""
    return jaccard.keep_one(docs, words=5, percent=80)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold half of the words of a benchmark item in tiles of five words or more."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), seed=5, threshold=0.5)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixes the sources by weights 3, 1, 2 to one and a half times the words; texts hold the words that are taken."""
    return mixing.mix_documents(docs, weights=(3, 1, 2), share=1.5, most=2.0, block_words=64)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds shard (0 to 39) and slot; row counts of shards are at most one apart."""
    return sharding.shard_corpus(docs, shards=40)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", benchmark_decontamination),
    ("mixing", mix_sources),
    ("sharding", shard),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return docs
