"""Corpus pipeline: toxic documents out, one of each near-duplicate group, benchmark passages
out, sources mixed to target weights, the mix sharded along a Hilbert curve.

Every stage takes (spark, docs, sf_dir), works on all rows it is given and returns a
DataFrame, which ``run`` writes as Parquet and reads again as the next stage's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from winnow.llm import decontaminate, mixing, ngramjoin, sharding, toxicity
from winnow.llm.common import cut
from winnow.session import table_path

SHARDS = 40


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score below the threshold; the model learns from ``labels``."""
    return toxicity.without_toxic(docs, spark.read.parquet(table_path(sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document (smallest id) of each component of near copies."""
    return ngramjoin.keep_one(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages cut out of the texts; documents that are mostly such passages go.

    Items of fewer than 10 words (the window) are cut nowhere; a document goes if one run of
    their words covers more than half of it.
    """
    return decontaminate.decontaminate(docs, spark.read.parquet(table_path(sf_dir, "benchmark")), spare_short=True)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    return mixing.mixed(docs)


def hilbert_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix with its shard and slot."""
    return sharding.sharded(docs, SHARDS)


STAGES = [
    ("toxicity", toxicity_filter),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark_decontamination),
    ("mixing sources", source_mix),
    ("sharding", hilbert_shards),
]

# The first stage scores with a fitted classifier, which SQL doesn't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(table_path(sf_dir, "documents"))
    for k, (_, stage) in enumerate(STAGES):
        docs = cut(stage(spark, docs, sf_dir), f"stage-{k}")
    return docs
