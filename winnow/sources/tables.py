"""Views of the driver's tables in the shapes the operators take.

* examples: ``documents`` -> ``(example_id, text, lang, source)``
* target set: ``benchmark`` -> ``(item_id, text)``
* chat turns: ``conversations`` (long form)
* vectors: ``embeddings`` -> ``(example_id, vec, label)``
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from winnow.session import read_table


def examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read_table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("example_id"), "text", "lang", "source")


def target(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "benchmark").select("item_id", "text")


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "conversations")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("example_id"), F.col("embedding").alias("vec"), "label")
