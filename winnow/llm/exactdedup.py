"""Exact deduplication against a persistent digest index.

The index is a table bucketed and sorted by digest: one row per distinct normalized
text with the row that stands for it.  A new batch is reduced to one row per digest
(partial aggregation, so a hot text costs one row per task), compared with the index
by a sort-merge anti-join, and the unknown digests are appended.  The index side needs
neither a shuffle nor a sort of its own.

Appending is idempotent: a digest already in the index is never appended again, so a
job that died and runs once more gives the same index.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from winnow.llm.common import cut, partitions, ready
from winnow.session import scratch_path

# Digests with at least 1/HOT_SHARE of all rows: fewer than HOT_SHARE + 1, so always broadcastable.
HOT_SHARE = 500

_WHITE = " \t\n\x0b\x0c\r"


def normalized(text):
    """The text without ``[\\x20\\x09-\\x0D]``; null as empty."""
    return F.translate(F.coalesce(text, F.lit("")), _WHITE, "")


class DigestIndex:
    """A persistent index ``(digest, keep_id, chars, copies)`` at ``path``.

    ``table`` names it in the session catalog, which keeps its bucketing.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None,
                 id_type: str = "bigint", table: str | None = None):
        self.spark, self.path = spark, path
        self.buckets = buckets or partitions(spark)
        self.table = table or f"digests_{uuid.uuid4().hex[:12]}"
        if not spark.catalog.tableExists(self.table):
            spark.sql(
                f"CREATE TABLE {self.table} (digest STRING, keep_id {id_type}, chars BIGINT, copies BIGINT) "
                f"USING PARQUET CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS "
                f"LOCATION '{path}'")

    def read(self) -> DataFrame:
        return self.spark.table(self.table)

    def append(self, winners: DataFrame) -> None:
        """Append the rows of ``winners(digest, keep_id, chars, copies)`` with an unknown digest."""
        new = winners.hint("merge").join(self.read().select("digest"), "digest", "left_anti")
        # the bucketed writer's own partitioning: one file per bucket
        (new.select("digest", "keep_id", "chars", "copies").repartition(self.buckets, "digest")
         .write.mode("append").format("parquet").bucketBy(self.buckets, "digest").sortBy("digest")
         .option("path", self.path).saveAsTable(self.table))


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, digest, chars)`` per row: SHA-256 of the normalized text, code points of the text."""
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).alias("id"), F.sha2(normalized(text), 256).alias("digest"),
                       F.coalesce(F.char_length(text), F.lit(0)).cast("long").alias("chars"))


def winners(rows: DataFrame) -> DataFrame:
    """Per digest the row with the most code points, then the smallest id (null ids last)."""
    best = F.min(F.struct((-F.col("chars")).alias("neg"), F.col("id").isNull().alias("anon"), F.col("id")))
    return (rows.groupBy("digest").agg(best.alias("w"), F.count(F.lit(1)).alias("copies"))
            .select("digest", F.col("w.id").alias("keep_id"), (-F.col("w.neg")).alias("chars"), "copies"))


def dedup(docs: DataFrame, index: DigestIndex, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Add ``docs`` to the index; one row per document.

    Returns ``id_col``, ``keep_id`` (the row that stays), ``group_size`` (equal rows of
    this batch), ``kept`` and ``text_sha256``.  A text already in the index keeps the row
    it had.  A null text equals the empty one and any text of white space only.  Repeated
    rows with the id that stays are all marked kept: they can't be told apart.  A null id
    stands for its text only if all of its group's ids are null.  An empty batch returns
    and appends nothing.  Other columns are ignored.
    """
    rows = cut(digests(docs, id_col, text_col), "digests")
    won = cut(winners(rows), "winners")
    index.append(won)
    stays = index.read().select("digest", "keep_id")
    total = rows.count()
    hot = won.where(F.col("copies") * HOT_SHARE >= F.lit(max(total, HOT_SHARE * 2))).select("digest", "copies")
    hot = cut(hot.join(stays, "digest"), "hot")          # fewer than HOT_SHARE + 1 rows
    known = won.select("digest", "copies").join(stays, "digest")
    usual = rows.join(F.broadcast(hot.select("digest")), "digest", "left_anti").join(known, "digest")
    often = rows.join(F.broadcast(hot), "digest")
    out = usual.select("id", "digest", "copies", "keep_id").unionByName(
        often.select("id", "digest", "copies", "keep_id"))
    return out.select(F.col("id").alias(id_col), "keep_id", F.col("copies").alias("group_size"),
                      F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
                      F.col("digest").alias("text_sha256"))


def dedup_once(docs: DataFrame, **columns) -> DataFrame:
    """``dedup`` into a fresh index under the shared checkpoint folder."""
    spark = docs.sparkSession
    ready(spark)
    id_type = docs.schema[columns.get("id_col", "doc_id")].dataType.simpleString()
    return dedup(docs, DigestIndex(spark, scratch_path(spark, "digest-index"), id_type=id_type), **columns)
