"""Connected components by alternating large-star and small-star steps.

All steps are DataFrame joins and aggregations over edges; no edge or label reaches
the driver.  A node with very many edges is a skewed join key, which adaptive
execution splits; the other side has one row per node.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winnow.llm.common import cut

MAX_ROUNDS = 100


def _print(edges: DataFrame):
    r = edges.agg(F.count(F.lit(1)).alias("n"),
                  F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 31))).alias("h")).first()
    return r["n"], r["h"]


def components(edges: DataFrame) -> DataFrame:
    """``edges(a, b)`` of one orderable type -> ``(node, comp)``: comp is the smallest node.

    Loops and repeated edges are harmless, null ends are ignored, and no edges give an
    empty table.  Nodes without edges do not appear.
    """
    e = cut(edges.select("a", "b").where("a <> b").distinct(), "cc")
    seen = _print(e)
    for _ in range(MAX_ROUNDS):
        if not seen[0]:
            break
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = (both.where("b > a").join(low, "a")
                 .select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct())
        low = large.groupBy("a").agg(F.min("b").alias("m"))      # here b < a
        small = (large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .unionByName(low.select("a", F.col("m").alias("b"))).distinct())
        e = cut(small, "cc")
        now = _print(e)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    return (e.groupBy("a").agg(F.min("b").alias("comp")).withColumnRenamed("a", "node")
            .unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("comp")).distinct()))
