"""Sampling, mixing and splitting.

Every random draw is "order by md5(seed:salt:id), take k": exact size,
reproducible, independent of partitioning and of the engine.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winnow.functions.hashing import draw_key
from winnow.operators.budget import ID, chosen_k
from winnow.operators.ranking import (BROADCAST_ROWS, maybe_broadcast, rank_rows, take_top,
                                      take_top_per_group)


def _draw_order(key: str = "_draw", id_col: str = ID) -> list:
    return [F.asc(key), F.asc(id_col)]


def _with_draw(df: DataFrame, seed, salt: str, id_col: str = ID) -> DataFrame:
    return df.withColumn("_draw", draw_key(seed, salt, id_col))


def draw_k(df: DataFrame, k: int, seed, salt: str, id_col: str = ID) -> DataFrame:
    """Exactly ``k`` rows, the smallest md5 draws (ties to the lower id)."""
    return take_top(_with_draw(df, seed, salt, id_col), k, _draw_order("_draw", id_col)).drop("_draw")


def subsample_fraction(df: DataFrame, pct: float, seed=3, id_col: str = ID,
                       n: int | None = None, salt: str = "subsample") -> DataFrame:
    """Pct < 1 keeps exactly round-half-even(n*pct) rows; otherwise all rows."""
    if pct >= 1.0:
        return df
    if n is None:
        n = df.count()
    k = int(round(n * pct))
    if k >= n:
        return df
    return draw_k(df, k, seed, salt, id_col)


def _group_sizes(df: DataFrame, group_col: str, pct: float) -> DataFrame:
    sizes = df.groupBy(group_col).agg(F.count(F.lit(1)).alias("available"))
    keep = F.bround(F.col("available").cast("double") * F.lit(float(pct)), 0).cast("long")
    return sizes.withColumn("kept", F.when(F.lit(pct < 1.0), F.least(keep, F.col("available")))
                                     .otherwise(F.col("available")))


def mix_sources(df: DataFrame, pct: float, seed=3, source_col: str = "dataset",
                id_col: str = ID, salt: str = "subsample") -> DataFrame:
    """Subsample every source by ``pct`` (C1 per source), tag, union.

    The union's shuffle order is the ``shuffle_key`` column (md5 draw), so no
    global sort is forced; order by it when a sequence is needed.
    """
    sizes = _group_sizes(df, source_col, pct)
    stats = sizes.agg(F.count(F.lit(1)).alias("g"), F.max("available").alias("m")).first()
    rows = df.join(maybe_broadcast(sizes.select(source_col, "kept"), stats["g"]), source_col)
    rows = _with_draw(rows, seed, salt, id_col)
    kept = take_top_per_group(rows, [source_col], "kept", _draw_order("_draw", id_col),
                              max_group=stats["m"])
    return (kept.drop("kept", "_draw")
                .withColumn("shuffle_key", draw_key(seed, "shuffle", source_col, id_col)))


def mixture_stats(all_rows: DataFrame, kept: DataFrame, source_col: str = "dataset") -> DataFrame:
    """``(dataset, available, kept)`` per source."""
    a = all_rows.groupBy(source_col).agg(F.count(F.lit(1)).alias("available"))
    k = kept.groupBy(source_col).agg(F.count(F.lit(1)).alias("kept"))
    return (a.join(k, source_col, "left")
             .select(source_col, "available", F.coalesce("kept", F.lit(0)).cast("long").alias("kept")))


def train_val_split(df: DataFrame, frac: float = 0.05, seed=42, id_col: str = ID,
                    n: int | None = None) -> DataFrame:
    """C4: add ``split`` ('train'/'validation'); validation = ceil(n*frac) smallest draws."""
    if not frac or frac <= 0:
        return df.withColumn("split", F.lit("train"))
    if n is None:
        n = df.count()
    k = min(n, int(math.ceil(n * frac)))
    val_ids = draw_k(df.select(id_col), k, seed, "split", id_col).withColumn("_val", F.lit(True))
    return (df.join(maybe_broadcast(val_ids, k, BROADCAST_ROWS), id_col, "left")
              .withColumn("split", F.when(F.col("_val"), F.lit("validation")).otherwise(F.lit("train")))
              .drop("_val"))


def select_random(ex: DataFrame, budget: float = 0.05, seed=42, id_col: str = ID,
                  n: int | None = None) -> DataFrame:
    """K (from the budget) uniform draws without replacement."""
    return draw_k(ex.select(id_col), chosen_k(ex, budget, n), seed, "random", id_col)


def warmup_subset(ex: DataFrame, frac: float, seed=42, rounding: str = "even",
                  id_col: str = ID, n: int | None = None) -> DataFrame:
    """A random warm-up fraction (IFD rounds half-even, LESS truncates)."""
    k = chosen_k(ex, min(float(frac), 1.0), n, rounding)
    return draw_k(ex.select(id_col), k, seed, "warmup", id_col)


def cluster_round_robin(labels: DataFrame, sub_n: int, seed=42, id_col: str = ID,
                        label_col: str = "label") -> DataFrame:
    """Shuffle inside each cluster, then one per cluster in turn until ``sub_n``."""
    sizes = labels.groupBy(label_col).agg(F.count(F.lit(1)).alias("_n"))
    st = sizes.agg(F.max("_n").alias("m")).first()
    ranked = rank_rows(_with_draw(labels.select(id_col, label_col), seed, "cluster", id_col),
                       _draw_order("_draw", id_col), [label_col], name="_round",
                       max_group=st["m"])
    picked = take_top(ranked, sub_n, [F.asc("_round"), F.asc(label_col)])
    return picked.select(id_col, label_col)


def query_sample(ex: DataFrame, max_queries: int = 256, seed=42, id_col: str = ID) -> DataFrame:
    """min(max_queries, n) rows as pseudo-queries."""
    return draw_k(ex.select(id_col), max_queries, seed, "queries", id_col)
