"""Exact ranking and top-k without funnelling rows into one task.

* Small k: ``orderBy(...).limit(k)`` (TakeOrderedAndProject: each task keeps k).
* Large k, or per-group ranks over groups that may be huge: a range-partitioned
  sort (Spark samples the bounds, so one hot key is split over many tasks),
  a position per row from ``monotonically_increasing_id`` (partition id in the
  high bits, position in the low bits), written to the shared checkpoint
  folder so every reader sees the same positions, then per-partition offsets
  from a table with one row per (partition, group).
* Per-group ranks whose largest group is proven small use a plain window.
* Top-k by score with large k (:func:`top_by_threshold`): mergeable quantile summaries bound
  the k-th score, exact counts confirm the bounds, and only the rows between them are sorted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from winnow.session import ensure_checkpoint_dir

# Largest k served by TakeOrderedAndProject (each task ships k rows to one).
LIMIT_K = 1000
# Largest group a single task may sort inside a window.
WINDOW_MAX_GROUP = 1_000_000
# Largest table we broadcast by row count (small fixed-width rows).
BROADCAST_ROWS = 2_000_000

_POS_BITS = 33


# Salt buckets for joins whose small side is too big to broadcast.
JOIN_SALTS = 32


def maybe_broadcast(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast ``df`` only when its counted size is under the bound."""
    return F.broadcast(df) if rows <= limit else df


# Estimated bytes per broadcast hash-relation row beyond its string bytes.
ROW_OVERHEAD_BYTES = 64


def broadcast_budget_bytes(spark) -> int:
    """Bytes one broadcast may take: 1/32 of the smaller of the driver heap (where the
    relation is built) and the executor memory (where every task holds it)."""
    jvm = spark.sparkContext._jvm
    driver = int(jvm.java.lang.Runtime.getRuntime().maxMemory())
    conf = spark.sparkContext.getConf().get("spark.executor.memory", None)
    executor = int(jvm.org.apache.spark.util.Utils.byteStringAsBytes(conf)) if conf else driver
    return min(driver, executor) // 32


def _bytes(df: DataFrame, rows: int) -> int:
    """Measured size of a hash relation of ``df``: its strings and vectors, and a fixed overhead per row."""
    held = [F.coalesce(F.octet_length(c), F.lit(0)) if t == "string" else F.greatest(F.size(c), F.lit(0)) * 8
            for c, t in df.dtypes if t in ("string", "array<double>")]
    if not held:
        return rows * ROW_OVERHEAD_BYTES
    total = df.agg(F.sum(sum(held, F.lit(0))).alias("b")).first()["b"]
    return int(total or 0) + rows * ROW_OVERHEAD_BYTES


def join_small(big: DataFrame, small: DataFrame, on, small_rows: int, how: str = "inner",
               salts: int = JOIN_SALTS) -> DataFrame:
    """Join a large table with a keyed lookup table.

    Within the bounds of rows and bytes (strings measured) the lookup table is broadcast (no
    shuffle of ``big``).  Above them, ``big`` is salted by a hash of its own row and the lookup rows are
    replicated per salt, so one key holding a large share of ``big`` (a hot
    term) is spread over ``salts`` tasks instead of one.  That join is a hinted sort-merge: the optimizer rates the
    copies by the compressed file of one copy, and would collect all of them on the driver for a broadcast.
    """
    on = [on] if isinstance(on, str) else list(on)
    if small_rows <= BROADCAST_ROWS and _bytes(small, small_rows) <= broadcast_budget_bytes(small.sparkSession):
        return big.join(F.broadcast(small), on, how)
    salted = big.withColumn("_salt", F.pmod(F.xxhash64(*[F.col(c) for c in big.columns]), F.lit(salts)))
    copies = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<long>")))
    return salted.join(copies.hint("merge"), on + ["_salt"], how).drop("_salt")


def _partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def rank_rows(df: DataFrame, order_cols: list, group_cols: list | None = None,
              name: str = "rank", max_group: int | None = None) -> DataFrame:
    """Add a 1-based rank under ``order_cols`` (a total order), per group if given."""
    group_cols = list(group_cols or [])
    if max_group is not None and max_group <= WINDOW_MAX_GROUP and group_cols:
        w = Window.partitionBy(*group_cols).orderBy(*order_cols)
        return df.withColumn(name, F.row_number().over(w).cast("long"))

    ensure_checkpoint_dir(df.sparkSession)
    keys = [F.col(g) for g in group_cols] + list(order_cols)
    n_parts = _partitions(df)
    s = (df.repartitionByRange(n_parts, *keys)
         .sortWithinPartitions(*keys)
         .withColumn("_mid", F.monotonically_increasing_id())
         .checkpoint(eager=True))
    s = (s.withColumn("_pid", F.shiftright(F.col("_mid"), _POS_BITS))
          .withColumn("_pos", F.col("_mid").bitwiseAND(F.lit((1 << _POS_BITS) - 1))))
    stats = s.groupBy("_pid", *group_cols).agg(F.count(F.lit(1)).alias("_cnt"),
                                               F.min("_pos").alias("_p0"))
    # Offsets: rows of the same group in earlier partitions.  One row per
    # (partition, group) pair, so this window sorts a small table.
    w = Window.partitionBy(*group_cols).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    stats = stats.withColumn("_off", F.coalesce(F.sum("_cnt").over(w), F.lit(0)).cast("long"))
    n_stats = stats.count()
    out = s.join(maybe_broadcast(stats.select("_pid", *group_cols, "_off", "_p0"), n_stats),
                 ["_pid", *group_cols])
    return (out.withColumn(name, (F.col("_off") + F.col("_pos") - F.col("_p0") + 1).cast("long"))
               .drop("_mid", "_pid", "_pos", "_off", "_p0"))


def take_top(df: DataFrame, k: int, order_cols: list) -> DataFrame:
    """Exactly the first ``k`` rows under ``order_cols`` (a total order)."""
    if k <= 0:
        return df.limit(0)
    if k <= LIMIT_K:
        return df.orderBy(*order_cols).limit(k)
    return rank_rows(df, order_cols, name="_rk").filter(F.col("_rk") <= k).drop("_rk")


# Rows between the bounds of a threshold that are sorted; more are narrowed further.
BAND_ROWS = 1_000_000
# Relative rank error of a quantile summary is 1 / SUMMARY.
SUMMARY = 2_000


def _narrowed(band: DataFrame, col: str, k: int, rows: int):
    """Bounds for the k-th smallest ``col`` of ``band``: (low, high, below, within).

    ``below`` rows are smaller than ``low``, ``within`` rows lie in [low, high], and
    below < k <= below + within: counted, not estimated.  The bounds come from a quantile
    summary, which merges per task.
    """
    slack = 2.0 / SUMMARY
    while True:
        p = [max(0.0, k / rows - slack), min(1.0, k / rows + slack)]
        low, high = band.agg(F.percentile_approx(col, p, SUMMARY).alias("q")).first()["q"]
        if p[0] == 0.0 or p[1] == 1.0:
            least, most = band.agg(F.min(col), F.max(col)).first()
            low, high = (least if p[0] == 0.0 else low), (most if p[1] == 1.0 else high)
        c = F.col(col)
        below, upto = band.agg(F.count_if(c < F.lit(low)), F.count_if(c <= F.lit(high))).first()
        if below < k <= upto:
            return low, high, below, upto - below
        slack *= 4


def top_by_threshold(df: DataFrame, k: int, score_col: str, id_col: str, band_rows: int | None = None) -> DataFrame:
    """The ``k`` rows of ``df`` with the highest score; ties go to the lower id, NULL scores rank last.

    ``df`` is read several times (a written table); scores are finite doubles, ids are unique.
    The table is scanned and filtered, never exchanged as a whole: rows beyond the bounds of
    the k-th key are taken or left by comparison, only those between are sorted.  If a tied
    score (or NULL) fills the band, the ids of the tie are narrowed likewise; ids that are not
    integers are sorted within their tie.
    """
    limit = BAND_ROWS if band_rows is None else band_rows
    if k <= 0:
        return df.limit(0)
    key = F.col(score_col)
    valid = df.agg(F.count(key), F.count(F.lit(1))).first()
    if k >= valid[1]:
        return df
    taken = []
    if k <= valid[0]:
        band, left, rows = df.where(key.isNotNull()), k, valid[0]
        low = None
        while rows > limit:
            asc = band.withColumn("_neg", -key)
            bounds = _narrowed(asc, "_neg", left, rows)
            high, low = -bounds[0], -bounds[1]
            taken.append(band.where(key > F.lit(high)))
            band, left = band.where(key.between(F.lit(low), F.lit(high))), left - bounds[2]
            if bounds[3] == rows or low == high:
                rows = bounds[3]
                break
            rows = bounds[3]
        tied = rows > limit and low is not None and band.where(key != F.lit(low)).limit(1).count() == 0
    else:
        taken.append(df.where(key.isNotNull()))
        band, left, rows, tied = df.where(key.isNull()), k - valid[0], valid[1] - valid[0], True
    if tied and isinstance(df.schema[id_col].dataType, IntegralType):
        while rows > limit:
            low, high, below, within = _narrowed(band, id_col, left, rows)
            taken.append(band.where(F.col(id_col) < F.lit(low)))
            band, left = band.where(F.col(id_col).between(F.lit(low), F.lit(high))), left - below
            if within == rows:
                break
            rows = within
    out = take_top(band, left, [F.desc_nulls_last(score_col), F.asc(id_col)])
    for t in taken:
        out = out.unionByName(t)
    return out


def take_top_per_group(df: DataFrame, group_cols: list, k_col: str, order_cols: list,
                       max_group: int | None = None) -> DataFrame:
    """Per group, the first ``k_col`` rows under ``order_cols``."""
    r = rank_rows(df, order_cols, group_cols, name="_rk", max_group=max_group)
    return r.filter(F.col("_rk") <= F.col(k_col)).drop("_rk")
