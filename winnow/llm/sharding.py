"""Sharding along a Hilbert curve.

Several metadata dimensions are quantized, every row gets the index of its cell on a
Hilbert curve, rows are sorted by that index and the order is cut into runs.  A run is a
compact region in all dimensions, so the per-shard minima and maxima prune on each.

The order is a range-partitioned sort of a few bytes per row (Spark samples the bounds,
so a hot cell is spread over tasks: ties are ordered by id and size), and ranks come from
per-partition counts.  Runs hold equal numbers of rows, at most one apart.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from winnow.llm.common import cut, fresh, partitions, ready

# Bits per dimension of the curve.
BITS = 10


def hilbert_index(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Index on the Hilbert curve of ``cells`` (n x d integers below 2**bits; d * bits <= 62).

    Gray-code construction on the transposed coordinates (Skilling 2004), vectorized.
    """
    x = np.ascontiguousarray(cells, dtype=np.int64).T.copy()
    d = len(x)
    if d * bits > 62:
        raise ValueError("index needs more than 62 bits")
    for b in range(bits - 1, 0, -1):
        q = np.int64(1) << b
        low = q - 1
        for i in range(d):
            on = (x[i] & q) != 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(on, low, swap)
            x[i] ^= swap
    for i in range(1, d):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        q = np.int64(1) << b
        flip ^= np.where((x[d - 1] & q) != 0, q - 1, 0)
    x ^= flip
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            out = (out << 1) | ((x[i] >> b) & 1)
    return out


def scaled(column, top: float, bits: int = BITS):
    """Quantize a nonnegative number on a log scale up to ``top`` (null: cell 0)."""
    cells = (1 << bits) - 1
    v = F.log2(F.greatest(column.cast("double"), F.lit(0.0)) + 1.0) / F.log2(F.lit(top) + 1.0) * cells
    return F.least(F.lit(cells), F.coalesce(F.floor(v), F.lit(0))).cast("long")


def category(column, bits: int = BITS):
    """Quantize a category by the first bits of its md5 (null: cell 0)."""
    h = F.conv(F.substring(F.md5(column.cast("string")), 1, 8), 16, 10).cast("long")
    return F.coalesce(F.shiftright(h, 32 - bits), F.lit(0)).cast("long")


def curve_index(*cells, bits: int = BITS):
    """Column: Hilbert index of the given cell columns (an Arrow batch at a time)."""
    @F.pandas_udf("long")
    def index(*parts: pd.Series) -> pd.Series:
        return pd.Series(hilbert_index(np.stack([p.to_numpy(np.int64) for p in parts], axis=1), bits))
    return index(*cells)


def ranked(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """``rows`` (written) with their 0-based rank in ``order`` as ``name``."""
    n = partitions(rows.sparkSession)
    s = (rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
         .withColumn("_at", F.monotonically_increasing_id()))
    s = cut(s, "order")
    # columns of the written table, so both branches below read the same positions
    s = s.withColumn("_part", F.shiftright("_at", 33)).withColumn("_pos", F.col("_at").bitwiseAND((1 << 33) - 1))
    # one row per partition of the sort
    base = s.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = base.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    return (s.join(F.broadcast(base), "_part")
            .withColumn(name, F.col("_off") + F.col("_pos")).drop("_at", "_part", "_pos", "_off"))


def _placed(docs: DataFrame, shards: int, id_col: str, text_col: str, dims: dict | None, kept: dict) -> DataFrame:
    """The ``kept`` columns (name -> column) of every row with size, text_crc32, curve, shard and slot.

    Rows travel once, in curve order; what is written is sorted by (shard, slot).
    """
    ready(docs.sparkSession)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    if dims is None:
        dims = {c: category(F.col(c)) for c in ("source", "lang") if c in docs.columns}
        dims["bytes"] = scaled(F.octet_length(text), float(1 << 26))
    names = [f"_d{k}" for k in range(len(dims))]
    rows = docs.select(F.col(id_col).alias("id"), (F.octet_length(text) + 16).cast("long").alias("size"),
                       F.crc32(text).alias("text_crc32"), *[c.alias(n) for n, c in zip(names, dims.values())],
                       *[c.alias(n) for n, c in kept.items()])
    rows = rows.withColumn("curve", curve_index(*names)).drop(*names)
    r = ranked(rows, ["curve", "size", "text_crc32", "id"], "rank")
    total = F.broadcast(r.agg(F.count(F.lit(1)).alias("total")))
    r = r.crossJoin(total)                          # one row
    # floor(rank * shards / total) puts the rows of shard s at ceil(s * total / shards) onwards
    r = r.withColumn("shard", F.expr(f"cast(rank * {shards} div total as int)"))
    first = F.expr(f"(shard * total + {shards - 1}) div {shards}")
    return r.withColumn("slot", F.col("rank") - first)


def shard(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text",
          dims: dict | None = None) -> DataFrame:
    """Shard and slot of every row, from its metadata alone.

    Returns ``id_col, size, text_crc32, shard, slot, curve``: size is the UTF-8 bytes of
    the text plus 16 (null text: 16 and crc32 of the empty text), ``shard`` in
    0..shards-1 with row counts at most one apart, ``slot`` gapless from 0 within a shard.

    ``dims`` maps names to quantized columns; by default source, lang and size, as far as
    ``docs`` has them.  Null dimensions lie in cell 0.  Equal cells are ordered by size,
    crc32 and id (nulls first), so equal texts of one cell are neighbours; rows equal in
    all of these are interchangeable.  An empty table gives an empty result.
    """
    r = _placed(docs, shards, id_col, text_col, dims, {})
    return r.select(F.col("id").alias(id_col), "size", "text_crc32", "shard", "slot", "curve")


def sharded(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``shard`` and ``slot`` (names made unique if taken).

    The rows are written once, in curve order: each file holds a stretch of (shard, slot), so a
    reader's file statistics prune on every dimension.  Reading small files, Spark may put
    several stretches into one partition.
    """
    safe = {f"c{k}": docs[c] for k, c in enumerate(docs.columns)}
    r = _placed(docs, shards, id_col, text_col, None, safe)
    a, b = fresh("shard", docs.columns), fresh("slot", docs.columns)
    return r.select(*[F.col(k).alias(c) for k, c in zip(safe, docs.columns)], F.col("shard").alias(a), F.col("slot").alias(b))


def bounds(sharded_docs: DataFrame, columns: list[str], shard_col: str = "shard") -> DataFrame:
    """Rows, minima and maxima per shard: the statistics a reader prunes shards by."""
    aggs = [F.count(F.lit(1)).alias("rows")]
    for c in columns:
        aggs += [F.min(c).alias(f"min_{c}"), F.max(c).alias(f"max_{c}")]
    return sharded_docs.groupBy(shard_col).agg(*aggs)


def prune(stats: DataFrame, ranges: dict, shard_col: str = "shard") -> DataFrame:
    """Shards whose bounds meet every ``column: (low, high)`` range (inclusive)."""
    for c, (low, high) in ranges.items():
        stats = stats.where((F.col(f"max_{c}") >= F.lit(low)) & (F.col(f"min_{c}") <= F.lit(high)))
    return stats.select(shard_col)
