"""Selection policies beyond top-k.

* k-center diversity (D8) is sequential by nature, so it runs as a composable
  coreset: blocks of bounded size each pick k rows by greedy farthest-point
  (``applyInPandas``), the picks of a few blocks make a block of the next level, and
  the last block picks the k.  Each level adds at most twice the optimal radius.  A k
  that is a share of the table, too large for one block, is picked from whole
  farthest-point orders of near rows (cells around k-center pivots) by the distance
  at which each row entered.  The greedy starts at the best-scoring row; ties go to
  the lower id.
* GREATS (D9) picks per training batch, a group whose size is the batch size,
  so the batch Gram matrix fits one task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from winnow.functions.hashing import draw_key
from winnow.functions.vector import to_double
from winnow.operators.budget import ID, chosen_k, policy_hard, topk_by_score
from winnow.operators.ranking import rank_rows, take_top
from winnow.operators.reweight import sigmoid_gate
from winnow.session import materialize

# Rows of one greedy block (one task's work is block_rows x its picks).
BLOCK_ROWS = 4096
# Most picks of the merging coreset: the last block holds twice as many rows.
MERGE_K = 8_192
# Most pivots of the cells (a broadcast of so many vectors).
MAX_PIVOTS = 1024


def farthest_order(ids: np.ndarray, vecs: np.ndarray, scores: np.ndarray, k: int,
                   floor: float = 0.0) -> tuple[list[int], list[float]]:
    """Positions picked by the farthest-point greedy and the distance at which each entered (the first:
    infinite): start at the best score (lowest id on ties), then repeatedly add the row farthest from the
    chosen set (lowest id on ties), k rows at most and none that is nearer than ``floor``."""
    n = len(ids)
    if n == 0 or k <= 0:
        return [], []
    byid = np.argsort(ids, kind="stable")
    vecs = vecs[byid]
    scores = -np.nan_to_num(np.asarray(scores, dtype=np.float64)[byid], nan=-np.inf)
    cand = int(np.argmin(scores))
    chosen, entered = [], []
    far = np.inf
    dist = np.full(n, np.inf)
    diff = np.empty_like(vecs)
    for _ in range(min(k, n)):
        if far < floor:
            break
        chosen.append(cand)
        entered.append(far)
        np.subtract(vecs, vecs[cand], out=diff)
        np.minimum(dist, np.sqrt(np.einsum("ij,ij->i", diff, diff)), out=dist)
        dist[cand] = -1.0
        cand = int(np.argmax(dist))
        far = float(dist[cand])
    return byid[chosen].tolist(), entered


def greedy_k_center(ids: np.ndarray, vecs: np.ndarray, scores: np.ndarray, k: int) -> list[int]:
    """Positions picked by :func:`farthest_order`."""
    return farthest_order(ids, vecs, scores, k)[0]


def _merged_picks(rows: DataFrame, n: int, k: int, block_rows: int, id_col: str) -> DataFrame:
    """k-center of ``rows`` (id, score, v, _r = 1..n) by merging blocks of picks.

    Stretches of ``_r`` are the blocks of the first level; ``block_rows // k`` neighbouring blocks, each
    with k picks at most, make one of the next, so no block exceeds ``block_rows`` rows.
    """
    block_rows = max(block_rows, 2 * k)
    schema = rows.schema

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf.iloc[greedy_k_center(pdf[id_col].to_numpy(), np.vstack(pdf["v"].to_numpy()),
                                        pdf["score"].to_numpy(dtype=np.float64), k)]
    blocks = -(-n // block_rows)
    size = -(-n // blocks)
    while True:
        block = F.floor((F.col("_r") - 1) / F.lit(size))
        rows = rows.groupBy(block.alias("_b")).applyInPandas(pick, schema)
        if blocks == 1:
            return rows
        merge = block_rows // k
        blocks = -(-blocks // merge)
        size *= merge


def _shrunk(rows: DataFrame, n: int, keep: int, block_rows: int, id_col: str) -> tuple[DataFrame, int]:
    """``keep`` rows of every block of ``block_rows`` by the greedy, numbered anew, and their number."""
    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf.iloc[greedy_k_center(pdf[id_col].to_numpy(), np.vstack(pdf["v"].to_numpy()),
                                        pdf["score"].to_numpy(dtype=np.float64), keep)]
    block = F.floor((F.col("_r") - 1) / F.lit(block_rows))
    left = rows.groupBy(block.alias("_b")).applyInPandas(pick, rows.schema).drop("_r")
    left = rank_rows(left.withColumn("_draw", draw_key(0, "diversity", id_col)),
                     [F.asc("_draw"), F.asc(id_col)], name="_r").select(rows.columns)
    full, rest = divmod(n, block_rows)
    return left, full * keep + min(rest, keep)


def _cell_picks(rows: DataFrame, n: int, k: int, block_rows: int, id_col: str) -> DataFrame:
    """The k rows that enter the farthest-point orders of their cells at the greatest distances.

    A row's cell is its nearest pivot (k-center of the table); a cell of more than ``block_rows`` rows
    is cut by hash into parts, which are ordered apart.  A first pass orders every part as far as its
    share of k; the k-th distance found bounds the wanted one from below, and the second pass orders
    all parts down to it.
    """
    want = max(1, min(MAX_PIVOTS, -(-4 * n // block_rows), block_rows // 2, k // 8))
    pivots = np.array([r["v"] for r in _merged_picks(rows, n, want, block_rows, id_col).orderBy("_r").select("v").collect()])
    half = (pivots ** 2).sum(axis=1) / 2
    shape = T.StructType(rows.schema.fields + [T.StructField("_cell", T.IntegerType())])

    def nearest(batches):
        for pdf in batches:
            if len(pdf):
                pdf["_cell"] = np.argmax(np.vstack(pdf["v"].to_numpy()) @ pivots.T - half, axis=1).astype(np.int32)
                yield pdf
    celled = rows.mapInPandas(nearest, shape)
    celled = materialize(celled)
    parts = celled.groupBy("_cell").count().select(
        "_cell", F.ceil(F.col("count") / block_rows).alias("_parts"))
    part = F.pmod(F.xxhash64(F.col("_r")), F.col("_parts"))
    grouped = celled.join(F.broadcast(parts), "_cell").groupBy("_cell", part.alias("_part"))
    out = T.StructType([rows.schema[id_col], T.StructField("score", T.DoubleType())])
    order = [F.desc("score"), F.asc(id_col)]

    def entering(floor: float) -> DataFrame:
        def enter(pdf: pd.DataFrame) -> pd.DataFrame:
            most = len(pdf) if floor else -(-k * len(pdf) // n)
            at, entered = farthest_order(pdf[id_col].to_numpy(), np.vstack(pdf["v"].to_numpy()),
                                         pdf["score"].to_numpy(dtype=np.float64), most, floor)
            return pd.DataFrame({id_col: pdf[id_col].to_numpy()[at],
                                 "score": np.minimum(entered, np.finfo(np.float64).max)})
        return materialize(grouped.applyInPandas(enter, out))
    first = entering(0.0)
    bound = take_top(first, k, order).agg(F.min("score")).first()[0]
    return take_top(entering(bound) if bound else first, k, order)


def policy_diversity(scores: DataFrame, vecs: DataFrame, budget: float, seed: int = 42,
                     block_rows: int = BLOCK_ROWS, id_col: str = ID, vec_col: str = "vec",
                     merge_k: int = MERGE_K) -> DataFrame:
    """K-center coverage over features (k from the budget) -> sel.

    A k up to ``merge_k`` goes by merging: rows in md5 order are cut into blocks of ``max(block_rows, 2 k)``,
    and with L levels no row of the table is farther than 2 L times the optimal radius from a pick
    (L = 1, the plain greedy, in a table of one block).

    A larger k comes from the farthest-point orders of cells: the radius is the distance at which the
    next row would have entered, and at most twice the optimum of k // m centres, m being the greatest number of
    parts of cells that one optimal ball meets.  Where parts are many (k below 8 n / block_rows, and n / 8),
    blocks are first thinned to a quarter, each time adding at most twice the optimum of block_rows // 4 centres.

    Rows without a vector can't be picked; ids are taken to be distinct.
    """
    rows = scores.select(id_col, F.col("score").cast("double").alias("score")).join(
        vecs.select(id_col, to_double(vec_col).alias("v")).filter(F.col("v").isNotNull()), id_col)
    rows = rank_rows(rows.withColumn("_draw", draw_key(seed, "diversity", id_col)),
                     [F.asc("_draw"), F.asc(id_col)], name="_r").select(id_col, "score", "v", "_r")
    n = rows.count()
    k = chosen_k(rows, budget, n) if n else 0
    if not k:
        return rows.select(id_col).limit(0)
    if n <= block_rows or k <= merge_k:
        return _merged_picks(rows, n, k, block_rows, id_col).select(id_col)
    while k < min(8 * n // block_rows, n // 8):
        rows, n = _shrunk(rows, n, block_rows // 4, block_rows, id_col)
    return _cell_picks(rows, n, k, block_rows, id_col).select(id_col)


def greats_batch(ids: np.ndarray, grads: np.ndarray, gval: np.ndarray, k: int, eta: float) -> list[int]:
    """Greedy: add argmax_i g_i.gval - eta * sum over chosen s of g_i.g_s (lowest id on ties)."""
    n = len(ids)
    util = grads @ gval
    gram = grads @ grads.T
    penalty = np.zeros(n)
    chosen: list[int] = []
    avail = np.ones(n, dtype=bool)
    byid = np.argsort(ids, kind="stable")
    for _ in range(min(k, n)):
        gain = np.where(avail, util - eta * penalty, -np.inf)
        j = byid[np.argmax(gain[byid])]
        chosen.append(j)
        avail[j] = False
        penalty += gram[:, j]
    return chosen


def policy_greats(grads: DataFrame, gval: DataFrame, k: int, eta: float = 0.1,
                  batch_col: str = "batch_id", id_col: str = ID) -> DataFrame:
    """Per batch a size-k subset, useful and diverse -> ``(batch_id, example_id, rank)``.

    ``grads``: (batch_id, example_id, grad); ``gval``: one row (gval).
    """
    g = grads.crossJoin(F.broadcast(gval.select(to_double("gval").alias("gval"))))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        if pdf.empty:
            return pd.DataFrame({batch_col: pd.Series(dtype="int64"), id_col: pd.Series(dtype="int64"),
                                 "rank": pd.Series(dtype="int64")})
        ids = pdf[id_col].to_numpy()
        chosen = greats_batch(ids, np.vstack(pdf["grad"].to_numpy()), np.asarray(pdf["gval"].iloc[0]),
                              k, eta)
        return pd.DataFrame({batch_col: np.full(len(chosen), pdf[batch_col].iloc[0], dtype=np.int64),
                             id_col: ids[chosen].astype(np.int64),
                             "rank": np.arange(1, len(chosen) + 1, dtype=np.int64)})
    return g.groupBy(batch_col).applyInPandas(run, f"{batch_col} long, {id_col} long, rank long")


def compose_scorer_policy(scores: DataFrame, policy: str, budget: float = 0.05,
                          vecs: DataFrame | None = None, **opts) -> DataFrame:
    """Any score table with any policy: topk | hard | reweight | diversity."""
    if policy == "topk":
        return topk_by_score(scores, budget)
    if policy == "hard":
        return policy_hard(scores, budget)
    if policy == "reweight":
        return sigmoid_gate(scores, **opts)
    if policy == "diversity":
        if vecs is None:
            raise ValueError("the diversity policy needs a scorer that exposes features (vecs)")
        return policy_diversity(scores, vecs, budget, **opts)
    raise ValueError(f"unknown policy {policy!r}")
