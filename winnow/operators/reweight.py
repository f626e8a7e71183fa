"""Online reweighting signals.

Weights are per-row transforms of a score (not normalized over a batch), so
every step is a column expression or a join on ``example_id``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from winnow.operators.budget import ID
from winnow.operators.ranking import maybe_broadcast
from winnow.operators.lexical import bm25_anchor, standardize
from winnow.operators.vectors import anchor_mean_cosine, encode_position_pool
from winnow.functions.vector import to_double
from winnow.session import materialize


def gate_expr(score: Column, tau: float = 1.0, eps: float = 1e-8, w_min: float = 0.0,
              w_max: float = 10.0) -> Column:
    """clip(sigmoid(score / max(tau, eps)), w_min, w_max)."""
    z = score / F.lit(max(tau, eps))
    w = F.lit(1.0) / (F.lit(1.0) + F.exp(-z))
    return F.least(F.greatest(w, F.lit(float(w_min))), F.lit(float(w_max)))


def sigmoid_gate(scores: DataFrame, tau: float = 1.0, eps: float = 1e-8, w_min: float = 0.0,
                 w_max: float = 10.0, score_col: str = "score", id_col: str = ID) -> DataFrame:
    """I1 (and D7 policy_reweight): ``(example_id, weight)``."""
    return scores.select(id_col, gate_expr(F.col(score_col), tau, eps, w_min, w_max).alias("weight"))


policy_reweight = sigmoid_gate


def weights_bm25(ex: DataFrame, anchors: DataFrame, standardize_signal: bool = False,
                 k1: float = 1.5, b: float = 0.75, tau: float = 1.0, eps: float = 1e-8,
                 w_min: float = 0.0, w_max: float = 10.0, id_col: str = ID,
                 anchor_id: str = "anchor_id") -> DataFrame:
    """Mean BM25 against the anchors (optionally standardized) -> gate."""
    s = bm25_anchor(ex, anchors, k1, b, id_col=id_col, anchor_id=anchor_id)
    if standardize_signal:
        s = standardize(s, eps)
    return s.select(id_col, "score", gate_expr(F.col("score"), tau, eps, w_min, w_max).alias("weight"))


def weights_embed(tok: DataFrame, anchor_tok: DataFrame, tau: float = 1.0, eps: float = 1e-8,
                  w_min: float = 0.0, w_max: float = 10.0, id_col: str = ID) -> DataFrame:
    """Position-pooled unit vectors, mean cosine to the anchors -> gate."""
    phi = encode_position_pool(tok, eps=eps, id_col=id_col)
    anchors = encode_position_pool(anchor_tok, eps=eps, id_col=anchor_tok.columns[0])
    s = anchor_mean_cosine(phi, anchors, id_col)
    return s.select(id_col, "score", gate_expr(F.col("score"), tau, eps, w_min, w_max).alias("weight"))


def combine_weighted_loss(losses: DataFrame, weights: DataFrame, batch_col: str = "batch_id",
                          norm: str = "mean", eps: float = 1e-8, id_col: str = ID) -> DataFrame:
    """I4: per batch ``mean(w*l)``, ``sum(w*l)`` or ``sum(w*l) / max(sum(w), eps)``."""
    j = losses.join(weights.select(id_col, "weight"), id_col)
    wl = F.col("weight") * F.col("loss")
    if norm == "mean":
        agg = F.avg(wl)
    elif norm == "sum":
        agg = F.sum(wl)
    elif norm == "zsum":
        agg = F.sum(wl) / F.greatest(F.sum("weight"), F.lit(eps))
    else:
        raise ValueError("norm must be mean, sum or zsum")
    return j.groupBy(batch_col).agg(agg.alias("loss"))


def refresh_version(step: Column, interval: int = 50) -> Column:
    """Step of the anchor refresh in force at ``step``: floor(step/R)*R; R < 0 never refreshes."""
    r = interval or 50  # 0 takes the default
    if r < 0:
        return F.lit(0).cast("long")
    return (F.floor(step / F.lit(r)) * F.lit(r)).cast("long")


def first_version(effective: Column, interval: int = 50) -> Column:
    """The first refresh at which an anchor of that step counts; NULL if there is none (R < 0)."""
    r = interval or 50
    early = F.greatest(effective, F.lit(0))
    if r < 0:
        return F.when(early == 0, F.lit(0)).cast("long")
    return (F.ceil(early / F.lit(r)) * F.lit(r)).cast("long")


def anchor_centroids(versions: DataFrame, anchors: DataFrame, interval: int = 50, vec_col: str = "vec") -> DataFrame:
    """``(version, n_anchors, vec)``: mean of the anchors with ``effective_step <= version``.

    ``versions(version)`` are distinct; ``anchors`` carry ``effective_step`` and a (unit) vector.
    Each anchor goes once to the first refresh that sees it; per-version sums are added up by
    a running sum per dimension, so no (version, anchor) pairs are formed.  A version without
    an anchor has a null vector.
    """
    a = anchors.select(first_version(F.col("effective_step"), interval).alias("version"), to_double(vec_col).alias("v"))
    a = a.where("version is not null")
    part = a.select("version", F.posexplode("v").alias("dim", "x")).groupBy("version", "dim").agg(
        F.sum("x").alias("x"), F.count(F.lit(1)).alias("n"), F.lit(False).alias("asked"))
    dims = a.select(F.explode(F.sequence(F.lit(0), F.size("v") - 1)).alias("dim")).distinct()
    asked = versions.select("version").crossJoin(F.broadcast(dims)).select(
        "version", "dim", F.lit(0.0).alias("x"), F.lit(0).cast("long").alias("n"), F.lit(True).alias("asked"))
    upto = Window.partitionBy("dim").orderBy("version").rangeBetween(Window.unboundedPreceding, 0)
    run = part.unionByName(asked).withColumn("s", F.sum("x").over(upto)).withColumn("c", F.sum("n").over(upto))
    seen = run.where("asked and c > 0").groupBy("version").agg(
        F.max("c").alias("n_anchors"), F.array_sort(F.collect_list(F.struct("dim", (F.col("s") / F.col("c")).alias("m")))).alias("d"))
    vec = seen.select("version", "n_anchors", F.transform("d", lambda d: d["m"]).alias(vec_col))
    return versions.select("version").join(vec, "version", "left").fillna(0, ["n_anchors"])


def anchor_refresh(steps: DataFrame, anchors: DataFrame | None = None, interval: int = 50,
                   step_col: str = "step", vec_col: str = "vec") -> DataFrame:
    """``(step, version[, vec])``: the anchor centroid in force at each step.

    ``anchors`` with ``effective_step``: the centroid of a version is the mean of the anchors
    that have arrived by its step (:func:`anchor_centroids`).  ``anchors`` with ``version``: one
    centroid per refresh (the encoder state at that step).  Both join on the version.
    """
    s = steps.select(step_col).withColumn("version", refresh_version(F.col(step_col), interval))
    if anchors is None:
        return s
    if "effective_step" in anchors.columns:
        anchors = materialize(anchor_centroids(s.select("version").distinct(), anchors, interval, vec_col)
                              .select("version", vec_col))
    return s.join(maybe_broadcast(anchors, anchors.count()), "version", "left")


def thread_row_id(df: DataFrame, keep: list[str], id_col: str = ID) -> DataFrame:
    """I8: carry the stable row id beside the kept columns; drop the rest."""
    return df.select(id_col, *keep)
