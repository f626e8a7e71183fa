"""Loss-based scores on the ``token_nll`` table.

Every score is an aggregation of ``(example_id, variant, pos, nll)`` keyed by
example, a join of two such aggregates, or a column expression; selection
then goes through the shared invalid-sink top-k.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winnow.operators.budget import ID, chosen_k, invalid_sink, score_direction, topk_by_score
from winnow.operators.lm import (W_BI_CTX, W_CACHE, W_UNI_CTX, CountLM, lm_brief_experience, nll_with_context,
                                 nll_without_context, scored_rows, token_nll)
from winnow.operators.records import MAX_LENGTH
from winnow.operators.sampling import cluster_round_robin
from winnow.operators.vectors import encode_mean_pool, kmeans_labels, nearest_neighbor
from winnow.session import materialize, store


def response_loss(nll: DataFrame, tok: DataFrame | None = None, id_col: str = ID) -> DataFrame:
    """Mean nll over response tokens; NULL when there are none (all masked).

    With ``tok`` given, unscorable examples appear with a NULL loss.
    """
    loss = nll.groupBy(id_col).agg(F.avg("nll").alias("loss"))
    if tok is None:
        return loss
    return tok.select(id_col).join(loss, id_col, "left")


def direct_loss(nll_direct: DataFrame, tok: DataFrame, id_col: str = ID) -> DataFrame:
    """Response alone; needs >= 2 response tokens (the first is context only)."""
    n_resp = F.size("tokens") - F.col("n_prompt")
    ok = tok.select(id_col, (n_resp >= 2).alias("_ok"))
    loss = nll_direct.groupBy(id_col).agg(F.avg("nll").alias("loss"))
    return ok.join(loss, id_col, "left").select(
        id_col, F.when(F.col("_ok"), F.col("loss")).alias("loss"))


def per_sample_loss(nll: DataFrame, tok: DataFrame, id_col: str = ID) -> DataFrame:
    """Training-loop form: sum / max(count, 1), so 0.0 when nothing is scored."""
    agg = nll.groupBy(id_col).agg(F.sum("nll").alias("_s"), F.count(F.lit(1)).alias("_n"))
    return tok.select(id_col).join(agg, id_col, "left").select(
        id_col, (F.coalesce("_s", F.lit(0.0)) / F.greatest(F.coalesce("_n", F.lit(0)), F.lit(1)))
        .alias("loss"))


def perplexity(loss: DataFrame, id_col: str = ID) -> DataFrame:
    """exp(response loss); NULL when unscorable."""
    return loss.select(id_col, F.exp("loss").alias("score"))


def select_ppl(tok: DataFrame, lm: CountLM, budget: float = 0.05, keep: str = "high",
               id_col: str = ID) -> DataFrame:
    """Perplexity, one tail; unscorable examples sink."""
    if keep not in ("high", "low"):
        raise ValueError("keep must be 'high' or 'low'")
    tok = store(tok)
    ppl = perplexity(response_loss(token_nll(tok, lm, "cond"), tok, id_col), id_col)
    return topk_by_score(score_direction(ppl, keep), budget, out_digits=4)


def ifd_score(cond: DataFrame, direct: DataFrame, id_col: str = ID) -> DataFrame:
    """Cond / direct; NULL if either is missing or direct <= 0."""
    j = cond.withColumnRenamed("loss", "_c").join(direct.withColumnRenamed("loss", "_d"), id_col, "full")
    return j.select(id_col, F.when(F.col("_d") > 0, F.col("_c") / F.col("_d")).alias("score"))


def ifd_scores(tok: DataFrame, lm: CountLM, id_col: str = ID) -> DataFrame:
    """IFD from one pass of count lookups.

    Every direct-loss position (response token j >= 1) is also a conditioned
    position with the same previous token, so one set of looked-up
    probabilities gives both losses: with the prompt cache for ``cond``,
    without it (and without the first response token) for ``direct``.
    """
    tok = store(tok)
    rows = scored_rows(tok, lm, "cond", id_col=id_col)
    direct_pos = F.col("pos") > F.col("start")
    agg = rows.groupBy(id_col).agg(
        F.avg(nll_with_context()).alias("_c"),
        F.avg(F.when(direct_pos, nll_without_context())).alias("_d"))
    n_resp = F.size("tokens") - F.col("n_prompt")
    j = tok.select(id_col, (n_resp >= 2).alias("_ok")).join(agg, id_col, "left")
    d = F.when(F.col("_ok"), F.col("_d"))
    return j.select(id_col, F.when(d > 0, F.col("_c") / d).alias("score"))


def select_ifd(tok: DataFrame, lm: CountLM, budget: float = 0.05, ifd_max: float = 1.0,
               id_col: str = ID) -> DataFrame:
    """Keep the highest IFD among 0 < IFD < ifd_max; the rest sink."""
    s = ifd_scores(tok, lm, id_col)
    valid = F.col("score").isNotNull() & ~F.isnan("score") & (F.col("score") > 0) & \
        (F.col("score") < F.lit(float(ifd_max)))
    return topk_by_score(invalid_sink(s, valid), budget)


def cluster_warmup(tok: DataFrame, frac: float = 0.1, clusters: int = 100, seed: int = 42,
                   id_col: str = ID) -> DataFrame:
    """The IFD warm-up subset: records encoded whole (prompt and response), clustered, and drawn
    from the clusters in turn (C7) up to ``frac`` of all."""
    vecs = materialize(encode_mean_pool(tok.select(id_col, "tokens"), id_col=id_col))
    n = vecs.count()
    labels = kmeans_labels(vecs, max(1, min(clusters, n)), seed, id_col=id_col)
    return cluster_round_robin(materialize(labels), chosen_k(vecs, min(float(frac), 1.0), n), seed, id_col).select(id_col)


def select_ifd_warm(tok: DataFrame, lm: CountLM, budget: float = 0.05, ifd_max: float = 1.0, warmup_frac: float = 0.1,
                    clusters: int = 100, seed: int = 42, id_col: str = ID) -> DataFrame:
    """IFD end to end: cluster-balanced warm-up (C7), brief experience (G10), then G9 on the warm model."""
    tok = store(tok)
    warm = lm_brief_experience(lm, tok, cluster_warmup(tok, warmup_frac, clusters, seed, id_col), id_col)
    return select_ifd(tok, warm, budget, ifd_max)


def one_shot_context(tok: DataFrame, nn: DataFrame, max_length: int | None = MAX_LENGTH,
                     id_col: str = ID) -> DataFrame:
    """The neighbour's full tokens, trimmed from the left to max_length - len(target)
    (None: whole)."""
    ctx = tok.select(F.col(id_col).alias("nn_id"), F.col("tokens").alias("_ctx"))
    t = tok.select(id_col, F.size("tokens").alias("_n")).join(nn.select(id_col, "nn_id"), id_col) \
           .join(ctx, "nn_id")
    if max_length is None:
        return t.select(id_col, "nn_id", F.col("_ctx").alias("context"))
    room = F.lit(max_length) - F.col("_n")
    keep = F.least(room, F.size("_ctx"))
    context = F.when(room <= 0, F.array().cast("array<string>")) \
               .otherwise(F.slice("_ctx", F.size("_ctx") - keep + 1, keep))
    return t.select(id_col, "nn_id", context.alias("context"))


NOISE = 1e-12


def _change(before, after):
    """``after - before`` of two losses; a difference below 1e-12 is float noise and counts as none."""
    d = F.col(after) - F.col(before)
    return F.when(F.abs(d) < F.lit(NOISE), F.lit(0.0)).otherwise(d)


def miwv_score(cond: DataFrame, oneshot: DataFrame, id_col: str = ID) -> DataFrame:
    """Loss with the one-shot context minus loss without it."""
    j = cond.withColumnRenamed("loss", "_c").join(oneshot.withColumnRenamed("loss", "_o"), id_col, "left")
    return j.select(id_col, _change("_c", "_o").alias("score"))


def miwv_scores(tok: DataFrame, vecs: DataFrame, lm: CountLM, max_length: int | None = None,
                id_col: str = ID, nn_mode: str = "index") -> DataFrame:
    """MIWV = loss with the one-shot context - loss without it.

    When every record has a prompt, the response tokens see the same previous
    token with or without the context, so one pass of count lookups serves
    both losses: the one-shot cache adds the context's token counts to the
    prompt's.  (Records without a prompt would see the context's last token as
    the first response token's history; then the two losses run separately.)
    """
    tok = store(tok)
    nn = nearest_neighbor(vecs, mode=nn_mode, id_col=id_col)
    ctx = store(one_shot_context(tok, nn, max_length, id_col))
    if (tok.agg(F.min("n_prompt")).first()[0] or 0) < 1:
        cond = response_loss(token_nll(tok, lm, "cond"), tok, id_col)
        shot = response_loss(token_nll(tok, lm, "oneshot", ctx), tok, id_col)
        return miwv_score(cond, shot, id_col)
    rows = scored_rows(tok, lm, "cond", id_col=id_col)
    ctx_counts = (ctx.select(id_col, F.explode("context").alias("token"))
                     .groupBy(id_col, "token").agg(F.count(F.lit(1)).cast("double").alias("cc_ctx")))
    ctx_len = ctx.select(id_col, F.size("context").cast("double").alias("n_ctx"))
    rows = rows.join(ctx_counts, [id_col, "token"], "left").join(ctx_len, id_col, "left")
    n_ctx = F.coalesce(F.col("n_ctx"), F.lit(0.0))
    denom = F.col("clen") + n_ctx
    p_shot = F.when(denom > 0, (F.col("cc") + F.coalesce(F.col("cc_ctx"), F.lit(0.0))) / denom) \
              .otherwise(F.lit(0.0))
    shot_nll = -F.log(F.lit(W_BI_CTX) * F.col("p_bi") + F.lit(W_UNI_CTX) * F.col("p_uni")
                      + F.lit(W_CACHE) * p_shot)
    agg = rows.groupBy(id_col).agg(F.avg(nll_with_context()).alias("_c"), F.avg(shot_nll).alias("_o"))
    return tok.select(id_col).join(agg, id_col, "left").select(
        id_col, _change("_c", "_o").alias("score"))


def select_miwv(tok: DataFrame, vecs: DataFrame, lm: CountLM, budget: float = 0.05,
                max_length: int | None = None, id_col: str = ID) -> DataFrame:
    """Nearest neighbour -> one-shot context -> MIWV, highest kept; unscorable sink."""
    return topk_by_score(miwv_scores(tok, vecs, lm, max_length, id_col), budget)
