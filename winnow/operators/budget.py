"""Budget resolution, top-k by score and simple policies.

Scores are ``(example_id, score)``; NULL means "unusable" and sinks below
every valid score while still filling the budget, lowest id first.
Ranking uses ten significant digits, so that float noise between exact copies
cannot reorder ties (ties go to the lower id) and scores of any size are told apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from winnow.operators.ranking import LIMIT_K, BROADCAST_ROWS, maybe_broadcast, take_top, top_by_threshold
from winnow.session import materialize

ID = "example_id"
SCORE_FORMAT = "%.9e"


def k_expr(n: Column, budget: float, rounding: str = "even") -> Column:
    """budget <= 1: budget*n, rounded half-even or truncated; else trunc(budget); clamp to [1, n]."""
    if rounding not in ("even", "trunc"):
        raise ValueError("rounding must be 'even' or 'trunc'")
    if budget <= 1:
        share = F.lit(float(budget)) * n.cast("double")
        raw = (F.bround(share, 0) if rounding == "even" else F.floor(share)).cast("long")
    else:
        raw = F.lit(int(budget)).cast("long")
    return F.greatest(F.lit(1).cast("long"), F.least(n.cast("long"), raw))


def budget_to_k(df: DataFrame, budget: float) -> DataFrame:
    """One row ``(n, k)``."""
    return (df.agg(F.count(F.lit(1)).alias("n"))
              .select("n", k_expr(F.col("n"), budget).alias("k")))


def chosen_k(df: DataFrame, budget: float, n: int | None = None, rounding: str = "even") -> int:
    """:func:`k_expr` as a number, for the rows of ``df`` (counted here unless ``n`` is known)."""
    size = df.agg(F.count(F.lit(1)).alias("n")) if n is None else \
        df.sparkSession.range(1).select(F.lit(n).alias("n"))
    return size.select(k_expr(F.col("n"), budget, rounding).alias("k")).first()["k"]


def significant(score: Column) -> Column:
    """A finite or NULL score to ten significant digits ("+ 0.0" turns -0.0 into 0.0)."""
    return F.when(score.isNotNull(), F.format_string(SCORE_FORMAT, score).try_cast("double") + F.lit(0.0))


def rank_order(score_col: str = "score", id_col: str = ID) -> list:
    return [F.desc_nulls_last(significant(F.col(score_col))), F.asc(id_col)]


def topk_by_score(scores: DataFrame, budget: float, n: int | None = None,
                  score_col: str = "score", id_col: str = ID, out_digits: int | None = None) -> DataFrame:
    """The k best rows (k from the budget); output ``(example_id, score)``.

    Ranking and output use ten significant digits; ``out_digits`` rounds the output to
    that many decimals instead (perplexities, exponentials, carry fewer stable digits).
    """
    # NaN and infinite scores rank with the missing ones.
    value = F.col(score_col).cast("double")
    finite = ~F.isnan(value) & (F.abs(value) < F.lit(float("inf")))
    scores = scores.withColumn(score_col, F.when(finite, value))
    written = n is None
    if written:
        # Count and rank read one written score table instead of running the
        # scoring plan twice.
        scores = materialize(scores.select(id_col, score_col))
        n = scores.count()
    k = chosen_k(scores, budget, n)
    if k <= LIMIT_K:
        top = take_top(scores.select(id_col, score_col), k, rank_order(score_col, id_col))
    else:
        ranked = scores.select(id_col, score_col, significant(F.col(score_col)).alias("_key"))
        top = top_by_threshold(ranked if written else materialize(ranked), k, "_key", id_col)
    score = F.col(score_col)
    out = significant(score) if out_digits is None else F.round(score, out_digits) + F.lit(0.0)
    return top.select(id_col, out.alias(score_col))


def invalid_sink(scores: DataFrame, valid: Column, score_col: str = "score") -> DataFrame:
    """Unusable scores become NULL (they rank below every valid score)."""
    return scores.withColumn(score_col, F.when(valid, F.col(score_col)))


def score_direction(scores: DataFrame, keep: str = "high", score_col: str = "score") -> DataFrame:
    """Keep the high/near tail as is; the low/far tail by negation."""
    if keep in ("high", "near"):
        return scores
    if keep in ("low", "far"):
        return scores.withColumn(score_col, -F.col(score_col))
    raise ValueError(f"keep must be high, low, near or far, not {keep!r}")


def materialize_subset(ex: DataFrame, sel: DataFrame, k: int | None = None,
                       id_col: str = ID) -> DataFrame:
    """Rows of ``ex`` whose id is selected (semi join; broadcast when k is small)."""
    ids = sel.select(id_col)
    if k is not None:
        ids = maybe_broadcast(ids, k, BROADCAST_ROWS)
    return ex.join(ids, id_col, "left_semi")


def policy_hard(scores: DataFrame, budget: float, n: int | None = None,
                score_col: str = "score", id_col: str = ID) -> DataFrame:
    """{0,1} weight: 1 for the top k."""
    if n is None:
        scores = materialize(scores.select(id_col, score_col))
        n = scores.count()
    k = chosen_k(scores, budget, n)
    top = topk_by_score(scores, budget, n, score_col, id_col).select(id_col, F.lit(1.0).alias("_w"))
    top = maybe_broadcast(top, k, BROADCAST_ROWS)
    return (scores.select(id_col).join(top, id_col, "left")
                  .select(id_col, F.coalesce(F.col("_w"), F.lit(0.0)).alias("weight")))


def select_all(ex: DataFrame, id_col: str = ID) -> DataFrame:
    """Identity selection (online reweighting keeps every row)."""
    return ex.select(id_col)


__all__ = ["budget_to_k", "chosen_k", "topk_by_score", "invalid_sink", "score_direction",
           "materialize_subset", "policy_hard", "select_all", "rank_order", "LIMIT_K"]
