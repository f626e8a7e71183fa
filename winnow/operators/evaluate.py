"""Evaluation as a data job."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winnow.functions.text import last_number as last_number_expr

# --- fixed values: benchmark prompt format -----------------------------------
QUESTION_PREFIX = "Question: "
ANSWER_SUFFIX = "\nAnswer:"
# ---------------------------------------------------------------------------


def last_number(df: DataFrame, text_col: str = "text", id_col: str = "example_id") -> DataFrame:
    """``(id, num)``: last number in the text, commas and trailing dots removed."""
    return df.select(id_col, last_number_expr(text_col).alias("num"))


def exact_match_accuracy(preds: DataFrame, pred_col: str = "prediction", gold_col: str = "gold") -> DataFrame:
    """``(n, accuracy)``: correct / max(1, n); a NULL gold is wrong but counted."""
    hit = F.when(F.col(gold_col).isNotNull() & (F.col(pred_col) == F.col(gold_col)), 1).otherwise(0)
    return preds.agg(F.count(F.lit(1)).alias("n"), F.sum(hit).alias("_c")).select(
        "n", (F.coalesce(F.col("_c"), F.lit(0)) / F.greatest(F.col("n"), F.lit(1))).alias("accuracy"))


def benchmark_examples(df: DataFrame, limit: int | None = None, id_col: str = "item_id",
                       question_col: str = "question", answer_col: str = "answer") -> DataFrame:
    """The first ``limit`` items (falsy = all) -> ``(id, prompt, gold)``."""
    rows = df.orderBy(id_col).limit(limit) if limit else df
    return rows.select(id_col, F.concat(F.lit(QUESTION_PREFIX), F.col(question_col), F.lit(ANSWER_SUFFIX))
                       .alias("prompt"), last_number_expr(answer_col).alias("gold"))
