"""Record shaping (B1-B8): raw rows -> ``(example_id, instruction, input, output)``.

All row-local column expressions (higher-order functions on arrays), so
they stay inside whole-stage code generation and need no shuffle; only the
long-form chat table is grouped once per conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from winnow.functions.text import blank_to_empty, py_strip
from winnow.functions.text import tokenize_whitespace as ws_tokens
from winnow.operators.budget import ID

# --- fixed values -----------------------------------------------------------
ROLE_TAGS = {"system": "System", "user": "User", "assistant": "Assistant"}
PROMPT_HEAD = "Below is an instruction that describes a task"
PROMPT_INPUT_NOTE = ", paired with an input"
PROMPT_TAIL = ". Write a response that appropriately completes the request.\n\n### Instruction:\n"
INPUT_HEADER = "### Input:\n"
RESPONSE_HEADER = "### Response:\n"
EOS = "</s>"
MAX_LENGTH = 2048
# ---------------------------------------------------------------------------

RECORD_COLS = ["instruction", "input", "output"]


def _nonblank(c: Column) -> Column:
    return py_strip(F.coalesce(c, F.lit(""))) != F.lit("")


def alpaca_record(df: DataFrame, id_col: str = ID) -> DataFrame:
    """B1: NULL -> '', strip all three fields, drop rows without instruction or output."""
    out = df.select(id_col, *[blank_to_empty(c).alias(c) for c in RECORD_COLS])
    return out.filter((F.col("instruction") != "") & (F.col("output") != ""))


def role_tag(role: Column) -> Column:
    expr = F.coalesce(role, F.lit(""))
    for raw, tag in ROLE_TAGS.items():
        expr = F.when(role == F.lit(raw), F.lit(tag)).otherwise(expr)
    return expr


def messages_to_record(df: DataFrame, messages_col: str = "messages", id_col: str = ID,
                       keep: list | None = None) -> DataFrame:
    """B2 on ``ARRAY<STRUCT<role, content>>``: last non-blank assistant turn is the output."""
    keep = list(keep or [])
    idx = F.transform(F.col(messages_col), lambda m, i: F.struct(
        i.alias("i"), m["role"].alias("role"), m["content"].alias("content")))
    last_a = F.array_max(F.transform(
        F.filter(F.col("_m"), lambda x: (x["role"] == F.lit("assistant")) & _nonblank(x["content"])),
        lambda x: x["i"]))
    t = df.select(id_col, *keep, idx.alias("_m")).withColumn("_last", last_a)
    t = t.filter(F.col("_last").isNotNull())
    hist = F.filter(F.col("_m"), lambda x: x["i"] < F.col("_last"))
    single_user = (F.size(hist) == 1) & (F.try_element_at(hist, F.lit(1))["role"] == F.lit("user"))
    tagged = F.array_join(F.transform(
        F.filter(hist, lambda x: _nonblank(x["content"])),
        lambda x: F.concat(role_tag(x["role"]), F.lit(": "), py_strip(x["content"]))), "\n\n")
    instruction = F.when(single_user,
                         blank_to_empty(F.try_element_at(hist, F.lit(1))["content"])).otherwise(tagged)
    output = py_strip(F.element_at(F.col("_m"), F.col("_last") + 1)["content"])
    out = t.select(id_col, *keep, instruction.alias("instruction"), F.lit("").alias("input"),
                   output.alias("output"))
    return out.filter(F.col("instruction") != "")


def turns_to_messages(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn",
                      role_col: str = "role", text_col: str = "text", id_col: str = ID) -> DataFrame:
    """Long form -> one row per conversation with ``messages`` in turn order."""
    g = turns.groupBy(F.col(conv_col).alias(id_col)).agg(F.array_sort(F.collect_list(
        F.struct(F.col(turn_col).alias("t"), F.col(role_col).alias("role"),
                 F.col(text_col).alias("content")))).alias("_ms"))
    return g.select(id_col, F.transform("_ms", lambda x: F.struct(
        x["role"].alias("role"), x["content"].alias("content"))).alias("messages"))


def chat_to_record(turns: DataFrame, **kw) -> DataFrame:
    """B2 on the long form ``(conv_id, turn, role, text)``."""
    return messages_to_record(turns_to_messages(turns, **kw))


def sharegpt_pair_cols(conv: Column):
    """(instruction, output) of the first human -> gpt pair in a ShareGPT list."""
    idx = F.transform(conv, lambda m, i: F.struct(
        i.alias("i"), m["from"].alias("from"), py_strip(F.coalesce(m["value"], F.lit(""))).alias("v")))
    nb = F.filter(idx, lambda x: x["v"] != F.lit(""))
    human = F.try_element_at(F.filter(nb, lambda x: x["from"] == F.lit("human")), F.lit(1))
    gpt = F.try_element_at(F.filter(nb, lambda x: (x["from"] == F.lit("gpt")) & (x["i"] > human["i"])),
                           F.lit(1))
    return human["v"], gpt["v"]


def sharegpt_first_pair(df: DataFrame, conv_col: str = "conversations", id_col: str = ID) -> DataFrame:
    """First non-blank human turn, then the first non-blank gpt turn after it."""
    ins, out = sharegpt_pair_cols(F.col(conv_col))
    r = df.select(id_col, ins.alias("instruction"), out.alias("output"))
    return r.filter(F.col("instruction").isNotNull() & F.col("output").isNotNull())


def evol_record(df: DataFrame, conv_col: str = "conversations", id_col: str = ID,
                keep: list | None = None) -> DataFrame:
    """Non-empty conversations -> B3 (no fallback), else instruction/output columns."""
    keep = list(keep or [])
    ins, out = sharegpt_pair_cols(F.col(conv_col))
    has_conv = F.coalesce(F.size(F.col(conv_col)) > 0, F.lit(False))
    r = df.select(id_col, *keep,
                  F.when(has_conv, F.coalesce(ins, F.lit(""))).otherwise(blank_to_empty("instruction"))
                  .alias("instruction"),
                  F.lit("").alias("input"),
                  F.when(has_conv, F.coalesce(out, F.lit(""))).otherwise(blank_to_empty("output"))
                  .alias("output"))
    return r.filter((F.col("instruction") != "") & (F.col("output") != ""))


def prompt_expr(instruction="instruction", inp="input") -> Column:
    """The instruction prompt, with an Input block when the stripped input is non-empty."""
    i = blank_to_empty(inp)
    has = i != F.lit("")
    return F.concat(
        F.lit(PROMPT_HEAD), F.when(has, F.lit(PROMPT_INPUT_NOTE)).otherwise(F.lit("")),
        F.lit(PROMPT_TAIL), blank_to_empty(instruction), F.lit("\n\n"),
        F.when(has, F.concat(F.lit(INPUT_HEADER), i, F.lit("\n\n"))).otherwise(F.lit("")),
        F.lit(RESPONSE_HEADER))


def format_prompt(ex: DataFrame) -> DataFrame:
    return ex.withColumn("text", prompt_expr())


def tokenize_mask(ex: DataFrame, max_length: int | None = MAX_LENGTH, id_col: str = ID) -> DataFrame:
    """``(example_id, text, tokens, n_prompt)``; text is the prompt only.

    tokens = whitespace tokens of prompt + response + EOS, truncated right to
    max_length (None: whole); the first ``n_prompt`` are the masked prompt.
    """
    p = format_prompt(ex)
    prompt_toks = ws_tokens(F.col("text"))
    full = F.concat(prompt_toks, ws_tokens(blank_to_empty("output")), F.array(F.lit(EOS)))
    if max_length is None:
        return p.select(id_col, "text", full.alias("tokens"), F.size(prompt_toks).cast("long").alias("n_prompt"))
    return p.select(id_col, "text",
                    F.slice(full, 1, max_length).alias("tokens"),
                    F.least(F.size(prompt_toks), F.lit(max_length)).cast("long").alias("n_prompt"))


def response_tokens(tok: DataFrame, id_col: str = ID) -> DataFrame:
    """Tokens whose label is not masked (positions after ``n_prompt``)."""
    n = F.size("tokens") - F.col("n_prompt")
    return tok.select(id_col, F.when(n > 0, F.slice("tokens", F.col("n_prompt").cast("int") + 1,
                                                    n.cast("int")))
                      .otherwise(F.array().cast("array<string>")).alias("response"))


def scorable_flag(tok: DataFrame, id_col: str = ID) -> DataFrame:
    """False when every label is masked (the prompt filled max_length)."""
    return tok.select(id_col, (F.size("tokens") > F.col("n_prompt")).alias("scorable"))
