"""A count-based language model fitted in Spark.

Stands in for a neural model's per-token loss: the scoring maths downstream
(response loss, IFD, MIWV, perplexity) only needs a table
``token_nll(example_id, variant, pos, nll)``; any model can fill it.

p(w | h, C) = 0.4 p_bi + 0.3 p_uni + 0.3 p_cache   with a visible context C
            = 0.5 p_bi + 0.5 p_uni                  without one
p_uni(w)    = (c(w) + 1) / (T + V + 1)   (T tokens, V distinct tokens)
p_bi(w | h) = c(h, w) / c(h .), or p_uni when c(h .) = 0 or there is no h
p_cache(w)  = count of w in C / |C|

Everything is joins on count tables (token, bigram, prefix, and the
per-example context counts), so the work is shuffles keyed by token or by
(example_id, token); skewed hot tokens are split by AQE's skew join.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winnow.operators.budget import ID
from winnow.operators.ranking import ROW_OVERHEAD_BYTES, broadcast_budget_bytes
from winnow.session import store

# A count table is broadcast into the scoring joins only when its measured size
# (string bytes + per-row overhead) fits the session's broadcast budget; otherwise it
# joins by sort-merge.  The optimizer's own size estimate comes from the compressed
# files and can be far too small to trust.

# --- fixed values: mixture weights of the count model -----------------------
W_BI_CTX, W_UNI_CTX, W_CACHE = 0.4, 0.3, 0.3
W_BI, W_UNI = 0.5, 0.5
# ---------------------------------------------------------------------------


@dataclass
class CountLM:
    """The counts of a corpus.  Only ``pairs`` is there from the start; the other tables are made when they are asked for."""

    pairs: DataFrame    # (prev, token, c), prev NULL at starts; a pair's count is the sum of its rows
    once: bool = True   # no pair has more than one row

    @cached_property
    def uni(self) -> DataFrame:
        """``(token, c, c_pre)``: occurrences, and those that another token follows (all but the ends)"""
        zero, c = F.lit(0).cast("long"), F.col("c")
        both = F.array(F.struct(F.col("token").alias("token"), c.alias("c"), zero.alias("c_pre")),
                       F.struct(F.col("prev").alias("token"), zero.alias("c"), F.when(F.col("token").isNotNull(), c).alias("c_pre")))
        return store(self.pairs.select(F.explode(both).alias("r")).select("r.*").filter(F.col("token").isNotNull())
                     .groupBy("token").agg(F.sum("c").alias("c"), F.coalesce(F.sum("c_pre"), F.lit(0)).alias("c_pre")))

    @property
    def bi(self) -> DataFrame:
        """``(prev, token, c)``"""
        return self._summed(self.pairs)

    @property
    def pre(self) -> DataFrame:
        """``(prev, c)``: occurrences that another token follows"""
        return self.uni.filter("c_pre > 0").select(F.col("token").alias("prev"), F.col("c_pre").alias("c"))

    def _summed(self, pairs: DataFrame) -> DataFrame:
        rows = pairs.filter(F.col("prev").isNotNull() & F.col("token").isNotNull())
        return rows if self.once else rows.groupBy("prev", "token").agg(F.sum("c").alias("c"))

    def bi_of(self, asked: DataFrame, n: int) -> DataFrame:
        """The rows of ``bi`` that ``asked (prev, token)``, at most ``n`` rows, can meet, and a few others.

        Far fewer pairs are scored than counted: only the counts that :func:`met_rows` leaves are shuffled and sorted.
        """
        some = asked.filter(F.col("prev").isNotNull() & F.col("token").isNotNull())
        return self._summed(met_rows(self.pairs, some, ["prev", "token"], n))

    @cached_property
    def _tokens(self):
        return self.uni.agg(F.count(F.lit(1)).alias("v"), F.sum("c").alias("t"), F.sum(F.octet_length("token")).alias("b")).first()

    @property
    def totals(self) -> DataFrame:
        """one row ``(T, V)``"""
        u = self._tokens
        return self.pairs.sparkSession.createDataFrame([(float(u["t"] or 0), float(u["v"]))], "T double, V double")

    @cached_property
    def bytes_uni(self) -> int:
        return int(self._tokens["b"] or 0) + int(self._tokens["v"]) * ROW_OVERHEAD_BYTES

    @cached_property
    def bytes_bi(self) -> int:
        return _pair_bytes(self.pairs)


# Words of 64 bits in a row of a bitmap: such a row takes a quarter of a byte a bit.
WORDS = 8


def met_rows(table: DataFrame, asked: DataFrame, on: list[str], n: int) -> DataFrame:
    """The rows of ``table`` that ``asked``, at most ``n`` rows, can meet on ``on``, and a few others.

    Of the asked keys, one bit each of a hash is set in words of 64 bits.  The words are broadcast, within the budget: with
    less than a bit for an asked row the table stays as it is.
    """
    budget = broadcast_budget_bytes(table.sparkSession)
    bits = 1 << min(max(16 * n - 1, 64 * WORDS).bit_length(), max(4 * budget, 1).bit_length() - 1)
    if bits < max(n, 64 * WORDS):
        return table
    bit = F.xxhash64(*on).bitwiseAND(F.lit(bits - 1))
    at, word = F.shiftright(bit, 9).alias("_at"), F.shiftright(bit, 6).bitwiseAND(F.lit(WORDS - 1)).cast("int").alias("_word")
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), bit.bitwiseAND(F.lit(63)).cast("int")).alias("_bit")
    words = asked.select(at, word, mask).groupBy("_at").agg(
        *(F.bit_or(F.when(F.col("_word") == i, F.col("_bit"))).alias(f"_b{i}") for i in range(WORDS)))
    held = F.col("_b0")
    for i in range(1, WORDS):
        held = F.when(F.col("_word") == i, F.col(f"_b{i}")).otherwise(held)
    return (table.select("*", at, word, mask).join(F.broadcast(words), "_at")
            .filter(held.bitwiseAND(F.col("_bit")) != 0).select(*table.columns))


def _pair_bytes(pairs: DataFrame) -> int:
    """Bytes of a broadcast of written pairs.  The strings are measured only if the rows alone don't exceed the budget."""
    rows = pairs.count() * ROW_OVERHEAD_BYTES
    if rows > broadcast_budget_bytes(pairs.sparkSession):
        return rows
    held = F.coalesce(F.octet_length("prev"), F.lit(0)) + F.coalesce(F.octet_length("token"), F.lit(0))
    return rows + int(pairs.agg(F.sum(held)).first()[0] or 0)


def _pair_counts(tok: DataFrame) -> DataFrame:
    """``(prev, token, c)`` over every token occurrence; prev is NULL for a first token."""
    before = F.concat(F.array(F.lit(None).cast("string")), F.slice("tokens", 1, F.greatest(F.size("tokens") - 1, F.lit(0))))
    pairs = F.arrays_zip(before.alias("prev"), F.col("tokens").alias("token"))
    return (tok.select(F.explode(pairs).alias("p"))
               .select(F.col("p.prev").alias("prev"), F.col("p.token").alias("token"))
               .filter(F.col("token").isNotNull())
               .groupBy("prev", "token").agg(F.count(F.lit(1)).alias("c")))


def fit_lm_counts(tok: DataFrame) -> CountLM:
    """G1: unigram, bigram and prefix counts of a background corpus ``(id, tokens)``.

    One pass: every token occurrence becomes a (prev, token) row (prev NULL at
    a document start); the grouped table is written once, as Parquet, and
    the unigram, bigram and prefix counts are aggregates of it.  Scoring jobs read it instead of
    re-tokenizing the background corpus.
    """
    return CountLM(store(_pair_counts(tok)))


def lm_brief_experience(lm: CountLM, tok: DataFrame, sel: DataFrame, id_col: str = ID) -> CountLM:
    """Add the counts of a selected subset's full token sequences to the model.

    Only the subset is counted and written; its rows stand beside the model's, and the tables that
    scoring asks for add them up.
    """
    sub = tok.join(sel.select(id_col), id_col, "left_semi").select("tokens")
    return CountLM(lm.pairs.unionByName(store(_pair_counts(sub))), False)


def _scored_positions(tok: DataFrame, variant: str, context: DataFrame | None,
                      id_col: str) -> DataFrame:
    """``(id, seq, start, offset, cache)``: the sequence the model reads, the first
    scored index (0-based), the index shift back to target positions, and the
    visible context (NULL = none)."""
    prompt = F.slice("tokens", 1, F.col("n_prompt").cast("int"))
    if variant == "cond":
        return tok.select(id_col, F.col("tokens").alias("seq"),
                          F.col("n_prompt").cast("int").alias("start"),
                          F.lit(0).alias("offset"), prompt.alias("cache"))
    if variant == "direct":
        n_resp = F.size("tokens") - F.col("n_prompt").cast("int")
        resp = F.when(n_resp > 0, F.slice("tokens", F.col("n_prompt").cast("int") + 1, n_resp)) \
                .otherwise(F.array().cast("array<string>"))
        return tok.select(id_col, resp.alias("seq"), F.lit(1).alias("start"),
                          F.col("n_prompt").cast("int").alias("offset"),
                          F.lit(None).cast("array<string>").alias("cache"))
    if variant == "oneshot":
        if context is None:
            raise ValueError("the oneshot variant needs a context table (example_id, context)")
        t = tok.join(context.select(id_col, "context"), id_col, "left") \
               .withColumn("context", F.coalesce("context", F.array().cast("array<string>")))
        nctx = F.size("context")
        return t.select(id_col, F.concat("context", "tokens").alias("seq"),
                        (nctx + F.col("n_prompt").cast("int")).alias("start"),
                        (-nctx).alias("offset"), F.concat("context", prompt).alias("cache"))
    raise ValueError("variant must be cond, direct or oneshot")


def _lookup(rows: DataFrame, table: DataFrame, on, size_bytes: int) -> DataFrame:
    """Left join a count table: broadcast when its measured size fits the budget,
    else sort-merge (AQE may still switch to a broadcast from real shuffle sizes)."""
    if fits_broadcast(rows.sparkSession, size_bytes):
        return rows.join(F.broadcast(table), on, "left")
    return rows.join(table.hint("merge"), on, "left")


def _scored_tokens(sp: DataFrame, id_col: str) -> DataFrame:
    """``(example_id, token, clen, start, pos, prev, prev2)`` for every scored position of :func:`_scored_positions`."""
    # Only the scored slice is exploded (prompt and context tokens never become
    # rows); the previous tokens are read from the full sequence.
    scored = F.slice("seq", F.col("start") + 1, F.greatest(F.size("seq") - F.col("start"), F.lit(0)))
    return (sp.select(id_col, "seq", "start", "offset",
                      F.coalesce(F.size("cache"), F.lit(0)).cast("double").alias("clen"),
                      F.posexplode(scored).alias("j", "token"))
              .withColumn("i", F.col("j") + F.col("start"))
              .select(id_col, "token", "clen", "start",
                      (F.col("i") + F.col("offset")).cast("long").alias("pos"),
                      F.when(F.col("i") > 0, F.element_at("seq", F.col("i"))).alias("prev"),
                      F.when(F.col("i") > 1, F.element_at("seq", F.col("i") - 1)).alias("prev2")))


def history_rows(tok: DataFrame, variant: str = "cond", context: DataFrame | None = None,
                 id_col: str = ID) -> DataFrame:
    """``(example_id, token, clen, start, pos, prev, prev2[, cc])`` for every scored position: the token, the two
    before it (NULL where there is none), the length of the visible context and the token's count in it."""
    sp = _scored_positions(tok, variant, context, id_col)
    rows = _scored_tokens(sp, id_col)
    if variant == "direct":
        return rows
    ccount = (sp.select(id_col, F.explode("cache").alias("token"))
                .groupBy(id_col, "token").agg(F.count(F.lit(1)).alias("cc")))
    return rows.join(ccount, [id_col, "token"], "left")


def _lookup_pairs(rows: DataFrame, asked: DataFrame, lm: CountLM) -> DataFrame:
    """Left join the pair counts as ``c_hw``; tables too big to broadcast are first cut to what ``asked`` can meet."""
    table, size = lm.bi, lm.bytes_bi
    if size > broadcast_budget_bytes(rows.sparkSession):
        table = store(lm.bi_of(asked, asked.count()))
        size = _pair_bytes(table)
    return _lookup(rows, table.withColumnRenamed("c", "c_hw"), ["prev", "token"], size)


def fits_broadcast(spark, size_bytes: int) -> bool:
    return size_bytes <= broadcast_budget_bytes(spark)


def scored_rows(tok: DataFrame, lm: CountLM, variant: str = "cond", context: DataFrame | None = None,
                id_col: str = ID) -> DataFrame:
    """``(example_id, token, pos, start, p_bi, p_uni[, cc, clen, p_cache])`` for every scored
    position: the count-model probabilities before mixing (``start`` = first scored index,
    ``cc``/``clen`` = count of the token in the visible context and its length)."""
    rows = history_rows(tok, variant, context, id_col).drop("prev2")
    has_cache = variant != "direct"
    # Count tables are broadcast when their measured size fits the budget.
    rows = _lookup(rows, lm.uni.select("token", F.col("c").alias("c_w")), "token", lm.bytes_uni)
    asked = _scored_tokens(_scored_positions(tok, variant, context, id_col), id_col).select("prev", "token")
    rows = _lookup_pairs(rows, asked, lm)
    rows = _lookup(rows, lm.uni.select(F.col("token").alias("prev"), "c_pre"), "prev", lm.bytes_uni) \
        .crossJoin(F.broadcast(lm.totals))
    p_uni = (F.coalesce("c_w", F.lit(0)).cast("double") + F.lit(1.0)) / (F.col("T") + F.col("V") + F.lit(1.0))
    p_bi = F.when(F.coalesce("c_pre", F.lit(0)) > 0,
                  F.coalesce("c_hw", F.lit(0)).cast("double") / F.col("c_pre").cast("double")) \
            .otherwise(p_uni)
    cols = [id_col, "token", "pos", "start", p_bi.alias("p_bi"), p_uni.alias("p_uni")]
    if has_cache:
        cols += [F.coalesce("cc", F.lit(0)).cast("double").alias("cc"), "clen",
                 F.when(F.col("clen") > 0, F.coalesce("cc", F.lit(0)).cast("double") / F.col("clen"))
                 .otherwise(F.lit(0.0)).alias("p_cache")]
    return rows.select(*cols)


def nll_with_context():
    return -F.log(F.lit(W_BI_CTX) * F.col("p_bi") + F.lit(W_UNI_CTX) * F.col("p_uni")
                  + F.lit(W_CACHE) * F.col("p_cache"))


def nll_without_context():
    return -F.log(F.lit(W_BI) * F.col("p_bi") + F.lit(W_UNI) * F.col("p_uni"))


def token_nll(tok: DataFrame, lm: CountLM, variant: str = "cond", context: DataFrame | None = None,
              id_col: str = ID) -> DataFrame:
    """``(example_id, variant, pos, nll)`` for every scored response token."""
    rows = scored_rows(tok, lm, variant, context, id_col)
    nll = nll_without_context() if variant == "direct" else nll_with_context()
    return rows.select(id_col, F.lit(variant).alias("variant"), "pos", nll.alias("nll"))


__all__ = ["CountLM", "fit_lm_counts", "lm_brief_experience", "token_nll", "scored_rows", "history_rows",
           "nll_with_context", "nll_without_context"]
