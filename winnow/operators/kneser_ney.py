"""G1, G2 of higher order: an interpolated Kneser-Ney trigram model, with a cache weighed by EM.

p3(w | u v) = (c(u v w) - d3) / c(u v .) + d3 t(u v) / c(u v .) * p2(w | v)
p2(w | v)   = (n(v w) - d2) / n(v .)     + d2 t(v) / n(v .)     * p1(w)
p1(w)       = (n(w) - d1) / n(.)         + d1 V / n(.)          * 1 / (V + 1)

c counts occurrences; n(v w) counts the different tokens before (v, w) and n(w) those before w; t is
the number of different tokens after a history.  A history that was never seen leaves the level to
the one below.  Each level's discount d is n1 / (n1 + 2 n2) of its counts of counts, or 1/2 where one of
them is zero.  The V + 1st token stands for all unknown ones, so every history's probabilities sum to 1.

A text starts behind two markers (the empty string, which no tokenizer here gives; an empty or NULL
token isn't counted and has the probability of an unknown one).

With a visible context C: p = (1 - a) p3 + a * count of w in C / |C|, the weight a fitted by EM on
tokens that the counts have not seen.

The fit is one pass over the tokens; pairs are counted where the trigrams lie, and the lowest order is an aggregate of them.  The
histories' totals are aggregates that scoring plans into its joins, so they are neither written nor shuffled twice.
Scoring is five equi-joins, each a broadcast only where the table's measured bytes allow it; the other tables are first cut
to what the scored rows can meet.  EM and the losses can share their result (:func:`scored_histories`).
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from winnow.functions.pieces import ROWS, earlier, pieces
from winnow.operators.budget import ID, score_direction, topk_by_score
from winnow.operators.lm import _lookup, fits_broadcast, history_rows, met_rows
from winnow.operators.losses import perplexity, response_loss
from winnow.operators.ranking import ROW_OVERHEAD_BYTES
from winnow.session import materialize, store

START = ""
EM_ROUNDS = 10


@dataclass
class KneserNeyLM:
    tri: DataFrame          # (prev2, prev, token, c)
    bi: DataFrame           # (prev, token, n): different tokens before the pair
    uni: DataFrame          # (token, n): different tokens before the token
    ctx2: DataFrame         # (prev2, prev, total, types)
    ctx1: DataFrame         # (prev, total, types)
    discounts: tuple[float, float, float]   # of tri, bi, uni
    total: int              # sum of uni.n
    vocabulary: int
    cache_weight: float = 0.0

    @cached_property
    def size(self) -> dict[str, int]:
        """Measured bytes of the five tables; every history is a row of its level's counts without the last token,
        so their sizes bound it."""
        b3, b2, b1 = (_measured(t, keys) for t, keys in ((self.tri, ["prev2", "prev", "token"]),
                                                         (self.bi, ["prev", "token"]), (self.uni, ["token"])))
        return {"tri": b3, "bi": b2, "uni": b1, "ctx2": b3, "ctx1": b2}


def _trigrams(batches):
    """``(prev2, prev, token, c)`` per piece of the column ``tokens``; neighbours share the pair they end in."""
    for batch in batches:
        for codes, words, text, first in pieces(batch.column(0), 2):
            words = pa.concat_arrays([pa.array([START], words.type), words])
            codes, n = codes + 1, len(words)                            # 0: a marker, or a token that isn't counted
            codes[codes == pc.index(words.slice(1), pa.scalar(START, words.type)).as_py() + 1] = 0
            w = codes[first:]
            v, u = (earlier(codes, text, first, d, 0) for d in (1, 2))
            rows = ((v * n + w) * n + u)[w > 0]
            rows.sort()
            starts = np.flatnonzero(np.diff(rows, prepend=-1))
            c = np.diff(starts, append=len(rows))
            rows = rows[starts]
            pair = rows // n
            for lo in range(0, len(rows), ROWS):
                part = slice(lo, lo + ROWS)
                yield pa.RecordBatch.from_arrays([*(words.take(pa.array(x[part])) for x in (rows % n, pair // n, pair % n)),
                                                  pa.array(c[part])], names=["prev2", "prev", "token", "c"])


def trigram_counts(tok: DataFrame) -> DataFrame:
    """``(prev2, prev, token, c)`` over every token of ``(id, tokens)``; the markers fill the first histories.

    Pieces of the corpus are counted in numpy.  Rows are dealt by their last pair, so that the pairs are counted where they lie.
    """
    return (tok.select("tokens").mapInArrow(_trigrams, "prev2 string, prev string, token string, c long")
               .repartition("prev", "token").groupBy("prev2", "prev", "token").agg(F.sum("c").alias("c")))


def _measured(table: DataFrame, keys: list[str]) -> int:
    r = table.agg(F.count(F.lit(1)).alias("rows"), F.sum(sum((F.octet_length(k) for k in keys), F.lit(0))).alias("b")).first()
    return int(r["b"] or 0) + int(r["rows"]) * ROW_OVERHEAD_BYTES


def _level(table: DataFrame, count: str) -> tuple[float, int, int]:
    """Discount, sum of the counts and rows of a count table, in one aggregate."""
    r = table.agg(F.count_if(F.col(count) == 1).alias("n1"), F.count_if(F.col(count) == 2).alias("n2"),
                  F.sum(count).alias("s"), F.count(F.lit(1)).alias("rows")).first()
    d = r["n1"] / (r["n1"] + 2 * r["n2"]) if r["n1"] and r["n2"] else 0.5
    return d, int(r["s"] or 0), int(r["rows"])


def _after2(tri: DataFrame) -> DataFrame:
    return tri.groupBy("prev2", "prev").agg(F.sum("c").alias("total"), F.count(F.lit(1)).alias("types"))


def _after1(bi: DataFrame) -> DataFrame:
    return bi.groupBy("prev").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("types"))


def fit_kneser_ney(tok: DataFrame) -> KneserNeyLM:
    """G1, order 3: the counts of a background corpus ``(id, tokens)``.

    Trigrams and pairs are one written table: the last row of a pair also holds the number of its rows.
    """
    rows = Window.partitionBy("prev", "token").orderBy("prev2")
    last = F.lead("prev2").over(rows).isNull()                          # prev2 is never NULL
    both = store(trigram_counts(tok).withColumn("n", F.when(last, F.row_number().over(rows)).cast("long")))
    tri, bi = both.drop("n"), both.filter(F.col("n").isNotNull()).select("prev", "token", "n")
    uni = store(bi.groupBy("token").agg(F.count(F.lit(1)).alias("n")))
    (d3, _, _), (d2, _, _), (d1, total, v) = _level(tri, "c"), _level(bi, "n"), _level(uni, "n")
    return KneserNeyLM(tri, bi, uni, _after2(tri), _after1(bi), (d3, d2, d1), total, v)


def _interpolate(count: str, total: str, types: str, d: float, below: Column) -> Column:
    seen = F.greatest(F.coalesce(F.col(count), F.lit(0)).cast("double") - F.lit(d), F.lit(0.0))
    return F.when(F.col(total).isNotNull(), (seen + F.lit(d) * F.col(types) * below) / F.col(total)).otherwise(below)


def kn_rows(rows: DataFrame, lm: KneserNeyLM) -> DataFrame:
    """``rows`` (prev2, prev, token and others) plus ``p``, the model's probability of the token."""
    keep = rows.columns
    marked = rows.withColumns({"prev2": F.coalesce("prev2", F.lit(START)), "prev": F.coalesce("prev", F.lit(START))})
    spark = rows.sparkSession
    tables = {"tri": lm.tri, "ctx2": lm.ctx2, "bi": lm.bi, "ctx1": lm.ctx1, "uni": lm.uni}
    if not all(fits_broadcast(spark, size) for size in lm.size.values()):
        # far fewer histories are scored than counted: the others are left out before a table is shuffled
        marked = store(marked)
        asked = marked.count()

        def met(name: str, table: DataFrame, on: list[str]) -> DataFrame:
            return table if fits_broadcast(spark, lm.size[name]) else met_rows(table, marked, on, asked)
        tables = {"tri": met("tri", lm.tri, ["prev2", "prev", "token"]), "ctx2": _after2(met("ctx2", lm.tri, ["prev2", "prev"])),
                  "bi": met("bi", lm.bi, ["prev", "token"]), "ctx1": _after1(met("ctx1", lm.bi, ["prev"])),
                  "uni": met("uni", lm.uni, ["token"])}
    r = _lookup(marked, tables["tri"].withColumnRenamed("c", "_c3"), ["prev2", "prev", "token"], lm.size["tri"])
    r = _lookup(r, tables["ctx2"].withColumnsRenamed({"total": "_t3", "types": "_k3"}), ["prev2", "prev"], lm.size["ctx2"])
    r = _lookup(r, tables["bi"].withColumnRenamed("n", "_c2"), ["prev", "token"], lm.size["bi"])
    r = _lookup(r, tables["ctx1"].withColumnsRenamed({"total": "_t2", "types": "_k2"}), "prev", lm.size["ctx1"])
    r = _lookup(r, tables["uni"].withColumnRenamed("n", "_c1"), "token", lm.size["uni"])
    d3, d2, d1 = lm.discounts
    if lm.total:
        seen = F.greatest(F.coalesce(F.col("_c1"), F.lit(0)).cast("double") - F.lit(d1), F.lit(0.0))
        p1 = (seen + F.lit(d1 * lm.vocabulary / (lm.vocabulary + 1.0))) / F.lit(float(lm.total))
    else:
        p1 = F.lit(1.0)
    p = _interpolate("_c3", "_t3", "_k3", d3, _interpolate("_c2", "_t2", "_k2", d2, p1))
    return r.select(*keep, p.alias("p"))


def _cache():
    return F.when(F.col("clen") > 0, F.coalesce("cc", F.lit(0)).cast("double") / F.col("clen")).otherwise(F.lit(0.0))


def scored_histories(tok: DataFrame, lm: KneserNeyLM, variant: str = "cond", context: DataFrame | None = None,
                     id_col: str = ID) -> DataFrame:
    """``(example_id, pos, clen, p, q)`` per scored position: the model's and the cache's probability of its token."""
    rows = kn_rows(history_rows(tok, variant, context, id_col), lm)
    return rows.select(id_col, "pos", "clen", "p", (F.lit(0.0) if variant == "direct" else _cache()).alias("q"))


def fit_cache_weight(tok: DataFrame, lm: KneserNeyLM, rounds: int = EM_ROUNDS, id_col: str = ID,
                     scored: DataFrame | None = None) -> KneserNeyLM:
    """``lm`` with the cache weight that EM finds on the scored tokens of records the counts have not seen.

    From 1/2, each round sets the weight to the mean share of the cache in a token's probability: one
    aggregate over a written table of two numbers a token.  Without a scored token that has a context it is 0.
    ``scored``: a written :func:`scored_histories` of ``tok``, in place of a new one.
    """
    both = (store(scored_histories(tok, lm, id_col=id_col)) if scored is None else scored) \
        .filter(F.col("clen") > 0).select("p", "q")
    a = 0.5
    for _ in range(rounds):
        part = F.lit(a) * F.col("q")
        a = both.agg(F.avg(part / (part + F.lit(1.0 - a) * F.col("p")))).first()[0]
        if not a:
            return replace(lm, cache_weight=0.0)
    return replace(lm, cache_weight=a)


def kn_token_nll(tok: DataFrame, lm: KneserNeyLM, variant: str = "cond", context: DataFrame | None = None,
                 id_col: str = ID, scored: DataFrame | None = None) -> DataFrame:
    """G2, order 3: ``(example_id, variant, pos, nll)``, the table that every loss of G3-G13 reads.

    The cache counts where there is a visible context; without one the model stands alone.
    ``scored``: the :func:`scored_histories` of these arguments, if there is one already.
    """
    rows = scored_histories(tok, lm, variant, context, id_col) if scored is None else scored
    p = F.col("p")
    if variant != "direct" and lm.cache_weight:
        a = lm.cache_weight
        p = F.when(F.col("clen") > 0, F.lit(1.0 - a) * p + F.lit(a) * F.col("q")).otherwise(p)
    return rows.select(id_col, F.lit(variant).alias("variant"), "pos", (-F.log(p)).alias("nll"))


def select_ppl_kn(tok: DataFrame, lm: KneserNeyLM, budget: float = 0.05, keep: str = "high",
                  id_col: str = ID, scored: DataFrame | None = None) -> DataFrame:
    """G7 on this model: perplexity, one tail; unscorable examples sink."""
    if keep not in ("high", "low"):
        raise ValueError("keep must be 'high' or 'low'")
    tok = materialize(tok)
    ppl = perplexity(response_loss(kn_token_nll(tok, lm, "cond", id_col=id_col, scored=scored), tok, id_col), id_col)
    return topk_by_score(score_direction(ppl, keep), budget, out_digits=4)


__all__ = ["KneserNeyLM", "trigram_counts", "fit_kneser_ney", "kn_rows", "scored_histories", "fit_cache_weight",
           "kn_token_nll", "select_ppl_kn"]
