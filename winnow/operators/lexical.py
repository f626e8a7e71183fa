"""Lexical scoring: tokenizers, term statistics and BM25.

BM25(q, d) = sum over distinct terms t of q of
             idf(t) * f(t,d) * (k1+1) / (f(t,d) + k1 * (1 - b + b * |d| / avgdl))
idf(t)     = ln(1 + (N - df(t) + 0.5) / (df(t) + 0.5))

The mean over a query set never forms (query, doc) pairs: it equals
sum over t of (queries containing t / Q) * idf(t) * tfnorm(t, d), so one
equi-join of the corpus' term rows with a per-term weight table does it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from winnow.functions.text import tokenize_alnum as _alnum
from winnow.functions.text import tokenize_whitespace as _ws
from winnow.operators.budget import ID, significant, topk_by_score
from winnow.operators.ranking import BROADCAST_ROWS, ROW_OVERHEAD_BYTES, broadcast_budget_bytes, join_small
from winnow.operators.sampling import query_sample
from winnow.session import materialize, store

QID = "query_id"


def tokenize_alnum(df: DataFrame, text_col: str = "text", id_col: str = ID) -> DataFrame:
    """``(id, tokens)`` with lower-cased ASCII alphanumeric runs."""
    return df.select(id_col, _alnum(text_col).alias("tokens"))


def tokenize_whitespace(df: DataFrame, text_col: str = "text", id_col: str = ID) -> DataFrame:
    """``(id, tokens)`` with lower-cased whitespace-separated tokens."""
    return df.select(id_col, _ws(text_col).alias("tokens"))


def term_frequency(tok: DataFrame, id_col: str = ID) -> DataFrame:
    """``(id, term, tf)``; partial aggregation collapses a doc's repeats map-side."""
    return (tok.select(id_col, F.explode("tokens").alias("term"))
               .groupBy(id_col, "term").agg(F.count(F.lit(1)).alias("tf")))


def doc_lengths(tok: DataFrame, id_col: str = ID) -> DataFrame:
    return tok.select(id_col, F.size("tokens").cast("long").alias("dl"))


def doc_length_stats(tok: DataFrame, id_col: str = ID) -> DataFrame:
    """One row ``(n_docs, avgdl)``; empty docs count with length 0."""
    return (doc_lengths(tok, id_col)
            .agg(F.count(F.lit(1)).alias("n_docs"), F.avg("dl").alias("avgdl")))


def idf_expr(n, df):
    return F.log(F.lit(1.0) + (n - df + F.lit(0.5)) / (df + F.lit(0.5)))


def inverse_doc_frequency(tf: DataFrame, stats: DataFrame) -> DataFrame:
    """E5: ``(term, df, idf)`` from a tf table and the one-row stats."""
    dfreq = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return (dfreq.crossJoin(stats.select("n_docs"))
                 .select("term", "df", idf_expr(F.col("n_docs"), F.col("df")).alias("idf")))


def _tfnorm(k1: float, b: float):
    tf = F.col("tf").cast("double")
    ratio = F.try_divide(F.col("dl").cast("double"), F.col("avgdl"))
    return tf * F.lit(k1 + 1.0) / (tf + F.lit(k1) * (F.lit(1.0 - b) + F.lit(b) * ratio))


def _query_terms(query_tok: DataFrame, qid: str = QID) -> DataFrame:
    """``(query_id, term)``: distinct terms per query (query tf is ignored)."""
    return query_tok.select(qid, F.explode(F.array_distinct("tokens")).alias("term"))


def _doc_term_table(corpus_tok: DataFrame, vocab: DataFrame | None, vocab_rows: int = 0,
                    id_col: str = ID) -> DataFrame:
    """``(id, dl, term, tf)`` for terms in ``vocab`` (None: all) plus one row per doc with term NULL.

    The NULL row keeps every doc (N, avgdl, zero scores) in the same table, so
    the corpus is tokenized once; the table is written (as Parquet) because
    three branches (stats, df, scores) read it.
    """
    rows = corpus_tok.select(
        id_col, F.size("tokens").cast("long").alias("dl"),
        F.explode(F.concat(F.col("tokens"), F.array(F.lit(None).cast("string")))).alias("term"))
    if vocab is not None:
        marks = vocab.select("term", F.lit(True).alias("_in_vocab"))
        rows = (join_small(rows, marks, "term", vocab_rows, "left")
                    .filter(F.col("term").isNull() | F.col("_in_vocab").isNotNull()))
    return store(rows.groupBy(id_col, "dl", "term").agg(F.count(F.lit(1)).alias("tf")))


def _weighted_terms(dt: DataFrame, id_col: str = ID):
    stats = (dt.filter(F.col("term").isNull())
               .agg(F.count(F.lit(1)).alias("n_docs"), F.avg("dl").alias("avgdl")))
    dfreq = dt.filter(F.col("term").isNotNull()).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return stats, dfreq


def bm25_pairs(corpus_tok: DataFrame, query_tok: DataFrame, k1: float = 1.5, b: float = 0.75,
               id_col: str = ID, qid: str = QID, n: int | None = None) -> DataFrame:
    """``(query_id, example_id, score)`` for every pair sharing a term, or the ``n`` best
    documents of each query (ties to the lower id, by ten significant digits).

    Each document is scored against postings of the queries (:class:`QueryBlock`), block by
    block; with ``n`` a task keeps the best of its own documents only.
    """
    per_doc, blocks = _postings_inputs(corpus_tok, query_tok, k1, b, id_col, qid)
    schema = f"{qid} long, {id_col} long, score double"
    out = None
    for block in blocks:
        part = per_doc.mapInPandas(_pair_scorer(per_doc.sparkSession.sparkContext.broadcast(block), id_col, qid, n), schema)
        out = part if out is None else out.unionByName(part)
    if out is None:
        return per_doc.sparkSession.createDataFrame([], schema)
    if n is None:
        return out
    first = Window.partitionBy(qid).orderBy(F.desc(significant(F.col("score"))), F.asc(id_col))
    return out.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= n).drop("_r")


def _bm25_pairs_join(corpus_tok: DataFrame, query_tok: DataFrame, k1: float, b: float,
                     id_col: str, qid: str) -> DataFrame:
    """E6 as a term join (query postings salted or broadcast), then a sum per pair."""
    qt = _query_terms(query_tok, qid)
    vocab = qt.select("term").distinct()
    nv = vocab.count()
    dt = _doc_term_table(corpus_tok, vocab, nv, id_col)
    stats, dfreq = _weighted_terms(dt, id_col)
    idf = (dfreq.crossJoin(stats)
                .select("term", idf_expr(F.col("n_docs"), F.col("df")).alias("idf"), "avgdl"))
    hits = join_small(dt.filter(F.col("term").isNotNull()), idf, "term", nv)
    per_term = hits.select(id_col, "term", (F.col("idf") * _tfnorm(k1, b)).alias("w"))
    return (join_small(per_term, qt, "term", qt.count())
                    .groupBy(qid, id_col).agg(F.sum("w").alias("score")))


def _common_terms(weights: DataFrame, limit_rows: int, limit_bytes: int) -> int:
    """The least ``df`` from which on the terms fit a broadcast: found over powers of two, one small row each."""
    size = F.octet_length("term") + F.lit(ROW_OVERHEAD_BYTES)
    sizes = weights.groupBy((F.length(F.bin("df")) - 1).alias("e")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(size).alias("b")).collect()
    least, n, b = 2 ** 62, 0, 0
    for r in sorted(sizes, key=lambda r: -r["e"]):
        n, b = n + r["n"], b + r["b"]
        if n > limit_rows or b > limit_bytes:
            break
        least = 2 ** r["e"]
    return least


def _summed_weights(dt: DataFrame, weights: DataFrame, k1: float, b: float, id_col: str, limit_rows: int | None = None,
                    limit_bytes: int | None = None) -> DataFrame:
    """``(id, score)``: sum of ``w * tfnorm`` over a document's terms that have a weight, 0.0 if none has.

    The most common terms of ``weights (term, df, avgdl, w)`` are broadcast, so their rows are added up where they are
    read; the rows of the others, of which no term has many, go through a plain join.
    """
    least = _common_terms(weights, BROADCAST_ROWS if limit_rows is None else limit_rows,
                          broadcast_budget_bytes(dt.sparkSession) if limit_bytes is None else limit_bytes)
    part = F.coalesce(F.col("w") * _tfnorm(k1, b), F.lit(0.0))
    common = F.broadcast(weights.where(F.col("df") >= least).drop("df"))
    out = dt.join(common, "term", "left").groupBy(id_col).agg(F.sum(part).alias("score"))
    rare = weights.where(F.col("df") < least).drop("df")
    if not rare.limit(1).count():
        return out
    rest = dt.where(F.col("term").isNotNull()).join(common, "term", "left_anti")
    more = rest.join(rare.hint("merge"), "term").groupBy(id_col).agg(F.sum(part).alias("score"))
    return out.unionByName(more).groupBy(id_col).agg(F.sum("score").alias("score"))


def bm25_mean(corpus_tok: DataFrame, query_tok: DataFrame, k1: float = 1.5, b: float = 0.75,
              id_col: str = ID, qid: str = QID, covered: bool = False) -> DataFrame:
    """Mean BM25 over the query set for every corpus row (0.0 when nothing matches).

    ``covered``: every term of the corpus is in some query, so no row needs to be looked up in the vocabulary.
    """
    qt = _query_terms(query_tok, qid)
    n_queries = query_tok.agg(F.count(F.lit(1)).alias("n_queries"))
    qn = store(qt.groupBy("term").agg(F.count(F.lit(1)).alias("qn")))
    dt = _doc_term_table(corpus_tok, None if covered else qn, 0 if covered else qn.count(), id_col)
    stats, dfreq = _weighted_terms(dt, id_col)
    weights = store(dfreq.join(qn, "term").crossJoin(stats).crossJoin(n_queries)
                         .select("term", "df", "avgdl",
                                 (idf_expr(F.col("n_docs"), F.col("df")) * F.col("qn")
                                  / F.col("n_queries")).alias("w")))
    return _summed_weights(dt, weights, k1, b, id_col)


# Driver and worker bytes per (query, term) entry of a block: ids, offsets and sorting.
ENTRY_BYTES = 64
# Postings added up before the bound is looked at again (doubled each time).
FIRST_POSTINGS = 1024
# Buffered pairs of a task that keeps the n best per query.
PAIR_BUFFER = 500_000


class QueryBlock:
    """Postings of some queries: per 64-bit term hash the queries that have the term."""

    def __init__(self, query: np.ndarray, term: np.ndarray):
        order = np.lexsort((query, term))
        query, term = query[order], term[order]
        self.qids, q = np.unique(query, return_inverse=True)
        self.queries = q.astype(np.int32)
        self.terms, first = np.unique(term, return_index=True)
        self.first = np.append(first, len(term))

    def _hits(self, terms: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        ok = self.terms[at] == terms
        return at[ok], weights[ok]

    def _added(self, at: np.ndarray, weights: np.ndarray) -> np.ndarray:
        size = self.first[at + 1] - self.first[at]
        ends = np.cumsum(size)
        place = np.arange(ends[-1]) + np.repeat(self.first[at] - ends + size, size)
        return np.bincount(self.queries[place], np.repeat(weights, size), minlength=len(self.qids))

    def scores(self, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """A document's score for every query of the block."""
        at, w = self._hits(terms, weights)
        return self._added(at, w) if len(at) else np.zeros(len(self.qids))

    def best(self, terms: np.ndarray, weights: np.ndarray) -> float:
        """A document's highest score over the block's queries (0 without a common term), by MaxScore.

        Terms come by falling weight.  Once the weights to come can't lift an unseen query over
        the best one, their lists are looked up for the queries that still can win, not read.
        """
        at, w = self._hits(terms, weights)
        if not len(at):
            return 0.0
        order = np.argsort(-w, kind="stable")
        at, w = at[order], w[order]
        upto = np.cumsum(self.first[at + 1] - self.first[at])
        rest = np.append(np.cumsum(w[::-1])[::-1], 0.0)
        sums, top, i, many = np.zeros(len(self.qids)), 0.0, 0, FIRST_POSTINGS
        while i < len(w) and rest[i] > top:
            j = max(i + 1, int(np.searchsorted(upto, (upto[i - 1] if i else 0) + many, "right")))
            sums += self._added(at[i:j], w[i:j])
            top, i, many = float(sums.max()), j, 2 * many
        if i == len(w):
            return top
        can = np.flatnonzero(sums + rest[i] >= top)
        if len(can) * (len(w) - i) >= upto[-1] - upto[i - 1]:
            return float((sums + self._added(at[i:], w[i:]))[can].max())
        for t, x in zip(at[i:], w[i:]):
            own = self.queries[self.first[t]:self.first[t + 1]]
            place = np.minimum(np.searchsorted(own, can), len(own) - 1)
            sums[can[own[place] == can]] += x
        return float(sums[can].max())


def _rows_of(pdf: pd.DataFrame):
    return zip(pdf["terms"], pdf["w"])


def _best_scorer(block, id_col: str):
    def run(batches):
        b = block.value
        for pdf in batches:
            yield pd.DataFrame({id_col: pdf[id_col].to_numpy(), "score": [
                b.best(np.asarray(t, np.int64), np.asarray(w, np.float64)) for t, w in _rows_of(pdf)]})
    return run


def _n_best(found: list, n: int) -> list:
    """The pairs (q, id, score) that may be among the n best of their query: ties within float noise stay."""
    q, ids, score = (np.concatenate(c) for c in zip(*found))
    order = np.lexsort((ids, -score, q))
    q, ids, score = q[order], ids[order], score[order]
    first = np.flatnonzero(np.diff(q, prepend=-1))
    size = np.diff(first, append=len(q))
    last = np.repeat(score[first + np.minimum(size, n) - 1], size)
    keep = score >= last * (1 - 1e-9)
    return [(q[keep], ids[keep], score[keep])]


def _pair_scorer(block, id_col: str, qid: str, n: int | None):
    def frame(b, q, ids, score):
        return pd.DataFrame({qid: b.qids[q], id_col: ids, "score": score})

    def run(batches):
        b, found, held, limit = block.value, [], 0, PAIR_BUFFER
        for pdf in batches:
            for key, (t, w) in zip(pdf[id_col].to_numpy(), _rows_of(pdf)):
                s = b.scores(np.asarray(t, np.int64), np.asarray(w, np.float64))
                q = np.flatnonzero(s)
                if len(q):
                    found.append((q, np.full(len(q), key), s[q]))
                    held += len(q)
                if held >= limit and n is None:
                    yield frame(b, *(np.concatenate(c) for c in zip(*found)))
                    found, held = [], 0
                elif held >= limit:
                    found = _n_best(found, n)
                    held = len(found[0][0])
                    limit = max(PAIR_BUFFER, 2 * held)
        if found:
            found = found if n is None else _n_best(found, n)
            yield frame(b, *(np.concatenate(c) for c in zip(*found)))
    return run


def _postings_inputs(corpus_tok: DataFrame, query_tok: DataFrame, k1: float, b: float, id_col: str, qid: str):
    """``(id, terms[], w[])`` per document (term hashes with their weights), and the query blocks.

    A block's entries take at most the broadcast budget on the driver and in a worker; more
    queries make more blocks, which are scored one after the other.
    """
    spark = corpus_tok.sparkSession
    qt = _query_terms(query_tok, qid)
    vocab = qt.select("term").distinct()
    nv = vocab.count()
    entries = materialize(qt.select(F.col(qid).cast("long").alias("q"), F.xxhash64("term").alias("t")))
    many = max(1, -(-entries.count() * ENTRY_BYTES // broadcast_budget_bytes(spark)))
    dt = _doc_term_table(corpus_tok, vocab, nv, id_col)
    stats, dfreq = _weighted_terms(dt, id_col)
    idf = (dfreq.crossJoin(stats)
                .select("term", idf_expr(F.col("n_docs"), F.col("df")).alias("idf"), "avgdl"))
    hits = join_small(dt, idf, "term", nv, "left")
    known = F.col("idf").isNotNull()
    per_doc = hits.groupBy(id_col).agg(
        F.collect_list(F.when(known, F.xxhash64("term"))).alias("terms"),
        F.collect_list(F.when(known, F.col("idf") * _tfnorm(k1, b))).alias("w"))
    if many > 1:
        per_doc = materialize(per_doc)

    def blocks():
        for k in range(many):
            e = entries.where(F.pmod(F.xxhash64("q"), F.lit(many)) == k).toPandas()
            if len(e):
                yield QueryBlock(e["q"].to_numpy(), e["t"].to_numpy())
    return per_doc, blocks()


def bm25_max(corpus_tok: DataFrame, query_tok: DataFrame, k1: float = 1.5, b: float = 0.75,
             id_col: str = ID, qid: str = QID) -> DataFrame:
    """Max BM25 over the query set; 0.0 floor (scores are non-negative).

    The queries become postings in blocks of bounded bytes; a document's best score per block
    is found by MaxScore (:meth:`QueryBlock.best`), so no (query, document) pairs are formed
    and long lists of light terms are mostly not read.
    """
    per_doc, blocks = _postings_inputs(corpus_tok, query_tok, k1, b, id_col, qid)
    schema, parts = f"{id_col} long, score double", []
    for block in blocks:
        run = _best_scorer(per_doc.sparkSession.sparkContext.broadcast(block), id_col)
        parts.append(per_doc.mapInPandas(run, schema))
    if not parts:
        return per_doc.select(id_col, F.lit(0.0).alias("score"))
    if len(parts) == 1:
        return parts[0]
    parts = [materialize(p) for p in parts]                    # one pass and one broadcast at a time
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy(id_col).agg(F.max("score").alias("score"))


def bm25_self(corpus_tok: DataFrame, max_queries: int | None = None, seed: int = 42,
              k1: float = 1.5, b: float = 0.75, aggregation: str = "mean",
              id_col: str = ID) -> DataFrame:
    """No target set -> the corpus itself serves as queries, or a hash-drawn sample of
    ``max_queries`` rows.  The mean costs the same for any number of queries; the max is
    quadratic over the whole corpus."""
    queries = corpus_tok.select(F.col(id_col).alias(QID), "tokens")
    if max_queries is not None:
        qids = query_sample(corpus_tok, max_queries, seed, id_col)
        queries = queries.join(qids.withColumnRenamed(id_col, QID), QID, "left_semi")
    if aggregation == "mean":
        return bm25_mean(corpus_tok, queries, k1, b, id_col, covered=max_queries is None)
    return bm25_max(corpus_tok, queries, k1, b, id_col)


def select_bm25(ex: DataFrame, val: DataFrame | None = None, budget: float = 0.05,
                k1: float = 1.5, b: float = 0.75, aggregation: str = "mean",
                max_queries: int | None = None, seed: int = 42, text_col: str = "text",
                id_col: str = ID) -> DataFrame:
    """BM25 relevance of each example to the target set, then the top budget."""
    if text_col not in ex.columns:
        raise ValueError(f"BM25 needs a {text_col!r} column on the examples")
    if aggregation not in ("mean", "max"):
        raise ValueError("aggregation must be 'mean' or 'max'")
    if max_queries is not None and max_queries <= 0:
        raise ValueError("max_queries must be positive")
    corpus = tokenize_alnum(ex, text_col, id_col)
    n = ex.count()
    if val is not None and text_col in val.columns and val.limit(1).count() > 0:
        vid = id_col if id_col in val.columns else val.columns[0]
        queries = val.select(F.col(vid).alias(QID), _alnum(text_col).alias("tokens"))
        fn = bm25_mean if aggregation == "mean" else bm25_max
        scores = fn(corpus, queries, k1, b, id_col)
    else:
        scores = bm25_self(corpus, max_queries, seed, k1, b, aggregation, id_col)
    return topk_by_score(scores, budget, n)


def bm25_anchor(ex: DataFrame, anchors: DataFrame, k1: float = 1.5, b: float = 0.75,
                text_col: str = "text", id_col: str = ID, anchor_id: str = "anchor_id") -> DataFrame:
    """Roles swapped -- statistics from the anchor set, each example is a query.

    score(x) = mean over anchors v of BM25(x, v) with corpus = anchors,
    whitespace tokens, and a zero mean anchor length replaced by 1.
    Factorised: sum over distinct terms t of x of W(t), where
    W(t) = (1/Na) * sum over anchors v containing t of idf(t) * tfnorm(t, v).
    The W table has one row per anchor term (small); examples join it.
    """
    atok = anchors.select(F.col(anchor_id), _ws(text_col).alias("tokens"))
    stats = (atok.agg(F.count(F.lit(1)).alias("n_raw"), F.sum(F.size("tokens")).alias("len_sum"))
                 .select(F.greatest(F.col("n_raw"), F.lit(1)).cast("double").alias("n_a"),
                         F.col("n_raw"),
                         F.coalesce(F.col("len_sum"), F.lit(0)).cast("double").alias("len_sum")))
    stats = stats.select("n_a", F.when((F.col("len_sum") / F.col("n_a")) == 0, F.lit(1.0))
                         .otherwise(F.col("len_sum") / F.col("n_a")).alias("avgdl"))
    atf = (atok.select(anchor_id, F.size("tokens").cast("long").alias("dl"),
                       F.explode("tokens").alias("term"))
               .groupBy(anchor_id, "dl", "term").agg(F.count(F.lit(1)).alias("tf")))
    adf = atf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    w = (atf.join(adf, "term").crossJoin(stats)
            .select("term", (idf_expr(F.col("n_a"), F.col("df")) * _tfnorm(k1, b)
                             / F.col("n_a")).alias("w"))
            .groupBy("term").agg(F.sum("w").alias("w")))
    nw = w.count()
    xterms = ex.select(id_col, F.explode_outer(F.array_distinct(_ws(text_col))).alias("term"))
    scored = join_small(xterms, w, "term", nw, "left")
    return scored.groupBy(id_col).agg(F.coalesce(F.sum("w"), F.lit(0.0)).alias("score"))


def standardize(scores: DataFrame, eps: float = 1e-8, score_col: str = "score") -> DataFrame:
    """``(s - mean) / (std_samp + eps)`` over all rows."""
    st = scores.agg(F.avg(score_col).alias("_mu"), F.stddev_samp(score_col).alias("_sd"))
    return (scores.crossJoin(st)
                  .withColumn(score_col, (F.col(score_col) - F.col("_mu")) / (F.col("_sd") + F.lit(eps)))
                  .drop("_mu", "_sd"))
