"""Named selection methods and the user-extension surface (K1-K3).

``run_selection(ex, val, method=..., budget=...)`` dispatches over a plain dict
of DataFrame functions; users add their own with ``register_selector`` (a
function returning ``(example_id, score)``) or ``register_scorer`` (a pandas
function run with ``mapInPandas``, the slot for a real model).
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame

from winnow.operators import influence as inf
from winnow.operators import lexical as lex
from winnow.operators import losses as ls
from winnow.operators import lm as lmod
from winnow.operators import records as rec
from winnow.operators import sampling as smp
from winnow.operators import vectors as vec
from winnow.operators.budget import ID, select_all, topk_by_score
from winnow.session import materialize


def _vecs(df: DataFrame, id_col: str = ID, token_vecs: DataFrame | None = None) -> DataFrame:
    if "vec" in df.columns:
        return df.select(id_col, "vec")
    return vec.encode_mean_pool(lex.tokenize_whitespace(df, "text", id_col), id_col=id_col, token_vecs=token_vecs)


def _lm_and_tokens(ex: DataFrame, max_length, lm, background):
    """Token masks of ``ex`` and the language model: the given one, else fitted on ``background`` or ``ex``."""
    tok = rec.tokenize_mask(ex, max_length)
    if lm is None:
        bg = lex.tokenize_whitespace(background) if background is not None else \
            tok.select(ID, "tokens")
        lm = lmod.fit_lm_counts(bg)
    return tok, lm


def _random(ex, val, budget, *, seed=42):
    return smp.select_random(ex, budget, seed)


def _bm25(ex, val, budget, **o):
    return lex.select_bm25(ex, val, budget, **o)


def _embedding(ex, val, budget, *, keep="near", token_vecs=None):
    val_vecs = _vecs(val, token_vecs=token_vecs) if val is not None else None
    return vec.select_embedding(_vecs(ex, token_vecs=token_vecs), val_vecs, budget, keep)


def _ppl(ex, val, budget, *, keep="high", max_length=None, lm=None, background=None):
    tok, lm = _lm_and_tokens(ex, max_length, lm, background)
    return ls.select_ppl(tok, lm, budget, keep)


def _ifd(ex, val, budget, *, ifd_max=1.0, max_length=None, lm=None, background=None):
    tok, lm = _lm_and_tokens(ex, max_length, lm, background)
    return ls.select_ifd(tok, lm, budget, ifd_max)


def _miwv(ex, val, budget, *, max_length=None, lm=None, background=None):
    tok, lm = _lm_and_tokens(ex, max_length, lm, background)
    vecs = vec.encode_mean_pool(lex.tokenize_whitespace(tok.select(ID, "text")))
    return ls.select_miwv(tok, vecs, lm, budget, max_length)


def _less(ex, val, budget, **o):
    return inf.select_less(ex, val, budget, **o)


def _adapt(ex, val, budget):
    if val is None or not val.take(1):
        raise ValueError("method 'adapt' weighs examples against anchors: val must hold at least one row")
    return select_all(ex)


SELECTORS: dict[str, Callable[..., DataFrame]] = {
    "random": _random, "bm25": _bm25, "embedding": _embedding, "ppl": _ppl, "ifd": _ifd,
    "miwv": _miwv, "less": _less, "adapt": _adapt,
}
SCORERS: dict[str, tuple[Callable, str]] = {}


def run_selection(ex: DataFrame, val: DataFrame | None = None, method: str = "bm25",
                  budget: float = 0.05, **opts) -> DataFrame:
    """K1: named method + options -> selected ids (``example_id`` [, score]).

    An option that the method doesn't have raises ``TypeError``.
    """
    if method not in SELECTORS:
        raise ValueError(f"no method is called {method!r}; there are {', '.join(sorted(SELECTORS))}")
    return SELECTORS[method](ex, val, budget, **opts)


def register_selector(name: str, fn: Callable[..., DataFrame], scores: bool = True) -> None:
    """K2: add a user selector.  With ``scores=True`` ``fn(ex, val, **opts)`` returns
    ``(example_id, score)`` and the budgeted top-k is applied; otherwise ``fn(ex, val,
    budget, **opts)`` returns the selection itself."""
    if scores:
        def wrapped(ex, val, budget, **o):
            return topk_by_score(fn(ex, val, **o), budget)
        SELECTORS[name] = wrapped
    else:
        SELECTORS[name] = fn


def register_scorer(name: str, fn: Callable, schema: str) -> None:
    """K3: a pandas scorer ``fn(pdf) -> pdf`` with ``example_id``, ``score`` (and
    optionally ``vec``); it runs batch-wise via ``mapInPandas``."""
    SCORERS[name] = (fn, schema)

    def as_selector(ex, val, budget, **o):
        return topk_by_score(score_with(name, ex).select(ID, "score"), budget)
    SELECTORS[name] = as_selector


def score_with(name: str, ex: DataFrame) -> DataFrame:
    """Run a registered scorer over ``ex`` (Arrow batches, one task per partition)."""
    fn, schema = SCORERS[name]

    def run(batches):
        for pdf in batches:
            yield fn(pdf)
    return ex.mapInPandas(run, schema)


def ppl_scores(ex: DataFrame, max_length=None, lm=None, background=None) -> DataFrame:
    """Perplexity of every record's response as a scorer."""
    tok, lm = _lm_and_tokens(ex, max_length, lm, background)
    tok = materialize(tok)
    return ls.perplexity(ls.response_loss(lmod.token_nll(tok, lm, "cond"), tok))


def named_scores(ex: DataFrame, val: DataFrame | None, scorer: str, **opts):
    """A scorer by name -> ``(scores, vecs or None)``; vecs when the scorer exposes features."""
    if scorer == "bm25":
        corpus = lex.tokenize_alnum(ex)
        if val is None:
            return lex.bm25_self(corpus, **opts), None
        vid = val.columns[0]
        queries = lex.tokenize_alnum(val, id_col=vid).withColumnRenamed(vid, lex.QID)
        return lex.bm25_mean(corpus, queries, **opts), None
    if scorer == "embedding":
        vecs = _vecs(ex)
        ref = _vecs(val, val.columns[0]).withColumnRenamed(val.columns[0], ID) if val is not None else None
        return vec.cosine_to_centroid(vecs, ref), vecs
    if scorer == "ppl":
        return ppl_scores(ex, **opts), None
    if scorer in SCORERS:
        out = score_with(scorer, ex)
        return out.select(ID, "score"), (out.select(ID, "vec") if "vec" in out.columns else None)
    raise ValueError(f"no scorer is called {scorer!r}; there are bm25, embedding, ppl, {', '.join(sorted(SCORERS))}")


def compose(ex: DataFrame, val: DataFrame | None, scorer: str, policy: str, budget: float = 0.05,
            scorer_options: dict | None = None, **opts) -> DataFrame:
    """Any scorer x any policy (topk | hard | reweight | diversity); ``opts`` are the policy's."""
    from winnow.operators.policies import compose_scorer_policy
    scores, vecs = named_scores(ex, val, scorer, **(scorer_options or {}))
    return compose_scorer_policy(scores, policy, budget, vecs=vecs, **opts)


__all__ = ["run_selection", "register_selector", "register_scorer", "score_with", "SELECTORS",
           "named_scores", "compose"]
