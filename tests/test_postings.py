"""Query postings with MaxScore against the term join."""

import random

import numpy as np
import pytest

from winnow.operators import lexical as lex

WORDS = [f"t{k}" for k in range(60)]


def _tables(spark, docs=120, queries=40, seed=1):
    rng = random.Random(seed)
    common = WORDS[:6] * 8 + WORDS
    d = [(i, rng.choices(common, k=rng.randint(0, 80))) for i in range(docs)] + [(docs, None), (docs + 1, ["t1"] * 5)]
    q = [(1000 + i, rng.choices(common, k=rng.randint(0, 12))) for i in range(queries)] + [(5, ["nowhere"]), (6, [])]
    return (spark.createDataFrame(d, "example_id long, tokens array<string>").repartition(3).na.fill({})
            .selectExpr("example_id", "coalesce(tokens, array()) AS tokens"),
            spark.createDataFrame(q, "query_id long, tokens array<string>"))


def _pairs(df):
    return {(r.query_id, r.example_id): r.score for r in df.collect()}


def _close(a, b):
    assert a.keys() == b.keys()
    assert all(a[k] == pytest.approx(b[k], rel=1e-12, abs=1e-15) for k in a)


@pytest.mark.parametrize("budget", [None, 4000])
def test_postings_equal_the_join(spark, monkeypatch, budget):
    if budget:                                                     # several blocks of queries
        monkeypatch.setattr(lex, "broadcast_budget_bytes", lambda s: budget)
    corpus, queries = _tables(spark)
    join = _pairs(lex._bm25_pairs_join(corpus, queries, 1.5, 0.75, "example_id", "query_id"))
    _close(_pairs(lex.bm25_pairs(corpus, queries)), join)
    best = {r.example_id: r.score for r in lex.bm25_max(corpus, queries).collect()}
    expect = {i: max([s for (_, d), s in join.items() if d == i], default=0.0) for i in range(122)}
    _close(best, expect)


@pytest.mark.parametrize("buffer", [50, 500_000])
def test_n_best_documents_per_query(spark, monkeypatch, buffer):
    monkeypatch.setattr(lex, "PAIR_BUFFER", buffer)
    corpus, queries = _tables(spark, seed=2)
    copies = corpus.unionByName(corpus.selectExpr("example_id + 500 AS example_id", "tokens"))      # exact ties
    every = _pairs(lex.bm25_pairs(copies, queries))
    got = _pairs(lex.bm25_pairs(copies, queries, n=5))
    for q in {q for q, _ in every}:
        own = sorted(((-float(f"{s:.9e}"), d) for (x, d), s in every.items() if x == q))[:5]
        assert sorted(d for x, d in got if x == q) == sorted(d for _, d in own)


def test_maxscore_reads_fewer_postings(monkeypatch):
    rng = np.random.default_rng(3)
    # light terms with long lists, heavy ones with short lists
    query = np.concatenate([np.arange(2000)] * 20 + [rng.integers(0, 2000, 30) for _ in range(40)])
    term = np.concatenate([np.full(2000, t) for t in range(20)] + [np.full(30, 100 + t) for t in range(40)])
    keep = np.unique(np.stack([query, term]), axis=1)
    block = lex.QueryBlock(*keep)
    read, added = [0], lex.QueryBlock._added
    monkeypatch.setattr(lex.QueryBlock, "_added", lambda self, at, w: (
        read.__setitem__(0, read[0] + int((self.first[at + 1] - self.first[at]).sum())), added(self, at, w))[1])
    for _ in range(30):
        terms = np.concatenate([np.arange(20), 100 + rng.permutation(40)[:12]])
        weights = np.concatenate([rng.random(20) * 0.02, 3 + rng.random(12) * 4])
        got, seen = block.best(terms, weights), read[0]
        read[0] = 0
        assert got == pytest.approx(block.scores(terms, weights).max(), rel=1e-12)
        assert seen < 0.2 * read[0]
        read[0] = 0


def test_many_queries(spark):
    rng = random.Random(4)
    words = [f"w{k}" for k in range(5000)]
    queries = spark.createDataFrame([(i, rng.choices(words, k=6)) for i in range(100_000)], "query_id long, tokens array<string>")
    corpus = spark.createDataFrame([(i, rng.choices(words, k=150)) for i in range(40)], "example_id long, tokens array<string>")
    best = {r.example_id: r.score for r in lex.bm25_max(corpus, queries).collect()}
    top = {}
    for r in lex.bm25_pairs(corpus, queries, n=3).collect():
        top.setdefault(r.query_id, []).append(r)
    assert len(best) == 40 and all(len(v) <= 3 for v in top.values())
    assert max(best.values()) == pytest.approx(max(r.score for v in top.values() for r in v), rel=1e-12)
