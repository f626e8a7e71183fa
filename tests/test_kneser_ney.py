"""The trigram model: brute force, a distribution for every history, lower held-out perplexity, edge rows."""

import math
from collections import Counter, defaultdict

import pytest
from conftest import SF_SMALL
from pyspark.sql import functions as F

from winnow.operators import kneser_ney as kn
from winnow.operators import lexical as lex
from winnow.operators import lm as lmod
from winnow.session import materialize, read_table

TOK = "example_id long, tokens array<string>, n_prompt long"
TEXTS = ["a b a c a b", "b a b c", "c", "", "a b a b a d e", "d e d a b c a b a"]


def brute(texts):
    tri = Counter()
    for t in texts:
        w = ["", ""] + t.split()
        tri.update(zip(w, w[1:], w[2:]))
    bi = Counter((v, w) for _, v, w in tri)
    uni = Counter(w for _, w in bi)

    def discount(c):
        n1, n2 = (sum(x == k for x in c.values()) for k in (1, 2))
        return n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
    d3, d2, d1 = map(discount, (tri, bi, uni))
    after2, after1 = defaultdict(dict), defaultdict(dict)
    for (u, v, w), c in tri.items():
        after2[u, v][w] = c
    for (v, w), c in bi.items():
        after1[v][w] = c

    def p(u, v, w):
        total = sum(uni.values())
        out = (max(uni[w] - d1, 0) + d1 * len(uni) / (len(uni) + 1)) / total
        for seen, d in ((after1[v], d2), (after2[u, v], d3)):
            if seen:
                out = (max(seen.get(w, 0) - d, 0) + d * len(seen) * out) / sum(seen.values())
        return out
    return p, uni


@pytest.fixture(scope="module")
def small(spark):
    rows = [(i, t.split()) for i, t in enumerate(TEXTS)] + [(99, None)]
    return kn.fit_kneser_ney(spark.createDataFrame(rows, "id long, tokens array<string>"))


def test_against_brute_force_and_sums_to_one(spark, small):
    p, uni = brute(TEXTS)
    words = sorted(uni) + ["<unknown>"]
    histories = [("", ""), ("", "a"), ("a", "b"), ("e", "d"), ("never", "a"), ("never", "seen"), ("c", "seen")]
    rows = spark.createDataFrame([(u, v, w) for u, v in histories for w in words], "prev2 string, prev string, token string")
    got = {(r.prev2, r.prev, r.token): r.p for r in kn.kn_rows(rows, small).collect()}
    assert len(got) == len(histories) * len(words)
    for key, value in got.items():
        assert value == pytest.approx(p(*key), rel=1e-12) and value > 0
    for u, v in histories:
        assert sum(got[u, v, w] for w in words) == pytest.approx(1.0, abs=1e-12)


def test_losses_with_and_without_a_cache(spark, small):
    p, _ = brute(TEXTS)
    tok = spark.createDataFrame([(1, ["a", "b", "a", "zz"], 2), (2, ["c", "a"], 0), (3, [], 0), (4, ["a"], 1)], TOK)
    fitted = kn.fit_cache_weight(tok, small)
    pairs = [(p("a", "b", "a"), 0.5), (p("b", "a", "zz"), 0.0)]
    a = 0.5
    for _ in range(kn.EM_ROUNDS):
        a = sum(a * q / (a * q + (1 - a) * x) for x, q in pairs) / len(pairs)
    assert fitted.cache_weight == pytest.approx(a, rel=1e-12) and 0 < a < 1
    got = {(r.example_id, r.pos): r.nll for r in kn.kn_token_nll(tok, fitted).collect()}
    want = {(1, 2): (1 - a) * pairs[0][0] + a * 0.5, (1, 3): (1 - a) * pairs[1][0],
            (2, 0): p("", "", "c"), (2, 1): p("", "c", "a")}
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(-math.log(v), rel=1e-12) for k, v in want.items())
    direct = {(r.example_id, r.pos): r.nll for r in kn.kn_token_nll(tok, fitted, "direct").collect()}
    assert direct == {(1, 3): pytest.approx(-math.log(p("", "a", "zz"))), (2, 1): pytest.approx(-math.log(p("", "c", "a")))}


def test_edges(spark):
    none = kn.fit_kneser_ney(spark.createDataFrame([], "id long, tokens array<string>"))
    tok = spark.createDataFrame([(1, ["a", "b"], 1)], TOK)
    assert [r.nll for r in kn.kn_token_nll(tok, kn.fit_cache_weight(tok, none)).collect()] == [0.0]
    assert kn.fit_cache_weight(tok.limit(0), none).cache_weight == 0.0
    # an empty or NULL token isn't counted, but stands in the history as a start does
    odd = kn.fit_kneser_ney(spark.createDataFrame([(1, ["a", None, "", "b"])], "id long, tokens array<string>"))
    assert {tuple(r) for r in odd.tri.collect()} == {("", "", "a", 1), ("", "", "b", 1)}
    with pytest.raises(ValueError):
        kn.select_ppl_kn(tok, none, keep="middle")


def test_shuffled_lookups_equal_broadcasts(spark, small, monkeypatch):
    tok = spark.createDataFrame([(i, t.split(), 1) for i, t in enumerate(TEXTS)], TOK)
    one = {tuple(r) for r in kn.kn_token_nll(tok, small).collect()}
    monkeypatch.setattr(lmod, "broadcast_budget_bytes", lambda spark: 0)
    df = kn.kn_token_nll(tok, small)
    assert {tuple(r) for r in df.collect()} == one


def test_held_out_perplexity_is_below_the_bigram_mix(spark):
    docs = lex.tokenize_whitespace(read_table(spark, SF_SMALL, "documents").select(
        F.col("doc_id").alias("example_id"), "text"))
    held = F.crc32(F.col("example_id").cast("string").cast("binary")) % 5 == 0
    train = materialize(docs.filter(~held).dropDuplicates(["tokens"]))
    test = materialize(docs.filter(held).join(train.select("tokens"), "tokens", "left_anti")
                       .select("example_id", "tokens", F.lit(0).cast("long").alias("n_prompt")))

    def ppl(nll):
        return math.exp(nll.agg(F.avg("nll")).first()[0])
    old = ppl(lmod.token_nll(test, lmod.fit_lm_counts(train), "direct"))
    new = ppl(kn.kn_token_nll(test, kn.fit_kneser_ney(train), "direct"))
    print("held-out perplexity", old, new)
    assert new < old


def test_one_lookup_serves_em_and_losses_and_tables_are_columns(spark, small, monkeypatch):
    tok = spark.createDataFrame([(i, t.split(), 1) for i, t in enumerate(TEXTS)], TOK)
    fitted = kn.fit_cache_weight(tok, small)
    assert 0 < fitted.cache_weight < 1
    want = {tuple(r) for r in kn.kn_token_nll(tok, fitted).collect()}
    scored = materialize(kn.scored_histories(tok, small))
    monkeypatch.setattr(kn, "kn_rows", None)                                # no second lookup
    assert kn.fit_cache_weight(tok, small, scored=scored).cache_weight == pytest.approx(fitted.cache_weight, rel=1e-12)
    assert {tuple(r) for r in kn.kn_token_nll(tok, fitted, scored=scored).collect()} == want
    # what is written is written as Parquet; the histories' totals are not written
    assert all(f.endswith(".parquet") for t in (small.tri, small.bi, small.uni) for f in t.inputFiles())
    assert set(small.ctx2.inputFiles()) == set(small.tri.inputFiles())


def test_trigrams_of_pieces(monkeypatch):
    """counted in numpy; a piece begins in the middle of a text, and odd tokens stand in a history as a start does."""
    import pyarrow as pa

    from winnow.functions import pieces as pc
    monkeypatch.setattr(pc, "PIECE", 3)
    lists = [t.split() for t in TEXTS] + [None, ["a", None, "", "b"], ["x"], []]
    batch = pa.RecordBatch.from_arrays([pa.array(lists, pa.list_(pa.string()))], names=["tokens"])
    got = Counter()
    for b in kn._trigrams(iter([batch])):
        for u, v, w, c in zip(*(x.to_pylist() for x in b.columns)):
            got[u, v, w] += c
    want = Counter()
    for ws in lists:
        w = ["", "", *(x or "" for x in ws or [])]
        want.update(t for t in zip(w, w[1:], w[2:]) if t[2])
    assert got == want


def test_pairs_lie_in_the_trigram_table_and_scoring_cuts_it(spark, monkeypatch):
    """the counts were shuffled a second time for the pairs, and whole for each of five joins."""
    words = [f"w{i % 97}x{i * i % 61}" for i in range(4000)]
    model = kn.fit_kneser_ney(spark.createDataFrame([(i, words[k:k + 40]) for i, k in enumerate(range(0, 4000, 40))],
                                                    "id long, tokens array<string>"))
    assert set(model.bi.inputFiles()) == set(model.tri.inputFiles())
    pairs = Counter((r.prev, r.token) for r in model.tri.collect())
    assert {(r.prev, r.token): r.n for r in model.bi.collect()} == pairs
    tok = spark.createDataFrame([(1, words[:9], 3), (2, ["a", None, "new", words[5], words[6], words[7]], 1), (3, ["a"], 1),
                                 (4, [words[9], "", words[10]], 0)], TOK)
    want = sorted(map(tuple, kn.kn_token_nll(tok, model).collect()))
    cut, met = {}, kn.met_rows

    def watched(table, asked, on, n):
        few = met(table, asked, on, n)
        cut[tuple(on)] = (few.count(), table.count())
        return few
    monkeypatch.setattr(kn, "met_rows", watched)
    monkeypatch.setattr(lmod, "broadcast_budget_bytes", lambda spark: 2048)
    assert sorted(map(tuple, kn.kn_token_nll(tok, model).collect())) == want
    assert len(cut) == 5 and all(few < whole / 3 for few, whole in cut.values())
