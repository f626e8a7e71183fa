"""Hand-computed edge cases (FIXTURES.md section 3)."""

import math

import pytest
from pyspark.sql import functions as F

from winnow.operators import budget as bud
from winnow.operators import evaluate as ev
from winnow.operators import influence as inf
from winnow.operators import lexical as lex
from winnow.operators import losses as ls
from winnow.operators import records as rec
from winnow.operators import reweight as rw
from winnow.operators import sampling as smp


def ids(df, col="example_id"):
    return sorted(r[col] for r in df.select(col).collect())


@pytest.mark.parametrize("n,budget,k", [(50, 0.05, 2), (5, 0.5, 2), (7, 0.5, 4), (10, 1, 10),
                                        (10, 2.9, 2), (10, 99, 10), (10, 0, 1)])
def test_budget_to_k(spark, n, budget, k):
    df = spark.range(n).withColumnRenamed("id", "example_id")
    assert bud.chosen_k(df, budget) == bud.chosen_k(df, budget, n) == k
    assert bud.budget_to_k(df, budget).first()["k"] == k


def _scores(spark, vals):
    return spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "example_id long, score double")


# budget 1 would mean "all rows", so k = 1, 2, 3 of 4 rows is 0.25, 0.5, 0.75.
@pytest.mark.parametrize("budget,expect", [(0.25, [1]), (0.5, [1, 2]), (0.75, [1, 2, 3])])
def test_topk_by_score(spark, budget, expect):
    s = _scores(spark, [1.0, 3.0, 3.0, 2.0])
    assert ids(bud.topk_by_score(s, budget)) == expect


def test_invalid_sink(spark):
    s = _scores(spark, [None, 0.2, None, 0.9])
    assert ids(bud.topk_by_score(s, 0.75)) == [0, 1, 3]


def test_topk_large_k_path_matches_limit(spark, monkeypatch):
    import winnow.operators.ranking as rk
    s = spark.range(3000).select(F.col("id").alias("example_id"),
                                 (F.col("id") % 17).cast("double").alias("score"))
    monkeypatch.setattr(rk, "LIMIT_K", 5000)
    small = ids(bud.topk_by_score(s, 1500))
    monkeypatch.setattr(rk, "LIMIT_K", 10)
    big = ids(bud.topk_by_score(s, 1500))
    assert small == big and len(big) == 1500


def test_alpaca_record(spark):
    df = spark.createDataFrame([(0, " a ", None, " b\n"), (1, "x", "", "  ")],
                               "example_id long, instruction string, input string, output string")
    out = rec.alpaca_record(df).collect()
    assert [(r.instruction, r.input, r.output) for r in out] == [("a", "", "b")]


def _chat(spark, turns):
    rows = [(0, i, r, t) for i, (r, t) in enumerate(turns)]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


@pytest.mark.parametrize("turns,expect", [
    ([("user", "q"), ("assistant", "r")], ("q", "", "r")),
    ([("system", "S"), ("user", "q"), ("assistant", "r")], ("System: S\n\nUser: q", "", "r")),
    ([("user", "q"), ("assistant", "r"), ("user", "t")], ("q", "", "r")),
    ([("assistant", "r")], None),
    ([("user", "q"), ("assistant", "  ")], None),
    ([("user", "q"), ("assistant", "r"), ("user", " "), ("assistant", "z")],
     ("User: q\n\nAssistant: r", "", "z")),
])
def test_chat_to_record(spark, turns, expect):
    out = rec.chat_to_record(_chat(spark, turns)).collect()
    got = (out[0].instruction, out[0].input, out[0].output) if out else None
    assert got == expect


def _sharegpt(spark, conv, instruction=None, output=None):
    return spark.createDataFrame(
        [(0, [{"from": f, "value": v} for f, v in conv], instruction, output)],
        "example_id long, conversations array<struct<from:string,value:string>>, "
        "instruction string, output string")


def test_sharegpt_first_pair(spark):
    df = _sharegpt(spark, [("gpt", "x"), ("human", "h"), ("human", "i"), ("gpt", "y")])
    r = rec.sharegpt_first_pair(df).first()
    assert (r.instruction, r.output) == ("h", "y")


def test_evol_record_no_fallback(spark):
    df = _sharegpt(spark, [("human", "h")], "i", "o")
    assert rec.evol_record(df).count() == 0


def test_tokenize_alnum(spark):
    df = spark.createDataFrame([(0, "Héllo W0rld_x, A-b")], "example_id long, text string")
    assert lex.tokenize_alnum(df).first().tokens == ["h", "llo", "w0rld", "x", "a", "b"]


def test_tokenize_whitespace_matches_python(spark):
    from winnow.functions.text import WS29
    text = "A" + WS29 + "b c D  e\n"
    df = spark.createDataFrame([(0, text)], "example_id long, text string")
    assert lex.tokenize_whitespace(df).first().tokens == text.lower().split()


def test_inverse_doc_frequency(spark):
    tok = spark.createDataFrame([(0, ["a", "b"]), (1, ["b"]), (2, ["b", "c"])],
                                "example_id long, tokens array<string>")
    got = {r.term: r.idf for r in lex.inverse_doc_frequency(lex.term_frequency(tok),
                                                            lex.doc_length_stats(tok)).collect()}
    assert math.isclose(got["a"], math.log(1 + 2.5 / 1.5))
    assert math.isclose(got["b"], math.log(1 + 0.5 / 3.5))


def test_bm25_pairs_single(spark):
    corpus = spark.createDataFrame([(0, ["a", "a", "b"])], "example_id long, tokens array<string>")
    q = spark.createDataFrame([(0, ["a", "a"])], "query_id long, tokens array<string>")
    r = lex.bm25_pairs(corpus, q).first()
    assert math.isclose(r.score, math.log(1 + 0.5 / 1.5) * 2 * 2.5 / (2 + 1.5))


def test_bm25_mean_zero_present(spark):
    corpus = spark.createDataFrame([(0, ["a", "b"]), (1, ["c"])], "example_id long, tokens array<string>")
    q = spark.createDataFrame([(0, ["a"])], "query_id long, tokens array<string>")
    got = {r.example_id: r.score for r in lex.bm25_mean(corpus, q).collect()}
    assert got[1] == 0.0 and got[0] > 0


def _tok(spark, rows):
    return spark.createDataFrame(rows, "example_id long, tokens array<string>, n_prompt long")


def test_direct_loss(spark):
    tok = _tok(spark, [(0, ["p", "r1"], 1), (1, ["p", "a", "b", "c"], 1)])
    nll = spark.createDataFrame([(1, "direct", 2, 2.0), (1, "direct", 3, 4.0)],
                                "example_id long, variant string, pos long, nll double")
    got = {r.example_id: r.loss for r in ls.direct_loss(nll, tok).collect()}
    assert got[0] is None and got[1] == 3.0


def test_ifd_score(spark):
    c = spark.createDataFrame([(0, 2.0), (1, 2.0)], "example_id long, loss double")
    d = spark.createDataFrame([(0, 4.0), (1, 0.0)], "example_id long, loss double")
    got = {r.example_id: r.score for r in ls.ifd_score(c, d).collect()}
    assert got == {0: 0.5, 1: None}


def test_select_ifd_sink(spark):
    s = _scores(spark, [0.4, 1.0, 0.9, None])
    valid = F.col("score").isNotNull() & (F.col("score") > 0) & (F.col("score") < 1.0)
    assert ids(bud.topk_by_score(bud.invalid_sink(s, valid), 0.5)) == [0, 2]


@pytest.mark.parametrize("max_length,expect", [(8, ["2", "3"]), (6, [])])
def test_one_shot_context(spark, max_length, expect):
    tok = _tok(spark, [(0, ["t"] * 6, 2), (1, ["1", "2", "3"], 1)])
    nn = spark.createDataFrame([(0, 1)], "example_id long, nn_id long")
    r = ls.one_shot_context(tok, nn, max_length).first()
    assert list(r.context) == expect


def test_sigmoid_gate(spark):
    s = _scores(spark, [0.0])
    assert rw.sigmoid_gate(s, tau=1.0).first().weight == 0.5
    assert rw.sigmoid_gate(s, tau=1.0, w_max=0.3).first().weight == 0.3


@pytest.mark.parametrize("norm,expect", [("mean", 1.75), ("sum", 3.5), ("zsum", 3.5 / 1.5)])
def test_combine_weighted_loss(spark, norm, expect):
    losses = spark.createDataFrame([(0, 0, 1.0), (1, 0, 3.0)], "example_id long, batch_id long, loss double")
    w = spark.createDataFrame([(0, 0.5), (1, 1.0)], "example_id long, weight double")
    assert math.isclose(rw.combine_weighted_loss(losses, w, norm=norm).first().loss, expect)


@pytest.mark.parametrize("lrs,expect", [([3.0, 1.0], [0.75, 0.25]), ([0.0, 0.0], [0.5, 0.5])])
def test_checkpoint_weights(spark, lrs, expect):
    ck = spark.createDataFrame([(i, x) for i, x in enumerate(lrs)], "ckpt int, lr double")
    got = [r.weight for r in inf.checkpoint_weights(ck).orderBy("ckpt").collect()]
    assert got == pytest.approx(expect)


def test_checkpoint_steps():
    assert inf.checkpoint_steps(10, 4) == [2, 5, 8, 10]


def test_adam_transform(spark):
    g = spark.createDataFrame([(0, "train", 0, [1.0])], "example_id long, split string, ckpt int, grad array<double>")
    ck = spark.createDataFrame([(0, [0.0], [0.0])], "ckpt int, exp_avg array<double>, exp_avg_sq array<double>")
    got = inf.adam_transform(g, ck).first().grad[0]
    assert math.isclose(got, 0.1 / (math.sqrt(0.001) + 1e-8), rel_tol=1e-12)


def test_cluster_round_robin(spark):
    labels = spark.createDataFrame([(0, 0), (1, 0), (2, 0), (3, 1), (4, 2), (5, 2)],
                                   "example_id long, label int")
    got = smp.cluster_round_robin(labels, 5, seed=42).groupBy("label").count().collect()
    assert {r.label: r["count"] for r in got} == {0: 2, 1: 1, 2: 2}


def test_anchor_refresh(spark):
    steps = spark.createDataFrame([(0,), (49,), (50,), (120,)], "step long")
    got = [r.version for r in rw.anchor_refresh(steps, interval=50).orderBy("step").collect()]
    assert got == [0, 0, 50, 100]


@pytest.mark.parametrize("text,expect", [("is 1,234.50. and -3.", "-3"), ("none", None), ("12..", "12")])
def test_last_number(spark, text, expect):
    df = spark.createDataFrame([(0, text)], "example_id long, text string")
    assert ev.last_number(df).first().num == expect


def test_exact_match_accuracy(spark):
    preds = spark.createDataFrame([("5", "5"), ("4", "5"), ("1", None)], "prediction string, gold string")
    r = ev.exact_match_accuracy(preds).first()
    assert r.n == 3 and math.isclose(r.accuracy, 1 / 3)


def test_mix_sources(spark):
    rows = [("a", i) for i in range(10)] + [("b", 100 + i) for i in range(5)]
    df = spark.createDataFrame(rows, "dataset string, example_id long")
    got = {r.dataset: r["count"] for r in smp.mix_sources(df, 0.5, seed=3).groupBy("dataset").count().collect()}
    assert got == {"a": 5, "b": 2}


def test_tokenizers_null_text(spark):
    df = spark.createDataFrame([(0, None)], "example_id long, text string")
    assert lex.tokenize_alnum(df).first().tokens == []
    assert lex.tokenize_whitespace(df).first().tokens == []


def test_checkpoint_weights_query_weighs_the_checkpoints_of_a_warm_up(spark, monkeypatch):
    from conftest import SF_SMALL
    from winnow.plans.queries import QUERIES
    ran = []
    monkeypatch.setattr(inf, "warmup_checkpoints", lambda *a, f=inf.warmup_checkpoints, **k: ran.append(f(*a, **k)) or ran[0])
    got = {r.ckpt: r.weight for r in QUERIES["checkpoint_weights"](spark, SF_SMALL).collect()}
    lrs = {r.ckpt: r.lr for r in ran[0].collect()}
    assert len(lrs) == 4 and got == {c: pytest.approx(lr / sum(lrs.values()), abs=1e-9) for c, lr in lrs.items()}
