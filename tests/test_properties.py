"""Properties and brute-force checks written from the formulas."""

import hashlib
import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from winnow.functions.text import tokenize_alnum as alnum
from winnow.operators import influence as inf
from winnow.operators import lexical as lex
from winnow.operators import policies as pol
from winnow.operators import vectors as vec
from winnow.sources import tables as tb


def _bm25_brute(docs, queries, k1=1.5, b=0.75):
    n = len(docs)
    avgdl = sum(len(d) for d in docs) / n
    df = {}
    for d in docs:
        for t in set(d):
            df[t] = df.get(t, 0) + 1
    out = np.zeros((len(queries), n))
    for qi, q in enumerate(queries):
        for t in set(q):
            if t not in df:
                continue
            idf = math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5))
            for di, d in enumerate(docs):
                f = d.count(t)
                if f:
                    out[qi, di] += idf * f * (k1 + 1) / (f + k1 * (1 - b + b * len(d) / avgdl))
    return out


def test_bm25_mean_and_max_match_brute_force(spark):
    corpus = lex.tokenize_alnum(tb.examples(spark, SF_SMALL))
    queries = tb.target(spark, SF_SMALL).select(F.col("item_id").alias("query_id"),
                                                alnum("text").alias("tokens"))
    c = sorted((r.example_id, list(r.tokens)) for r in corpus.collect())
    q = sorted((r.query_id, list(r.tokens)) for r in queries.collect())
    brute = _bm25_brute([t for _, t in c], [t for _, t in q])
    mean = {r.example_id: r.score for r in lex.bm25_mean(corpus, queries).collect()}
    mx = {r.example_id: r.score for r in lex.bm25_max(corpus, queries).collect()}
    for j, (i, _) in enumerate(c):
        assert mean[i] == pytest.approx(brute[:, j].mean(), rel=1e-9, abs=1e-12)
        assert mx[i] == pytest.approx(max(brute[:, j].max(), 0.0), rel=1e-9, abs=1e-12)


def test_bm25_mean_is_mean_of_pairs(spark):
    corpus = lex.tokenize_alnum(tb.examples(spark, SF_SMALL))
    queries = tb.target(spark, SF_SMALL).select(F.col("item_id").alias("query_id"),
                                                alnum("text").alias("tokens"))
    nq = queries.count()
    pairs = lex.bm25_pairs(corpus, queries).groupBy("example_id").agg((F.sum("score") / nq).alias("m"))
    mean = lex.bm25_mean(corpus, queries).join(pairs, "example_id", "left").collect()
    for r in mean:
        assert r.score == pytest.approx(r.m or 0.0, rel=1e-9, abs=1e-12)


def test_hashed_pooling_matches_per_token_definition(spark):
    df = spark.createDataFrame([(0, ["a", "b", "a"]), (1, []), (2, ["zz"])],
                               "example_id long, tokens array<string>")

    def signs(t):
        bits = bin(int(hashlib.md5(f"42:tokvec:{t}".encode()).hexdigest()[:16], 16))[2:].zfill(64)
        return np.array([-1.0 if c == "1" else 1.0 for c in bits])

    mean = {r.example_id: np.array(r.vec) for r in vec.encode_mean_pool(df).collect()}
    pos = {r.example_id: np.array(r.vec) for r in vec.encode_position_pool(df).collect()}
    exp0 = (signs("a") * 2 + signs("b")) / 3
    assert np.allclose(mean[0], exp0) and np.allclose(mean[1], 0) and np.allclose(mean[2], signs("zz"))
    p0 = (1 * signs("a") + 2 * signs("b") + 3 * signs("a")) / 6
    assert np.allclose(pos[0], p0 / np.linalg.norm(p0))


def _rand_vecs(spark, n=60, d=5, seed=3, dup=True):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d))
    if dup:
        x[7] = x[3]  # an exact tie
    rows = [(i, x[i].tolist()) for i in range(n)]
    return spark.createDataFrame(rows, "example_id long, vec array<double>"), x


def _nn_brute(x):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(u @ u.T, 9)
    np.fill_diagonal(s, -np.inf)
    return {i: int(np.argmax(s[i])) for i in range(len(x))}


@pytest.mark.parametrize("block", [8, 512])
def test_nearest_neighbor_exact(spark, block):
    df, x = _rand_vecs(spark)
    got = {r.example_id: r.nn_id for r in vec.nearest_neighbor(df, "exact", block=block).collect()}
    assert got == _nn_brute(x)


def test_nearest_neighbor_lsh_answers_every_row(spark):
    df, x = _rand_vecs(spark)
    got = {r.example_id: r.nn_id for r in vec.nearest_neighbor(df, "lsh", block=16).collect()}
    assert set(got) == set(range(len(x)))


def test_projection_blocks_agree_with_numpy(spark):
    rng = np.random.default_rng(1)
    rows = [(i, "train", 0, rng.normal(size=7).tolist()) for i in range(20)]
    g = spark.createDataFrame(rows, "example_id long, split string, ckpt int, grad array<double>")
    signs = [[1.0 - 2.0 * (int(hashlib.md5(f"42:proj:{i}:{j // 128}".encode()).hexdigest(), 16) >> (127 - j % 128) & 1)
              for j in range(200)] for i in range(7)]
    want = {r[0]: np.array(r[3]) @ np.array(signs) / math.sqrt(200) for r in rows}
    null = spark.createDataFrame([(99, "train", 0, None)], g.schema)
    for entries in (1, 400, 10_000):
        got = {r.example_id: r.grad for r in inf.random_projection(g.union(null), 200, block_entries=entries).collect()}
        assert got.pop(99) is None and got.keys() == want.keys()
        assert all(np.allclose(got[k], want[k]) for k in want)


def test_structured_projection_keeps_inner_products(spark):
    assert np.array_equal(inf.hadamard(np.eye(4)), [[1, 1, 1, 1], [1, -1, 1, -1], [1, 1, -1, -1], [1, -1, -1, 1]])
    signs, coords = inf.projection_plan(42, 300, 600)
    assert signs.shape == (2, 300) and len(coords) == 600 and abs(signs.mean()) < 0.1
    assert len(set(coords[:512])) == 512 and len(set(coords[512:])) == 88
    bit = int(hashlib.md5(b"42:had-1:200:1").hexdigest(), 16) >> (127 - 200 % 128) & 1
    assert signs[1, 200] == 1 - 2 * bit
    rng = np.random.default_rng(4)
    x = rng.normal(size=(12, 300))
    x[1] = 0.0
    x[1, 7] = 1.0                                                     # a spike spreads over all coordinates
    rows = [(i, x[i].tolist()) for i in range(12)] + [(99, None)]
    g = spark.createDataFrame(rows, "example_id long, grad array<double>")
    runs = []
    for entries in (1, 2000, 1 << 22):
        got = {r.example_id: r.grad for r in inf.random_projection(g, 256, block_entries=entries, structured=True).collect()}
        assert got.pop(99) is None and len(got) == 12
        runs.append(np.array([got[i] for i in range(12)]))
    assert np.array_equal(runs[0], runs[1]) and np.array_equal(runs[1], runs[2])
    norm = np.linalg.norm(x, axis=1)
    err = (runs[0] @ runs[0].T - x @ x.T) / np.outer(norm, norm)
    assert np.abs(err).max() < 4 / math.sqrt(256)
    whole = inf.random_projection(g, 512, structured=True).filter("grad is not null").orderBy("example_id").collect()
    z = np.array([r.grad for r in whole])
    assert np.allclose(z @ z.T, x @ x.T)                              # all coordinates: an isometry
    mean = np.mean([[float(np.dot(*(inf.hadamard(np.pad(x[:2] * inf.projection_plan(s, 300, 64)[0], ((0, 0), (0, 212))))
                     [:, inf.projection_plan(s, 300, 64)[1]]))) / 64] for s in range(200)])
    assert abs(mean - x[0] @ x[1]) < 4 * norm[0] * norm[1] / math.sqrt(64 * 200)


def _radius(x, centers):
    return max(min(np.linalg.norm(x[i] - x[c]) for c in centers) for i in range(len(x)))


def test_diversity_within_twice_optimum(spark):
    df, x = _rand_vecs(spark, n=9, d=2, seed=5, dup=False)
    scores = df.select("example_id", F.lit(1.0).alias("score"))
    k = 3
    got = [r.example_id for r in pol.policy_diversity(scores, df, budget=k / 9).collect()]
    assert len(got) == k
    opt = min(_radius(x, c) for c in itertools.combinations(range(9), k))
    assert _radius(x, got) <= 2 * opt + 1e-12


def test_diversity_gives_k_rows_by_any_way(spark):
    df, x = _rand_vecs(spark, n=101, d=3, seed=6, dup=False)
    scores = df.select("example_id", F.lit(1.0).alias("score"))
    for block_rows, k, merge_k in [(7, 20, 50), (7, 101, 500), (40, 3, 50), (101, 20, 50), (8, 40, 0), (8, 101, 0), (32, 60, 0)]:
        got = [r.example_id for r in pol.policy_diversity(scores, df, k / 101, block_rows=block_rows, merge_k=merge_k).collect()]
        assert len(got) == len(set(got)) == k
    one = {r.example_id for r in pol.policy_diversity(scores, df, budget=20 / 101).collect()}
    assert one == set(pol.greedy_k_center(np.arange(101), x, np.ones(101), 20))
    assert pol.policy_diversity(scores.limit(0), df, budget=0.1).count() == 0
    assert pol.policy_diversity(scores, df.withColumn("vec", F.lit(None).cast("array<double>")), 0.1).count() == 0


def _planted(spark, centres, per, hot, spread=1e-3):
    """``centres`` far apart, ``per`` rows around each, one with ``hot`` rows more; the optimal radius is <= spread."""
    rng = np.random.default_rng(8)
    c = np.stack(np.meshgrid(np.arange(10.0), np.arange(10.0)), axis=-1).reshape(-1, 2)[:centres]
    x = np.concatenate([np.repeat(c, per, axis=0), np.repeat(c[3:4], hot, axis=0)])
    shift = rng.normal(size=x.shape)
    x = x + shift / np.linalg.norm(shift, axis=1, keepdims=True) * spread * rng.random((len(x), 1))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "example_id long, vec array<double>")
    return df, x


def test_diversity_covers_the_table_across_blocks(spark):
    # the groups are spread over all blocks: picks shared out by block miss groups, the coreset none
    df, x = _planted(spark, centres=20, per=8, hot=80)
    scores = df.select("example_id", (F.col("example_id") * 1.0).alias("score"))
    for block_rows in (40, 64, 512):
        got = [r.example_id for r in pol.policy_diversity(scores, df, 20, block_rows=block_rows).collect()]
        levels = {40: 3, 64: 2, 512: 1}[block_rows]
        assert len(got) == 20 and _radius(x, got) <= 2 * levels * 2e-3
        assert len(x) - 1 in got                                     # the best score starts the last block as well


def test_diversity_by_cells_covers_and_ignores_partitioning(spark):
    df, x = _planted(spark, centres=40, per=8, hot=80)
    scores = df.select("example_id", F.lit(0.0).alias("score"))
    runs = [sorted(r.example_id for r in pol.policy_diversity(scores, d, 160, block_rows=16, merge_k=0).collect())
            for d in (df, df.repartition(7))]
    assert runs[0] == runs[1] and len(runs[0]) == 160
    assert _radius(x, runs[0]) < 0.1                                  # every group is met


def test_diversity_cells_equal_whole_orders(spark):
    df, x = _rand_vecs(spark, n=90, d=3, seed=9)
    scores = np.arange(90.0) % 7
    at, entered = pol.farthest_order(np.arange(90), x, scores, 90)
    assert sorted(at) == list(range(90)) and entered == sorted(entered, reverse=True)
    cut = pol.farthest_order(np.arange(90), x, scores, 90, floor=entered[30])
    assert cut == (at[:31], entered[:31])


def test_greats_matches_numpy(spark):
    rng = np.random.default_rng(2)
    g = rng.normal(size=(6, 3))
    gval = rng.normal(size=3)
    rows = [(0, i, g[i].tolist()) for i in range(6)]
    grads = spark.createDataFrame(rows, "batch_id long, example_id long, grad array<double>")
    gv = spark.createDataFrame([(gval.tolist(),)], "gval array<double>")
    got = [r.example_id for r in pol.policy_greats(grads, gv, k=3, eta=0.5).orderBy("rank").collect()]
    assert got == pol.greats_batch(np.arange(6), g, gval, 3, 0.5)


def test_selection_independent_of_partitioning(spark):
    from winnow.plans.queries import QUERIES
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "3")
        a = sorted(r.example_id for r in QUERIES["select_bm25"](spark, SF_SMALL).collect())
        spark.conf.set("spark.sql.shuffle.partitions", "7")
        b = sorted(r.example_id for r in QUERIES["select_bm25"](spark, SF_SMALL).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert a == b and len(a) == 10


def test_warmup_minibatch_checkpoints(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=3).tolist(), float(i % 2)) for i in range(12)]
    v = spark.createDataFrame(rows, "example_id long, vec array<double>, y double")
    sel = v.select("example_id")
    ck = inf.warmup_checkpoints(v, sel, steps=6, lr=0.1, num_checkpoints=3, batch_size=4).orderBy("ckpt").collect()
    assert [r.step for r in ck] == [2, 4, 6]
    assert [r.lr for r in ck] == pytest.approx([0.1 * 4 / 6, 0.1 * 2 / 6, 0.0])
    # Brute force: the same minibatch Adam in numpy over the same hash order.
    order = sorted(range(12), key=lambda i: (hashlib.md5(f"42:warmup-order:{i}".encode()).hexdigest(), i))
    x = np.array([rows[i][1] + [1.0] for i in order])
    y = np.array([rows[i][2] for i in order])
    w = m = vv = np.zeros(4)
    for t in range(1, 7):
        idx = [((t - 1) * 4 + j) % 12 for j in range(4)]
        p = 1 / (1 + np.exp(-(x[idx] @ w)))
        g = ((p - y[idx])[:, None] * x[idx]).mean(axis=0)
        m = 0.9 * m + 0.1 * g
        vv = 0.999 * vv + 0.001 * g * g
        w = w - 0.1 * (6 - (t - 1)) / 6 * (m / (1 - 0.9 ** t)) / (np.sqrt(vv / (1 - 0.999 ** t)) + 1e-8)
    assert np.allclose(ck[-1].params, w, atol=1e-9)


def test_grouped_rank_paths_agree(spark, monkeypatch):
    """Hot groups take the range-sort rank; it must pick the same rows as the window."""
    import winnow.operators.ranking as rk
    from winnow.operators import sampling as smp
    rows = [("hot", i) for i in range(300)] + [("a", 1000 + i) for i in range(40)] + [("b", 2000 + i) for i in range(7)]
    df = spark.createDataFrame(rows, "dataset string, example_id long")
    window = sorted((r.dataset, r.example_id) for r in smp.mix_sources(df, 0.3, seed=3).collect())
    labels = df.select("example_id", F.when(F.col("dataset") == "hot", 0).otherwise(1).alias("label"))
    rr_window = sorted(r.example_id for r in smp.cluster_round_robin(labels, 30, seed=42).collect())
    monkeypatch.setattr(rk, "WINDOW_MAX_GROUP", 0)
    sorted_path = sorted((r.dataset, r.example_id) for r in smp.mix_sources(df, 0.3, seed=3).collect())
    rr_sorted = sorted(r.example_id for r in smp.cluster_round_robin(labels, 30, seed=42).collect())
    assert window == sorted_path and len(window) == 90 + 12 + 2
    assert rr_window == rr_sorted and len(rr_window) == 30


def test_salted_join_path_matches_broadcast(spark, monkeypatch):
    import winnow.operators.ranking as rk
    corpus = lex.tokenize_alnum(tb.examples(spark, SF_SMALL))
    queries = tb.target(spark, SF_SMALL).select(F.col("item_id").alias("query_id"),
                                                alnum("text").alias("tokens"))
    a = {r.example_id: r.score for r in lex.bm25_mean(corpus, queries).collect()}
    pa = {(r.query_id, r.example_id): r.score for r in lex.bm25_pairs(corpus, queries).collect()}
    monkeypatch.setattr(rk, "BROADCAST_ROWS", 0)
    b = {r.example_id: r.score for r in lex.bm25_mean(corpus, queries).collect()}
    pb = {(r.query_id, r.example_id): r.score for r in lex.bm25_pairs(corpus, queries).collect()}
    assert a.keys() == b.keys() and pa.keys() == pb.keys()
    assert all(a[k] == pytest.approx(b[k], rel=1e-12, abs=1e-15) for k in a)
    assert all(pa[k] == pytest.approx(pb[k], rel=1e-12, abs=1e-15) for k in pa)


def test_lsh_recall_and_coverage(spark):
    df, x = _rand_vecs(spark, n=400, d=8, seed=9, dup=False)
    exact = _nn_brute(x)
    got = {r.example_id: r.nn_id for r in
           vec.nearest_neighbor(df, "lsh", block=32, bucket_rows=50, tables=6).collect()}
    assert set(got) == set(range(400))
    recall = sum(got[i] == exact[i] for i in got) / 400
    assert recall >= 0.5


def test_bm25_pairs_matrix_equals_join(spark):
    corpus = lex.tokenize_alnum(tb.examples(spark, SF_SMALL))
    queries = tb.target(spark, SF_SMALL).select(F.col("item_id").alias("query_id"),
                                                alnum("text").alias("tokens"))
    m = {(r.query_id, r.example_id): r.score for r in lex.bm25_pairs(corpus, queries).collect()}
    j = {(r.query_id, r.example_id): r.score
         for r in lex._bm25_pairs_join(corpus, queries, 1.5, 0.75, "example_id", "query_id").collect()}
    assert m.keys() == j.keys()
    assert all(m[k] == pytest.approx(j[k], rel=1e-12) for k in m)


def test_miwv_one_pass_equals_two_passes(spark):
    from winnow.operators import lm as lmod
    from winnow.operators import losses as ls
    rows = [(0, "p", ["a", "b", "c", "a"], 2), (1, "p", ["b", "c", "a", "d", "b"], 1),
            (2, "p", ["c", "a"], 1), (3, "p", ["a", "x"], 2)]
    tok = spark.createDataFrame(rows, "example_id long, text string, tokens array<string>, n_prompt long")
    bg = spark.createDataFrame([(9, ["a", "b", "c", "a", "b", "d"]), (8, ["c", "a", "x"])],
                               "example_id long, tokens array<string>")
    lm = lmod.fit_lm_counts(bg)
    vecs = spark.createDataFrame([(i, [float(i), 1.0, float(i % 2)]) for i in range(4)],
                                 "example_id long, vec array<double>")
    nn = vec.nearest_neighbor(vecs, "exact")
    ctx = ls.one_shot_context(tok, nn, 6)
    cond = ls.response_loss(lmod.token_nll(tok, lm, "cond"), tok)
    shot = ls.response_loss(lmod.token_nll(tok, lm, "oneshot", ctx), tok)
    two = {r.example_id: r.score for r in ls.miwv_score(cond, shot).collect()}
    one = {r.example_id: r.score for r in ls.miwv_scores(tok, vecs, lm, max_length=6).collect()}
    assert two.keys() == one.keys()
    for k in two:
        assert (two[k] is None and one[k] is None) or two[k] == pytest.approx(one[k], rel=1e-12, abs=1e-15)
    # A record without a prompt takes the two-pass path and still answers.
    tok0 = tok.withColumn("n_prompt", F.when(F.col("example_id") == 1, 0).otherwise(F.col("n_prompt")))
    assert ls.miwv_scores(tok0, vecs, lm, max_length=6).count() == 4


def test_kmeans_labels_contract(spark):
    df, _ = _rand_vecs(spark, n=80, d=4, seed=11, dup=False)
    out = vec.kmeans_labels(df, k=5, seed=42)
    rows = out.collect()
    assert len(rows) == 80 and {r.example_id for r in rows} == set(range(80))
    labels = {r.label for r in rows}
    assert labels <= set(range(5)) and len(labels) == 5


def test_kmeans_matches_numpy_lloyd(spark):
    df, x = _rand_vecs(spark, n=60, d=3, seed=12, dup=False)
    order = sorted(range(60), key=lambda i: (hashlib.md5(f"42:kmeans-init:{i}".encode()).hexdigest(), i))
    for iters in (1, 25):
        got = {r.example_id: r.label for r in vec.kmeans_labels(df, k=4, seed=42, iters=iters).collect()}
        assert [got[i] for i in range(60)] == _lloyd(x, x[order[:4]].copy(), iters)


def _lloyd(x, c, iters):
    for _ in range(iters):
        lab = np.array([min(range(len(c)), key=lambda j: math.dist(row, c[j])) for row in x])
        new = c.copy()
        for j in range(4):
            if (lab == j).any():
                new[j] = x[lab == j].mean(0)
        if np.allclose(new, c, rtol=0, atol=0):
            break
        c = new
    return lab.tolist()


def test_topk_tells_tiny_scores_apart(spark):
    from winnow.operators.budget import topk_by_score
    rows = [(0, 1e-11), (1, 3e-10), (2, 2e-10), (3, 0.1 + 0.2), (4, 0.3), (5, -0.0), (6, 0.0)]
    s = spark.createDataFrame(rows, "example_id long, score double")
    got = [(r.example_id, r.score) for k in (2, 3) for r in topk_by_score(s, k).orderBy("example_id").collect()]
    assert got == [(3, 0.3), (4, 0.3), (1, 3e-10), (3, 0.3), (4, 0.3)]
    assert [r.example_id for r in topk_by_score(s.where("abs(score) < 1e-5"), 4).collect()] == [1, 2, 0, 5]


def test_topk_sinks_scores_that_are_not_finite(spark):
    from winnow.operators.budget import topk_by_score
    rows = [(0, float("nan")), (1, float("inf")), (2, 5.0), (3, float("-inf")), (4, 1.0), (5, None)]
    top = topk_by_score(spark.createDataFrame(rows, "example_id long, score double"), 2)
    assert sorted(r["example_id"] for r in top.collect()) == [2, 4]


def test_brief_experience_writes_only_the_subset(spark, monkeypatch):
    """The model's pairs are not written again for a subset, and no table is made before it is asked for."""
    from winnow.operators import lm as lmod
    schema = "example_id long, tokens array<string>"
    bg, new = [(9, ["a", "b", "c", "a", "b", "d"]), (8, ["c", "a", "x"]), (7, [])], [(1, ["a", "b", "z"]), (2, ["x"])]
    written = []
    store = lmod.store
    monkeypatch.setattr(lmod, "store", lambda df: written.append(df.count()) or store(df))
    tok = spark.createDataFrame([*new, (3, ["not", "chosen"])], schema)
    brief = lmod.lm_brief_experience(lmod.fit_lm_counts(spark.createDataFrame(bg, schema)), tok,
                                     spark.createDataFrame([(1,), (2,)], "example_id long"))
    assert written == [7, 4]                                # pairs of the corpus and of the subset
    both = lmod.fit_lm_counts(spark.createDataFrame(bg + new, schema))
    for table in ("uni", "bi", "pre", "totals"):
        one, two = (sorted(map(tuple, getattr(m, table).collect())) for m in (brief, both))
        assert one == two and one


def test_bm25_self_beyond_the_broadcast(spark, monkeypatch):
    """with all terms in the queries no vocabulary is joined, and a vocabulary too big to broadcast is not copied
    for salts: the common terms are broadcast, the rows of the others joined; ids may repeat."""
    rows = [(i % 50, [f"w{j}" for j in range(i % 9)] + [f"only{i}"] * (i % 3)) for i in range(60)] + [(None, ["w1", "x"])]
    docs = spark.createDataFrame(rows, "example_id long, tokens array<string>").repartition(3)
    monkeypatch.setattr(lex, "join_small", None)
    whole = {r.example_id: r.score for r in lex.bm25_self(docs).collect()}
    monkeypatch.setattr(lex, "BROADCAST_ROWS", 4)
    small = lex.bm25_self(docs)
    assert "SortMergeJoin" in small._jdf.queryExecution().toString()
    got = {r.example_id: r.score for r in small.collect()}
    assert got.keys() == whole.keys() == {r[0] for r in rows}
    for k, v in whole.items():
        assert got[k] == pytest.approx(v, rel=1e-12, abs=1e-15)
    assert max(whole.values()) > 0


@pytest.mark.parametrize("structured", [False, True])
def test_projected_gradients_stay_in_their_task(spark, monkeypatch, structured):
    rng = np.random.default_rng(8)
    odd = {5: None, 6: [None] * 6, 7: [1.0, None, 2.0, 0.0, 1.0, 1.0], 33: [None] * 6, 34: None}
    rows = [(i, c, odd.get(i, rng.normal(size=6).tolist())) for i in range(40) for c in (0, 1, 2)]
    schema = "example_id long, ckpt int, grad array<double>"
    train, val = spark.createDataFrame(rows[:90], schema).repartition(3), spark.createDataFrame(rows[81:], schema)
    val = val.where("ckpt < 2 or example_id < 0")            # checkpoint 2 has no validation rows
    weights = spark.createDataFrame([(0, 0.5), (1, 0.3), (2, 0.2)], "ckpt int, weight double")
    options = {"p": 32, "seed": 3, "structured": structured, "block_entries": 128}
    want = inf.influence_score(inf.random_projection(train, **options), inf.random_projection(val, **options), weights)
    want = {r.example_id: r.score for r in want.collect()}
    monkeypatch.setattr(inf, "_map_gradients", None)         # makes rows of p numbers
    got = {r.example_id: r.score for r in inf.influence_score(train, val, weights, projection=options).collect()}
    none = inf.influence_score(train, val.withColumn("grad", F.lit(None).cast("array<double>")), weights, projection=options)
    assert none.count() == 0                                 # tasks without a gradient return no sum
    void = val.withColumn("grad", F.array_repeat(F.lit(None).cast("double"), 6))
    void = inf.influence_score(train, void, weights, projection=options).collect()
    assert len(void) == 30 and all(r.score is None for r in void)
    assert set(got) == set(want) and len(got) == 30 and all(x[k] is None for x in (got, want) for k in (5, 6, 7))
    assert all(abs(got[k] - want[k]) < 1e-12 for k in got if k not in odd)
