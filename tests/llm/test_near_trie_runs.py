"""Min-max near-duplicates, the conversation trie and periodic runs against brute force."""

import hashlib
import itertools
import os
import random
import re
import sys
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from conftest import SF_SMALL, spark  # noqa: E402,F401

from winnow.llm import convtrie, minmax, ngramjoin, periodic  # noqa: E402
from winnow.llm.queries import QUERIES, looped  # noqa: E402

LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
WIDE = "doc_id long, text string, id long, key long, node long, g long, comp string, text_ string, n int, c0 int, new string"
EDGE = [(1, "a b c d e f g"), (2, None), (3, ""), (4, " \t\n"), (5, "A b C d e f g"), (5, "A b C d e f g"),
        (6, " ".join(f"w{i % 977}x{i}" for i in range(40_000))), (7, " ".join(f"w{i % 977}x{i}" for i in range(40_000)) + " end"),
        (None, "one two"), (None, "a b c d e f g"), (8, "é ß 漢 字 x y"), (9, "x " * 30_000)]


@pytest.fixture(scope="module")
def edge(spark):  # noqa: F811
    return spark.createDataFrame([(*r, *[None] * 9) for r in EDGE], WIDE).repartition(3)


def rows(df):
    return [r.asDict() for r in df.collect()]


# --- words and shingles

def test_word_hash_tells_words_apart():
    a, b = "a", "b"
    shingler = ngramjoin.Shingler(5)
    for _ in range(12):                       # words on which polynomial hashes modulo 2**64 collide
        a, b = a + b, b + a
        (_, (x, y)), = shingler.sets(pa.array([a, b]))
        assert x[0] != y[0]
    w = "w" * 70
    (_, (x, y, z)), = shingler.sets(pa.array([f"{w} Q", f"{w.upper()} q", f"{w}w q"]))
    assert x[0] == y[0] != z[0]


# --- min-max near-duplicates

def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    return {tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def linked(docs, pct):
    """Per row (set size, smallest id reachable)."""
    sets = [shingles(t) for _, t in docs]
    par = list(range(len(sets)))

    def find(x):
        while par[x] != x:
            x = par[x]
        return x
    for a, b in itertools.combinations(range(len(sets)), 2):
        k = len(sets[a] & sets[b])
        if k and 100 * k >= pct * (len(sets[a]) + len(sets[b]) - k):
            x, y = sorted((find(a), find(b)))
            par[y] = x
    least = {}
    for k, (i, _) in enumerate(docs):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return [(i, len(s), least.get(find(k))) for k, ((i, _), s) in enumerate(zip(docs, sets))]


def group(rng, vocab, size, most):
    base = [rng.choice(vocab) for _ in range(150)]
    for _ in range(size):
        w = list(base)
        for _ in range(rng.randint(1, most)):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        yield " ".join(w)


@pytest.mark.parametrize("tile", [256, 24])
def test_near_duplicates_brute_force(spark, monkeypatch, tile):  # noqa: F811
    monkeypatch.setattr(minmax, "TILE_ROWS", tile)
    rng = random.Random(tile)
    vocab = [f"w{k}" for k in range(400)]
    texts = list(group(rng, vocab, 220, 4))                      # most pairs of it lie near the bound
    for _ in range(12):
        texts += group(rng, vocab, 6, 2)
    passage = " ".join(rng.choice(vocab) for _ in range(100))    # shared, but too little of each text
    texts += [passage + " " + " ".join(rng.choice(vocab) for _ in range(60)) for _ in range(60)]
    texts += ["", None, "A b", "a B"] + texts[:3]
    docs = list(enumerate(texts))
    rng.shuffle(docs)
    out = rows(minmax.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)))
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in out)
    assert got == sorted(linked(docs, 85))
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in out)


def test_near_duplicates_whole_table(spark):  # noqa: F811
    t = pq.read_table(f"{SF_SMALL}/documents.parquet", columns=["doc_id", "text"])
    docs = list(zip(t["doc_id"].to_pylist(), t["text"].to_pylist()))
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in rows(QUERIES["op11_minmax_near_dedup"](spark, SF_SMALL)))
    assert got == sorted(linked(docs, 85))


def test_near_duplicates_edges(edge):
    out = rows(minmax.near_duplicates(edge))
    assert sorted(map(str, [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in out])) == sorted(map(str, linked(EDGE, 85)))
    assert minmax.near_duplicates(edge.limit(0)).count() == 0
    kept = minmax.deduplicate(edge)
    assert kept.columns == edge.columns
    assert sorted(r["doc_id"] or 0 for r in rows(kept)) == [0, 0, 1, 2, 3, 4, 6, 8, 9]
    alone = rows(minmax.near_duplicates(edge.where("doc_id is null")))
    assert all(r["component_id"] is None and r["kept"] for r in alone)


def test_estimates_are_unbiased_and_vary_less():
    rng = np.random.default_rng(3)
    both, least = [], []
    for trial in range(150):
        pool = rng.integers(0, 2**64, 130, dtype=np.uint64)
        hasher = minmax.MinMaxHasher(16)
        hasher.masks = rng.integers(0, 2**64, 16, dtype=np.uint64)
        hasher.odd = rng.integers(0, 2**64, 16, dtype=np.uint64) | np.uint64(1)
        a, b = hasher.signatures([pool[:115], pool[15:]])        # Jaccard 100 / 130
        both.append(minmax.similarity(a, b))
        hasher = minmax.MinMaxHasher(32)
        hasher.masks = rng.integers(0, 2**64, 32, dtype=np.uint64)
        hasher.odd = rng.integers(0, 2**64, 32, dtype=np.uint64) | np.uint64(1)
        a, b = hasher.signatures([pool[:115], pool[15:]])
        least.append(minmax.similarity(a[:32], b[:32]))
    assert abs(np.mean(both) - 100 / 130) < 0.02
    assert np.var(both) < 1.3 * np.var(least)                     # from half the hash evaluations


# --- conversation trie

def trie_rows(data, graft):
    by = {}
    for c, t, r, x in data:
        if c is not None:
            by.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    own = {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in by.items()}
    seq = own
    if graft:
        seq = {c: own.get(c - c % 5, [])[:zlib.crc32(str(c).encode()) % 9] + s[zlib.crc32(str(c).encode()) % 9:]
               for c, s in own.items()}
    members, kids, leaves, saved = {}, {}, {}, {}
    for c, s in seq.items():
        for d in range(len(s) + 1):
            members.setdefault(tuple(s[:d]), []).append(c)
    for p in members:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in kids.get(p, [])) or 1
        saved[p] = sum(saved[k] for k in kids.get(p, [])) + (len(members[p]) - 1) * (len(p[-1][1].encode()) if p else 0)
    return sorted(((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids.get(p, [])), leaves[p], saved[p],
                    hashlib.sha256(",".join(str(c) for c in sorted(m) if len(seq[c]) == len(p)).encode()).hexdigest())
                   for p, m in members.items()), key=str)


def random_turns(n, many, most, seed):
    rng = random.Random(seed)
    return [(c, t, rng.choice(["user", "assistant"]), rng.choice(["aé", "b", "", "dd", "x", "yy"][:many]))
            for c in range(n) for t in range(rng.randint(1, most))]


LONG = ([(7, t, "user", f"x{t}") for t in range(2000)] + [(8, t, "user", f"x{t}") for t in range(1700)]
        + [(20 + i, t, "user", f"x{t}") for i in range(40) for t in range(20 + i % 3)])
ODD = [(1, None, None, None), (1, 0, "user", "q"), (1, 0, "user", "p"), (None, 0, "user", "z"), (3, 0, None, "q"),
       (4, 1, "user", "q"), (4, 1, "user", "q"), (6, 1, "us", "erq"), (11, 1, "user", "q")]


@pytest.mark.parametrize("data,limit", [(random_turns(80, 3, 6, 1), 5), (random_turns(150, 2, 9, 2), 40), (LONG, 100),
                                        (ODD, 1), (ODD, 512)])
def test_trie_brute_force(spark, monkeypatch, data, limit):  # noqa: F811
    monkeypatch.setattr(convtrie, "CHUNK", 64)
    monkeypatch.setattr(convtrie, "ID_RANGE", 8)
    df = spark.createDataFrame([(*r, None, None) for r in data],
                               "conv_id long, turn long, role string, text string, conv string, k1 string").repartition(3)
    t = convtrie.turns(df)
    for graft in (False, True):
        out = convtrie.trie(*convtrie.grafted(t), container_rows=limit) if graft else convtrie.trie(t, container_rows=limit)
        assert out.columns == convtrie.NODE[:-1] + ["ends_sha256"]
        assert sorted((tuple(r) for r in out.collect()), key=str) == trie_rows(data, graft)


def test_trie_whole_table_and_empty(spark):  # noqa: F811
    t = pq.read_table(f"{SF_SMALL}/conversations.parquet")
    data = list(zip(*(t[c].to_pylist() for c in ("conv_id", "turn", "role", "text"))))
    got = sorted((tuple(r) for r in QUERIES["op12_conversation_trie"](spark, SF_SMALL).collect()), key=str)
    assert got == trie_rows(data, True)
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert convtrie.prefix_trie(none).count() == 0 and convtrie.trie(*convtrie.grafted(convtrie.turns(none))).count() == 0


# --- periodic runs

def brute_runs(words):
    ids = {}
    w = np.array([ids.setdefault(x, len(ids)) for x in words], np.int64)
    found = {}
    for q in range(1, len(w) // 3 + 1):
        same = np.concatenate(([False], w[:-q] == w[q:], [False]))
        edges = np.flatnonzero(same[1:] != same[:-1])
        for s, e in zip(edges[::2].tolist(), edges[1::2].tolist()):
            if e - s + q >= max(24, 3 * q):
                found.setdefault((s, e - s + q), q)
    return sorted((s, n, q) for (s, n), q in found.items())


def brute_report(words):
    r = brute_runs(words)
    gone = {i for s, n, q in r for i in range(s + q, s + n)}
    best = (None,) * 4
    if r:
        s, n, q = r[0]
        for s2, n2, q2 in r:
            if n2 * q > n * q2:
                s, n, q = s2, n2, q2
        best = (s, n, q, 1000 * n // q)
    return (len(r), *best, hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in r).encode()).hexdigest(),
            hashlib.sha256(b" ".join(x for i, x in enumerate(words) if i not in gone)).hexdigest())


def planted(rng):
    many = rng.choice([1, 2, 3, 10, 1000])
    w = [b"%d" % rng.randrange(many) for _ in range(rng.choice([0, 1, 10, 23, 24, 25, 60, 150, 400]))]
    for _ in range(rng.randint(0, 3)):
        if len(w) > 5:
            a = rng.randrange(len(w))
            p = 1 + rng.randrange(max(1, (len(w) - a) // 3))
            for i in range(a + p, min(len(w), a + rng.randint(0, len(w)))):
                w[i] = w[i - p]
    return w


def test_runs_brute_force():
    rng = random.Random(4)
    for _ in range(150):
        texts = [planted(rng) for _ in range(rng.randint(1, 6))]
        assert periodic.find_all(texts) == [brute_runs(w) for w in texts]


def test_grammar_extensions():
    rng = random.Random(5)
    for _ in range(40):
        n = rng.choice([2, 30, 300])
        w = [rng.randrange(rng.choice([1, 2, 4])) for _ in range(n)]
        ids = np.array([900, *w, 901])
        g = periodic.Grammar(ids, least=rng.choice([2, 16]))
        pairs = [sorted(rng.sample(range(1, n + 1), 2)) for _ in range(50)]
        x, y = np.array(pairs).T
        ahead, back = g.extension(x, y), g.extension(x, y, back=True)
        for a, b, f, r in zip(x, y, ahead, back):
            k = 0
            while ids[a + k] == ids[b + k]:
                k += 1
            assert f == k
            k = 0
            while ids[a - k - 1] == ids[b - k - 1]:
                k += 1
            assert r == k


def test_grammar_of_long_repeats_is_small():
    g = periodic.Grammar(np.array([9, *[1, 2, 3, 1] * 25_000, 8]))
    assert len(g.symbols[-1]) <= 16 and sum(map(len, g.symbols)) < 5 * 100_002


def test_runs_whole_table(spark):  # noqa: F811
    t = pq.read_table(f"{SF_SMALL}/documents.parquet", columns=["doc_id", "text"])
    names = ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    got = {r["doc_id"]: tuple(r[n] for n in names) for r in rows(QUERIES["op13_periodic_runs"](spark, SF_SMALL))}
    expect = {}
    for i, text in zip(t["doc_id"].to_pylist(), t["text"].to_pylist()):
        w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
        h, n = zlib.crc32(str(i).encode()), len(w)
        if h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
        assert looped(i, re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())) == w
        expect[i] = brute_report(w)
    assert got == expect and sum(v[0] > 0 for v in expect.values()) > 10


def test_runs_edges(spark, edge):  # noqa: F811
    out = rows(periodic.report(edge))
    assert len(out) == len(EDGE)
    empty = hashlib.sha256(b"").hexdigest()
    by = {r["doc_id"]: r for r in out}
    assert all(by[k]["n_runs"] == 0 and by[k]["start"] is None and by[k]["runs_sha256"] == empty
               and by[k]["collapsed_sha256"] == empty for k in (2, 3, 4))
    assert (by[9]["start"], by[9]["length"], by[9]["period"], by[9]["exponent_milli"]) == (0, 30_000, 1, 30_000_000)
    assert by[6]["n_words"] == 40_000 and by[6]["n_runs"] == 0
    assert periodic.report(edge.limit(0)).count() == 0 and periodic.runs(edge.limit(0)).count() == 0
    assert [(r["doc_id"], r["start"], r["length"], r["period"]) for r in rows(periodic.runs(edge))] == [(9, 0, 30_000, 1)]
    c = periodic.collapse(edge)
    assert c.columns == edge.columns
    expect = [(i, "x" if i == 9 else t, *[None] * 9) for i, t in EDGE]
    assert sorted(map(str, (tuple(r) for r in c.collect()))) == sorted(map(str, expect))
