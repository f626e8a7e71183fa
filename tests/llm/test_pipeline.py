"""The pipeline stage by stage against plain Python, each stage judged on its own input, over planted rows."""

import hashlib
import itertools
import os
import random
import re
import sys
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from conftest import spark  # noqa: E402,F401

import corpus_pipeline  # noqa: E402
from winnow.llm import sharding  # noqa: E402

DOC = "doc_id long, text string, lang string, source string, n_chars long"
LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
BENCH_WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
INSULTS = ["grobnik", "vexfool", "snarlpig", "hatescum"]


def planted():
    """Rows of documents, labels and benchmark; ids of the toxic ones."""
    rng = random.Random(11)
    vocab = ["".join(rng.choice("aeioulmnrstdk") for _ in range(rng.randint(3, 8))) for _ in range(900)]

    def prose(n):
        return " ".join(rng.choice(vocab) for _ in range(n))
    items = [prose(rng.randint(12, 40)) for _ in range(12)] + ["short planted item", prose(9), "", None]
    texts, toxic = [], set()
    for _ in range(90):
        texts.append(prose(rng.randint(20, 160)))
    for k in range(60):                                             # toxic ones, half of them with labels
        words = prose(rng.randint(20, 60)).split()
        for _ in range(len(words) // 3):
            words[rng.randrange(len(words))] = rng.choice(INSULTS)
        toxic.add(len(texts))
        texts.append(" ".join(words))
    base = prose(140).split()
    for k in range(25):                                             # a chain of near copies, each from the last
        base = list(base)
        base[rng.randrange(len(base))] = rng.choice(vocab)
        texts.append(" ".join(base))
    texts += [texts[3]] * 12 + [texts[3].upper(), texts[4].replace(" ", "\n\t")]
    for k in range(20):                                             # benchmark passages, whole and in part
        item = items[k % 12].split()
        part = " ".join(item[:rng.randint(8, len(item))])
        texts.append(f"{prose(rng.randint(30, 90))}. ({part.title() if k % 2 else part}) {prose(rng.randint(5, 50))}")
    texts += [items[0], items[1] + " and a tail", "short planted item", "so short planted item is", prose(40) + " short planted item",
              items[2] + " " + items[3] + " " + prose(30)]
    shared = prose(60)                                              # a passage in documents that are no copies
    texts += [f"{prose(70)} {shared} {prose(70)}" for _ in range(15)]
    texts += ["", " \n", None, "one two", "one two", "one", prose(3000)]
    docs = []
    for i, t in enumerate(texts):
        source = ["hot", "hot", "web", "book", None][rng.randrange(5)]
        docs.append((i, t, ["en", "de", None][i % 3], source, len(t or "")))
    labels = [(i, int(i in toxic), 0.5) for i in range(150) if i % 2 == 0]
    return docs, labels, list(enumerate(items)), toxic


def shingles(text):
    w = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOW))
    return frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute_near(rows):
    sets = {r["doc_id"]: shingles(r["text"]) for r in rows}
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x
    for a, b in itertools.combinations(sorted(sets), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            up[y] = x
    return [r for r in rows if find(r["doc_id"]) == r["doc_id"]]


def bench_words(text):
    return BENCH_WORD.findall((text or "").translate(LOW))


def runs(words, windows):
    """Merged word ranges of all occurrences of the windows."""
    out = []
    for a, b in sorted((i, i + len(w)) for w in windows for i in range(len(words) - len(w) + 1)
                       if tuple(words[i:i + len(w)]) == w):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def brute_clean(rows, items):
    short = {tuple(w) for _, t in items if 0 < len(w := bench_words(t)) < 10}
    long = {tuple(w[i:i + 10]) for _, t in items if len(w := bench_words(t)) >= 10 for i in range(len(w) - 9)}
    out = []
    for r in rows:
        words = bench_words(r["text"])
        if any(b - a > 0.5 * len(words) for a, b in runs(words, short)):
            continue
        found = runs(words, long)
        if sum(b - a for a, b in found) > 0.5 * len(words):
            continue
        if found:
            at = [m.span() for m in BENCH_WORD.finditer(r["text"].translate(LOW))]
            text = r["text"]
            for a, b in reversed(found):
                text = text[:at[a][0]] + text[at[b - 1][1]:]
            r = {**r, "text": text}
        out.append(r)
    return out


def brute_targets(sizes):
    """Shares 3, 1, 2, repeating; 150 % of all; at most twice a source's size, the excess dealt out again."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    left, full, out = 1.5 * sum(sizes.values()), set(), {}
    while True:
        free = [s for s in names if s not in full]
        total = sum(weight[s] for s in free)
        out.update({s: left * weight[s] / total for s in free})
        over = [s for s in free if out[s] > 2 * sizes[s]]
        if not over:
            return out
        for s in over:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
            full.add(s)


def key(r):
    return repr(sorted(r.items()))


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):  # noqa: F811
    """Input and output rows of every stage, and what run() gives, over the planted tables."""
    docs, labels, items, toxic = planted()
    sf = str(tmp_path_factory.mktemp("planted"))
    spark.createDataFrame(docs, DOC).repartition(3).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int, quality double").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    held, now = [], spark.read.parquet(f"{sf}/documents.parquet")
    for k, (_, fn) in enumerate(corpus_pipeline.STAGES):
        before = [r.asDict() for r in now.collect()]
        fn(spark, now, sf).write.parquet(f"{sf}/stage{k}")
        now = spark.read.parquet(f"{sf}/stage{k}")
        held.append((before, [r.asDict() for r in now.collect()]))
    whole = [r.asDict() for r in corpus_pipeline.run(spark, sf).collect()]
    return held, whole, items, toxic


def same(got, want):
    assert Counter(map(key, got)) == Counter(map(key, want))


def test_toxic_documents_go_and_clean_ones_stay(stages):
    before, after = stages[0][0]
    same(after, [r for r in before if r["doc_id"] not in stages[3]])


def test_near_duplicates(stages):
    before, after = stages[0][1]
    want = brute_near(before)
    same(after, want)
    assert len(before) - len(want) >= 24 + 14 + 1                   # the chain, the copies, "one two"


def test_benchmark_passages(stages):
    before, after = stages[0][2]
    want = brute_clean(before, stages[2])
    same(after, want)
    assert 0 < len(before) - len(want) < 15
    old = {r["doc_id"]: r["text"] for r in before}
    assert sum(old[r["doc_id"]] != r["text"] for r in want) >= 10


def test_sources_meet_their_targets(stages):
    before, after = stages[0][3]
    words = {r["doc_id"]: len(re.findall("[^\x20\x09-\x0d]+", r["text"] or "")) for r in before}
    copies = Counter(r["doc_id"] for r in after)
    assert max(copies.values()) <= 2 and {key(r) for r in after} <= {key(r) for r in before}
    sizes, taken, largest = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in before:
        s, n = r["source"], words[r["doc_id"]]
        sizes[s] += n
        taken[s] += copies[r["doc_id"]] * n
        largest[s] = max(largest[s], n)
    goal = brute_targets(sizes)
    assert sum(goal.values()) == pytest.approx(min(1.5, 2.0) * sum(sizes.values()))
    for s in sizes:
        assert abs(taken[s] - goal[s]) <= 0.05 * goal[s], (s, taken[s], goal[s])
    assert all(copies[i] == 1 for i, n in words.items() if n == 0)


def test_shards_follow_the_curve(spark, stages):  # noqa: F811
    before, after = stages[0][4]
    n = len(before)
    bare = [{k: v for k, v in r.items() if k not in ("shard", "slot")} for r in after]
    same(bare, before)
    per = Counter(r["shard"] for r in after)
    assert set(per) <= set(range(40)) and max(per.values()) - min(per[s] for s in range(40)) <= 1
    after = sorted(after, key=lambda r: (r["shard"], r["slot"]))
    assert [r["slot"] for r in after] == [k for s in range(40) for k in range(per[s])]
    assert [r["shard"] for r in after] == [k * 40 // n for k in range(n)]
    # an independent rank: the documents' cells by plain code, sorted by (curve, size, crc32, id)
    bits = sharding.BITS

    def category(c):
        return 0 if c is None else int(hashlib.md5(c.encode()).hexdigest()[:8], 16) >> (32 - bits)
    sizes = [len((r["text"] or "").encode()) for r in after]
    df = spark.createDataFrame([(k, s) for k, s in enumerate(sizes)], "k long, bytes long")
    byte_cell = {r.k: r.c for r in df.select("k", sharding.scaled(df["bytes"], float(1 << 26)).alias("c")).collect()}
    at = np.array([[category(r["source"]), category(r["lang"]), byte_cell[k]] for k, r in enumerate(after)], np.int64)
    curve = sharding.hilbert_index(at, bits)
    order = [(int(c), s + 16, zlib.crc32((r["text"] or "").encode()), r["doc_id"]) for c, s, r in zip(curve, sizes, after)]
    assert order == sorted(order)


def test_run_gives_the_last_stage(stages):
    assert Counter(map(key, stages[1])) == Counter(map(key, stages[0][4][1]))
