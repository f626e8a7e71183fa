"""Language identification and the toxicity classifier against plain Python versions of their formulas."""

import html
import math
import os
import random
import re
import sys
from collections import Counter, defaultdict

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from conftest import SF_SMALL, spark  # noqa: E402,F401

from winnow.llm import langid, toxicity  # noqa: E402
from winnow.llm.queries import QUERIES  # noqa: E402

MASK = (1 << 64) - 1


def letters(text):
    """UTF-8 with A-Z lower-cased and every other ASCII byte but a-z as a space."""
    return [b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in text.encode()]


def trigram_buckets(text):
    b = letters(text)
    return [((b[i] << 16 | b[i + 1] << 8 | b[i + 2]) * 0x9E3779B1 >> 12) & 0xFFFF for i in range(len(b) - 2)]


def brute_languages(docs, pages):
    """page_id -> (lang, posterior) for distinct page ids."""
    counts = defaultdict(Counter)
    for text, lang in docs:
        if text is not None and lang is not None:
            counts[lang].update(trigram_buckets(text))
    langs = sorted(x for x in counts if counts[x])
    total = {x: sum(counts[x].values()) + 0.5 * 65536 for x in langs}
    rows = []
    for page_id, url, source in pages:
        text = html.unescape(langid._TAGS.sub(" ", source)) if source else ""
        grams = trigram_buckets(text)
        scale = min(1.0, 60.0 / max(len(grams), 1))
        logs = [scale * sum(math.log((counts[x][g] + 0.5) / total[x]) for g in grams) for x in langs]
        e = [math.exp(v - max(logs)) for v in logs]
        said = re.search(r"<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]{2,3})", source or "", re.I)
        host = re.match(r"[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", url or "")
        host = host[1].lower() if host else ""
        parts = host.split(".")
        rows.append((page_id, logs, [v / sum(e) for v in e], said[1].lower() if said else "", parts[-1],
                     ".".join(parts[-2:]) if len(parts) > 1 and all(parts[-2:]) else "", host))
    L = range(len(langs))

    def soft(at):
        out = defaultdict(lambda: [0.0] * (len(langs) + 1))
        for r in rows:
            for k in L:
                out[r[at]][k] += r[2][k]
            out[r[at]][-1] += 1
        return out
    declared, suffix, domain, host = (soft(k) for k in (3, 4, 5, 6))
    pi = [(sum(r[2][k] for r in rows) + 1) / (len(rows) + len(langs)) for k in L]

    def likelihood(table, value, k):
        return math.log((table[value][k] + 1) / (sum(t[k] for t in table.values()) + len(table)))
    out = {}
    for page_id, logs, q, said, suf, dom, own in rows:
        z = []
        for k in L:
            up = (domain[dom][k] - q[k] + 5 * pi[k]) / (domain[dom][-1] - 1 + 5)
            prior = (host[own][k] - q[k] + 5 * up) / (host[own][-1] - 1 + 5)
            z.append(logs[k] + likelihood(declared, said, k) + likelihood(suffix, suf, k) + math.log(max(prior, 1e-9)))
        e = [math.exp(v - max(z)) for v in z]
        out[page_id] = (langs[z.index(max(z))], {x: v / sum(e) for x, v in zip(langs, e)})
    return out


def test_language_query_against_plain_python(spark):  # noqa: F811
    docs = [(r.text, r.lang) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("text", "lang").collect()]
    pages = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/pages.parquet").select("page_id", "url", "html").collect()]
    want = brute_languages(docs, pages)
    got = {r.page_id: r for r in QUERIES["op2_language_id"](spark, SF_SMALL).collect()}
    assert got.keys() == want.keys()
    for k, (lang, posterior) in want.items():
        assert got[k].lang == lang
        assert got[k].posterior == pytest.approx(posterior, abs=1e-9)


def test_language_of_odd_pages_against_plain_python(spark):  # noqa: F811
    docs = [("the cat and the dog run " * 9, "en"), ("der hund und die katze laufen " * 9, "de"), ("le chat et le chien " * 9, "fr"),
            (None, "en"), ("x", None), ("ab", "xx")]
    pages = [(1, "https://user@A.Example.DE:80/x?y", '<HTML dir=ltr LANG="DE">Hund &amp; Katze'), (2, None, None), (3, "no address", ""),
             (4, "http://localhost/", "<script>the dog</script><p>le chat"), (5, "http://b.example.de", "the dog <!-- der hund -->"),
             (6, "http://a.example.de/2", "Ωmega ß é 漢字"), (7, "http://a.example.de/3", "<html lang=en><p>" + "die katze " * 400)]
    model = langid.train(spark.createDataFrame(docs, "text string, lang string"))
    got = {r.page_id: r for r in langid.identify(spark.createDataFrame(pages, "page_id long, url string, html string"), model).collect()}
    for k, (lang, posterior) in brute_languages(docs, pages).items():
        assert got[k].lang == lang and got[k].posterior == pytest.approx(posterior, abs=1e-9)


def gram_set(text):
    b = [32 if 9 <= c <= 13 else c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()]
    out = set()
    for n in (3, 4, 5):
        for i in range(len(b) - n + 1):
            code = sum(b[i + k] << (8 * k) for k in range(n))
            h = (code + (n << 40)) * 0x9E3779B97F4A7C15 & MASK
            h = (h ^ h >> 29) * 0xBF58476D1CE4E5B9 & MASK
            out.add(h >> 44)
    return out


def brute_scores(train, texts, features):
    """Log-count ratios over all rows, the best buckets, and the exact optimum of the regression."""
    sets, y = [gram_set(t) for t, _ in train], np.array([c for _, c in train], float)
    n1, n0 = int(y.sum()), int((1 - y).sum())
    toxic, clean = Counter(), Counter()
    for s, c in zip(sets, y):
        (toxic if c else clean).update(s)
    ranked = []
    for b in set(toxic) | set(clean):
        if toxic[b] + clean[b] >= 3:
            p1, p0 = (toxic[b] + 1) / (n1 + 2), (clean[b] + 1) / (n0 + 2)
            p = (toxic[b] + clean[b] + 2) / (n1 + n0 + 4)
            ranked.append((-abs((p1 - p0) / math.sqrt(p * (1 - p) * (1 / n1 + 1 / n0))), b, math.log(p1) - math.log(p0)))
    ranked = sorted(ranked)[:features]

    def matrix(some):
        return np.array([[r if b in s else 0.0 for _, b, r in ranked] + [1.0] for s in some])
    x, w = matrix(sets), np.zeros(len(ranked) + 1)
    ridge = np.append(np.ones(len(ranked)), 0.0)
    for _ in range(60):
        p = 1 / (1 + np.exp(-x @ w))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (p - y) + ridge * w)
        w = w - step
        if np.abs(step).max() < 1e-10:
            break
    return 1 / (1 + np.exp(-matrix([gram_set(t) for t in texts]) @ w))


@pytest.mark.parametrize("features", [40, 8192])
def test_toxicity_scores_against_plain_python(spark, features):  # noqa: F811
    rng = random.Random(21)
    words = ["sun", "moon", "Tree", "river\tbed", "stone", "clöud", "grass", "wind"]
    train = []
    for k in range(400):
        w = rng.choices(words, k=rng.randint(1, 25))
        bad = k % 4 == 0
        if rng.random() < (0.8 if bad else 0.1):                    # neither class is marked without exception
            w[rng.randrange(len(w))] = rng.choice(["gnarfel", "BRULZIG"])
        train.append((" ".join(w), int(bad)))
    train += [("", 0), (None, 0), ("ab", 1)]
    texts = [t for t, _ in train] + ["unseen words only", "gnarfel " * 500, "a\x0bb"]
    model = toxicity.train(spark.createDataFrame([(k, t, c) for k, (t, c) in enumerate(train)], "id long, text string, toxic int"),
                           features=features)
    got = {r.k: r.score for r in toxicity.score(spark.createDataFrame(list(enumerate(texts)), "k long, text string"), model).collect()}
    want = brute_scores(train, texts, features)
    worst = max(abs(got[k] - want[k]) for k in range(len(texts)))
    assert worst < 0.02, worst                                      # the fit stops at a relative gain of 1e-5
