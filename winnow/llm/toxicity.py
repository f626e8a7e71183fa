"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

1. *Ratios.*  Over all labelled training rows, how many documents of each class contain
   each character n-gram (hashed to ``2**BITS`` buckets): one grouped aggregation.
   ``r = log((toxic + 1) / (n_toxic + 2)) - log((clean + 1) / (n_clean + 2))``.
2. *Classifier.*  The ``features`` buckets that separate the classes best become features
   ``r * [present]``; a logistic regression with L2 penalty is fitted to a sample of about
   ``fit_rows`` training rows (drawn by the hash of the id).  A class with less than a tenth
   of the rows is drawn at a higher rate, up to all its rows, and the other one's rows
   weigh more for that.
3. *Scores.*  One pass over all whole texts, no shuffle; the model is 4 MB.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winnow.llm.common import cut, fresh, ready, small, text_pieces, with_text

BITS = 20
LENGTHS = (3, 4, 5)
# Bounds of the fit: labelled rows (about) and n-gram buckets.
FIT_ROWS = 10_000
FEATURES = 8_192
# Buckets in fewer training documents than this are left out.
MIN_DOCS = 3
THRESHOLD = 0.7
# Buckets that a task of the count returns at once.
COUNT_ROWS = 1 << 16

_FOLD = np.arange(256, dtype=np.uint64)
_FOLD[65:91] += 32
_FOLD[[9, 10, 11, 12, 13]] = 32


def gram_buckets(data: np.ndarray, lengths=LENGTHS, bits: int = BITS):
    """Yield ``(length, bucket of the n-gram that starts at each byte)``."""
    b = _FOLD[data]
    code = b
    for n in range(2, max(lengths) + 1):
        code = code[:-1] | (b[n - 1:] << np.uint64(8 * (n - 1)))
        if n in lengths and len(code):
            h = (code + np.uint64(n << 40)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
            h *= np.uint64(0xBF58476D1CE4E5B9)
            yield n, (h >> np.uint64(64 - bits)).astype(np.int64)


def presence(data, starts, ends, chosen: np.ndarray):
    """Distinct ``(row, bucket)`` pairs of a piece with ``chosen[bucket]``."""
    pairs = []
    for n, h in gram_buckets(data):
        pos = np.flatnonzero(chosen[h])
        row = np.searchsorted(starts, pos, "right") - 1
        ok = pos + n <= ends[row]
        pairs.append((row[ok] << BITS) | h[pos[ok]])
    u = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.int64)
    return u >> BITS, u & ((1 << BITS) - 1)


def _count(batches):
    """mapInArrow: (text, toxic) -> (bucket, clean, toxic documents) per task; bucket -1 counts rows."""
    every = np.ones(1 << BITS, bool)
    counts = np.zeros((2, (1 << BITS) + 1), np.int64)
    for b in batches:
        y = np.asarray(b.column(1).to_pylist(), np.int64)
        np.add.at(counts[:, -1], y, 1)
        for first, data, starts, ends in text_pieces(b.column(0)):
            row, bucket = presence(data, starts, ends, every)
            label = y[first + row]
            np.add.at(counts, (label, bucket), 1)
    at = np.flatnonzero(counts.any(axis=0))
    for k in range(0, len(at), COUNT_ROWS):
        some = at[k:k + COUNT_ROWS]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.where(some == 1 << BITS, -1, some)), pa.array(counts[0, some]), pa.array(counts[1, some])],
            names=["bucket", "clean", "toxic"])


def _present(chosen):
    """mapInArrow: (text, toxic) -> (toxic, present chosen buckets)."""
    def run(batches):
        for b in batches:
            for first, data, starts, ends in text_pieces(b.column(0)):
                row, bucket = presence(data, starts, ends, chosen.value)
                off = np.searchsorted(row, np.arange(len(starts) + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [b.column(1).slice(first, len(starts)),
                     pa.ListArray.from_arrays(pa.array(off), pa.array(bucket.astype(np.int32)))],
                    names=["toxic", "buckets"])
    return run


def fit_logistic(row, col, scale, n_rows: int, y, weight, penalty: float = 1.0, steps: int = 25):
    """Logistic regression on features ``scale[col]`` at ``(row, col)``, rows weighted.

    Newton steps with conjugate gradients; the intercept isn't penalized.
    """
    n_cols = len(scale)
    w, bias = np.zeros(n_cols), np.log((weight @ y + 0.5) / (weight @ (1 - y) + 0.5))

    def dot(v):
        return np.bincount(row, (scale * v)[col], n_rows)

    def back(v):
        return scale * np.bincount(col, v[row], n_cols)

    def loss(w, bias):
        z = dot(w) + bias
        return (weight * np.logaddexp(0, np.where(y == 1, -z, z))).sum() + penalty / 2 * (w @ w)

    at = loss(w, bias)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(dot(w) + bias, -500, 500)))
        e = weight * (p - y)
        g, gb = back(e) + penalty * w, e.sum()
        h = weight * np.maximum(p * (1 - p), 1e-9)
        # conjugate gradients for the Newton direction
        x, xb = np.zeros(n_cols), 0.0
        r, rb = -g, -gb
        d, db = r.copy(), rb
        rr = start = r @ r + rb * rb
        for _ in range(20):
            if rr <= 1e-4 * start or rr < 1e-12:
                break
            q = h * (dot(d) + db)
            hd, hdb = back(q) + penalty * d, q.sum()
            a = rr / (d @ hd + db * hdb)
            x, xb, r, rb = x + a * d, xb + a * db, r - a * hd, rb - a * hdb
            new = r @ r + rb * rb
            d, db, rr = r + new / rr * d, rb + new / rr * db, new
        step = 1.0
        while step > 1e-4 and loss(w + step * x, bias + step * xb) > at:
            step /= 2
        w, bias = w + step * x, bias + step * xb
        now = loss(w, bias)
        if at - now < 1e-5 * max(at, 1.0):
            break
        at = now
    return w, bias


class Model:
    """``weight[bucket]`` (r times the fitted weight) and an intercept."""

    def __init__(self, weight: np.ndarray, bias: float):
        self.weight, self.bias = weight, bias
        self.used = weight != 0

    def scores(self, column) -> np.ndarray:
        out = []
        for _, data, starts, ends in text_pieces(column):
            row, bucket = presence(data, starts, ends, self.used)
            z = self.bias + np.bincount(row, self.weight[bucket], len(starts))
            out.append(1 / (1 + np.exp(-np.clip(z, -500, 500))))
        return np.concatenate(out) if out else np.zeros(0)


def train(labelled: DataFrame, fit_rows: int = FIT_ROWS, features: int = FEATURES) -> Model:
    """``labelled(id, text, toxic 0/1)`` -> model.

    Without rows the score is 0.5; with one class only it is that class's smoothed share.
    """
    spark = labelled.sparkSession
    ready(spark)
    lab = labelled.select("text", F.col("toxic").cast("int").alias("toxic"), "id")
    c = (lab.select("text", "toxic").mapInArrow(_count, "bucket long, clean long, toxic long").groupBy("bucket")
         .agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
         .where((F.col("clean") + F.col("toxic") >= MIN_DOCS) | (F.col("bucket") < 0)))
    c = c.toPandas()                                        # at most 2**BITS + 1 rows
    rows = c[c.bucket < 0]
    n0, n1 = (int(rows[k].sum()) for k in ("clean", "toxic"))
    weight = np.zeros(1 << BITS)
    if not n0 or not n1:
        return Model(weight, float(np.log((n1 + 1) / (n0 + 1))))
    c = c[c.bucket >= 0]
    p1, p0 = (c.toxic + 1) / (n1 + 2), (c.clean + 1) / (n0 + 2)
    ratio = np.log(p1) - np.log(p0)
    p = (c.toxic + c.clean + 2) / (n0 + n1 + 4)
    z = (p1 - p0) / np.sqrt(p * (1 - p) * (1 / n1 + 1 / n0))
    best = np.lexsort((c.bucket, -np.abs(z)))[:features]     # ties by bucket
    buckets, ratio = c.bucket.to_numpy()[best], ratio.to_numpy()[best]
    at = np.full(1 << BITS, -1, np.int64)
    at[buckets] = np.arange(len(buckets))
    # a rare class is drawn at a higher rate, so that a tenth of the fit rows is its own
    share = [min(1.0, max(fit_rows / (n0 + n1), fit_rows / 10 / n)) for n in (n0, n1)]
    below = [F.lit(int(x * (1 << 30))) for x in share]
    sample = lab.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < F.when(F.col("toxic") == 1, below[1]).otherwise(below[0]))
    chosen = spark.sparkContext.broadcast(at >= 0)
    got = (sample.select("text", "toxic").mapInArrow(_present(chosen), "toxic int, buckets array<int>")
           .toArrow())                                       # about fit_rows lists of at most `features`
    y = got.column("toxic").to_numpy().astype(float)
    lists = got.column("buckets").combine_chunks()
    k = len(buckets)
    cells = np.zeros(0, np.int64)
    if len(y):
        off = lists.offsets.to_numpy()
        col = at[lists.values.to_numpy()]
        # a fixed row order makes the sums independent of the partitioning
        sums = np.add.reduceat(np.append(col + 1.0, 0.0) ** 1.5, off[:-1]) * (np.diff(off) > 0)
        rank = np.empty(len(y), np.int64)
        order = np.lexsort((sums, y))
        rank[order] = np.arange(len(y))
        cells = np.repeat(rank, np.diff(off)) * k + col
        y = y[order]
        del got, lists, col
        cells.sort()
    if not len(y) or y.min() == y.max():
        raise ValueError(f"the fit sample of {len(y)} rows holds one class only ({n0} clean, {n1} toxic rows in all); "
                         "fit_rows is too small")
    row, col = np.divmod(cells, k)
    del cells
    w, bias = fit_logistic(row, col, ratio, len(y), y, max(share) / np.where(y == 1, share[1], share[0]))
    weight[buckets] = w * ratio
    return Model(weight, float(bias))


def held_out(id_col):
    """crc32 of the id as text, mod 3, is 1 (a null id: false)."""
    return F.coalesce(F.crc32(id_col.cast("string")) % 3 == 1, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", label_col="toxic"):
    """Labelled rows that aren't held out: ``(id, text, toxic)``.

    Several labels of one id count by majority (a tie is toxic); null ids and labels don't count.
    """
    lab = (labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(F.col(id_col)))
           .groupBy(F.col(id_col).alias("id")).agg((F.avg(label_col) >= 0.5).cast("int").alias("toxic")))
    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return d.join(small(cut(lab, "labels")), "id")


def _scorer(model, text_at: int, names):
    def run(batches):
        m = model.value
        for b in batches:
            score = m.scores(b.column(text_at))
            yield pa.RecordBatch.from_arrays([*b.columns[:len(names) - 1], pa.array(score, pa.float64())], names=names)
    return run


def score(docs: DataFrame, model: Model, text_col: str = "text", column: str = "score") -> DataFrame:
    """``docs`` plus ``column``: the probability of a toxic label, from the whole text alone.

    Null and empty texts get the intercept's score.  Repeated rows score alike.
    """
    spark = docs.sparkSession
    ready(spark)
    cols, safe = docs.columns, [f"c{k}" for k in range(len(docs.columns))]
    d, text_at, added = with_text(docs, text_col)
    d = d.toDF(*safe, *["t"] * added)
    schema = ", ".join(f"{n} {f.dataType.simpleString()}" for n, f in zip(safe, docs.schema)) + ", score double"
    held = spark.sparkContext.broadcast(model)
    out = d.mapInArrow(_scorer(held, text_at, [*safe, "score"]), schema)
    return out.toDF(*cols, column)


def without_toxic(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text",
                  threshold: float = THRESHOLD, **options) -> DataFrame:
    """``docs`` scored below ``threshold`` by a model learnt from ``labels``; same columns."""
    model = train(training_rows(docs, labels, id_col, text_col), **options)
    s = fresh("score", docs.columns)
    return score(docs, model, text_col, s).where(F.col(s) < threshold).drop(s)
