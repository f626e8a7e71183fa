"""Language identification of web pages by Bayesian evidence fusion.

Evidence of a page: its text (a character trigram model per language, trained on the
labelled corpus), the declared markup language, the address suffix, and a prior of its
host.  With the text posterior ``q`` of every page as soft counts, grouped aggregations
estimate ``p(declared | language)``, ``p(suffix | language)`` and the priors, which are
smoothed along the hierarchy: all pages, domain, host.  A page's own count is taken out of
its host's and domain's, so its text isn't counted twice.
"""

from __future__ import annotations

import html
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winnow.llm.common import cut, ready, slices, text_pieces

BITS = 16
# Trigrams of a text overlap, so their log-likelihoods count as those of this many at most.
EVIDENCE = 60.0
# Pseudo counts: of a table's cell, and of the level above in the prior.
SMOOTH, KAPPA = 1.0, 5.0

_FOLD = np.arange(256, dtype=np.int64)
_FOLD[65:91] += 32
_FOLD[:65][[c for c in range(65) if not 48 <= c < 58]] = 32
_FOLD[48:58] = 32
_FOLD[91:97] = _FOLD[123:128] = 32

_TAGS = re.compile(r"<(script|style|noscript|template)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", re.I | re.S)


def page_text(source: str | None) -> str:
    return html.unescape(_TAGS.sub(" ", source)) if source else ""


def trigrams(data: np.ndarray) -> np.ndarray:
    b = _FOLD[data]
    code = b[:-2] << 16 | b[1:-1] << 8 | b[2:]
    return (code * 0x9E3779B1 >> 12) & ((1 << BITS) - 1)


def _count(batches):
    counts = {}
    for b in batches:
        langs = b.column(1).to_pylist()
        for first, data, starts, ends in text_pieces(b.column(0)):
            if len(data) < 3:
                continue
            h = trigrams(data)
            kinds = sorted(set(langs[first:first + len(starts)]))
            kind = np.array([kinds.index(x) for x in langs[first:first + len(starts)]])
            row = np.repeat(np.arange(len(starts)), ends - starts)[:len(h)]
            inside = np.arange(len(h)) + 2 < ends[row]
            n = np.bincount((kind[row] << BITS | h)[inside], minlength=len(kinds) << BITS)
            for k, lang in enumerate(kinds):
                got = counts.setdefault(lang, np.zeros(1 << BITS, np.int64))
                got += n[k << BITS:(k + 1) << BITS]
    for lang, c in counts.items():
        at = np.flatnonzero(c)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(c[at])],
                                         names=["lang", "bucket", "n"])


class TextModel:
    """Smoothed log-probabilities of trigram buckets per language."""

    def __init__(self, langs: list[str], counts: np.ndarray):
        self.langs = langs
        self.logp = np.log((counts + 0.5) / (counts.sum(axis=1, keepdims=True) + 0.5 * counts.shape[1]))

    def logs(self, column) -> np.ndarray:
        """Log-likelihoods per row and language, of ``EVIDENCE`` trigrams at most."""
        out = []
        for _, data, starts, ends in text_pieces(column):
            part = np.zeros((len(starts), len(self.langs)))
            n = np.maximum(ends - starts - 2, 0)
            if len(data) > 2:
                h = trigrams(data)
                last = np.minimum(np.maximum(ends - 2, 0), len(h))
                for k in range(len(self.langs)):
                    sums = np.concatenate(([0.0], np.cumsum(self.logp[k][h])))
                    part[:, k] = np.where(n > 0, sums[last] - sums[np.minimum(starts, len(h))], 0.0)
            out.append(part * np.minimum(1.0, EVIDENCE / np.maximum(n, 1))[:, None])
        return np.concatenate(out) if out else np.zeros((0, len(self.langs)))


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> TextModel:
    """Trigram counts of all texts per label; null labels are left out.

    The number of language labels must be small (a code list): the model has 2**BITS
    cells per label.
    """
    ready(docs.sparkSession)
    d = docs.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    c = (d.where("lang is not null and text is not null").mapInArrow(_count, "lang string, bucket long, n long")
         .groupBy("lang", "bucket").agg(F.sum("n").alias("n"))).toPandas()
    langs = sorted(c.lang.unique())
    counts = np.zeros((len(langs), 1 << BITS))
    counts[[langs.index(x) for x in c.lang], c.bucket] = c.n
    return TextModel(langs, counts)


def _evidence(model, id_type):
    declared = re.compile(r"<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]{2,3})", re.I)

    def run(batches):
        m = model.value
        for b in slices(batches):
            source = b.column(2).to_pylist()
            logs = m.logs(pa.array([page_text(s) for s in source], pa.string()))
            q = np.exp(logs - logs.max(axis=1, keepdims=True)) if len(logs) else logs
            q = q / q.sum(axis=1, keepdims=True) if len(q) else q
            said = [(x[1].lower() if s and (x := declared.search(s)) else "") for s in source]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(said, pa.string()),
                 pa.array(logs.tolist(), pa.list_(pa.float64())), pa.array(q.tolist(), pa.list_(pa.float64()))],
                names=["page_id", "url", "declared", "logs", "q"])
    return run


def _sums(langs):
    return [F.sum(F.get("q", k)).alias(f"n{k}") for k in range(len(langs))]


def identify(pages: DataFrame, model: TextModel, id_col: str = "page_id", url_col: str = "url",
             html_col: str = "html") -> DataFrame:
    """Per page: id, url, lang, confidence, text_lang, declared, suffix, host, posterior (by language).

    A null or empty page has no text evidence; a null address has the host, domain and
    suffix ''; a page without declaration has ''.  Equal posteriors go to the first
    language by name.  Repeated rows each count; a model without languages gives null.
    """
    from pyspark.sql.pandas.types import to_arrow_type
    spark = pages.sparkSession
    ready(spark)
    langs = model.langs
    p = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"),
                     F.col(html_col).cast("string").alias("html"))
    t = p.schema["page_id"].dataType
    if not langs:
        return p.select(F.col("page_id").alias(id_col), F.col("url").alias(url_col), *[
            F.lit(None).cast(k).alias(c) for c, k in (
                ("lang", "string"), ("confidence", "double"), ("text_lang", "string"), ("declared", "string"),
                ("suffix", "string"), ("host", "string"), ("posterior", "map<string,double>"))])
    held = spark.sparkContext.broadcast(model)
    e = p.mapInArrow(_evidence(held, to_arrow_type(t)),
                     f"page_id {t.simpleString()}, url string, declared string, logs array<double>, q array<double>")
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    e = e.withColumn("host", host).withColumn("suffix", F.regexp_extract("host", r"([^.]*)$", 1))
    e = e.withColumn("domain", F.regexp_extract("host", r"([^.]+\.[^.]+)$", 1))
    e = cut(e, "evidence")

    L, n_langs = range(len(langs)), len(langs)

    def table(col: str):
        """log p(value | language), as an array."""
        c = e.groupBy(col).agg(*_sums(langs))
        total = c.agg(*[F.sum(f"n{k}").alias(f"t{k}") for k in L], F.count(F.lit(1)).alias("kinds"))
        logs = F.array(*[F.log((F.col(f"n{k}") + SMOOTH) / (F.col(f"t{k}") + SMOOTH * F.col("kinds"))) for k in L])
        return c.crossJoin(F.broadcast(total)).select(col, logs.alias(f"{col}_logs"))      # total: one row

    def counts(col: str, name: str):
        return e.groupBy(col).agg(F.array(*[F.sum(F.get("q", k)) for k in L]).alias(name),
                                  F.count(F.lit(1)).alias(f"{name}_n"))

    whole = e.agg(F.array(*[(F.coalesce(F.sum(F.get("q", k)), F.lit(0.0)) + 1.0)
                            / (F.count(F.lit(1)) + n_langs) for k in L]).alias("pi"))
    j = (e.join(table("declared"), "declared").join(table("suffix"), "suffix")
         .join(counts("domain", "dom"), "domain").join(counts("host", "own"), "host")
         .crossJoin(F.broadcast(whole)))                                                    # one row

    def prior(k):
        up = (F.get("dom", k) - F.get("q", k) + KAPPA * F.get("pi", k)) / (F.col("dom_n") - 1 + KAPPA)
        return (F.get("own", k) - F.get("q", k) + KAPPA * up) / (F.col("own_n") - 1 + KAPPA)

    parts = [F.get("logs", k) + F.get("declared_logs", k) + F.get("suffix_logs", k)
             + F.log(F.greatest(prior(k), F.lit(1e-9))) for k in L]
    j = j.withColumn("z", F.array(*parts)).withColumn("top", F.array_max("z"))
    j = j.withColumn("e", F.transform("z", lambda x: F.exp(x - F.col("top"))))
    j = j.withColumn("sum", F.aggregate("e", F.lit(0.0), lambda a, x: a + x))
    names = F.array(*[F.lit(x) for x in langs])
    post = F.transform("e", lambda x: x / F.col("sum"))
    return j.select(F.col("page_id").alias(id_col), F.col("url").alias(url_col),
                    F.element_at(names, F.array_position("z", F.col("top")).cast("int")).alias("lang"),
                    (1.0 / F.col("sum")).alias("confidence"),
                    F.element_at(names, F.array_position("logs", F.array_max("logs")).cast("int")).alias("text_lang"),
                    "declared", "suffix", "host", F.map_from_arrays(names, post).alias("posterior"))
