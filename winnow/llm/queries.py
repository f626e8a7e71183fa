"""One registered query per operator: ``(spark, sf_dir) -> DataFrame`` over whole tables."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from winnow.llm import (chatformat, convtrie, decontaminate, exactdedup, langid, minmax, mixing, ngramjoin, periodic,
                        secretscan, sharding, toxicity, wrapper)
from winnow.session import table_path

SHARDS = 40


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))


def op1_decontamination(spark, sf_dir):
    """Words of every document that lie in an occurrence of a benchmark window."""
    c = decontaminate.contamination(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))
    return c.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op2_language_id(spark, sf_dir):
    """Language of every page, the text model learnt from all documents."""
    model = langid.train(_read(spark, sf_dir, "documents"))
    return langid.identify(_read(spark, sf_dir, "pages"), model)


def op3_hilbert_shards(spark, sf_dir):
    """All documents in 40 shards of equal row counts along the curve."""
    s = sharding.shard(_read(spark, sf_dir, "documents"), SHARDS)
    return s.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                    F.lit(None).cast("int").alias("grown_shard"), "curve")


def op4_wrapper_text(spark, sf_dir):
    """Main text of every page."""
    return wrapper.extract(_read(spark, sf_dir, "pages"))


def op5_toxicity(spark, sf_dir):
    """Toxicity score of every document."""
    docs = _read(spark, sf_dir, "documents")
    model = toxicity.train(toxicity.training_rows(docs, _read(spark, sf_dir, "labels")))
    s = toxicity.score(docs.select("doc_id", "text"), model)
    return s.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score",
                    (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op6_chat_format(spark, sf_dir):
    """Digests of every conversation, read back from its formatted turns.

    The rows go through the layout registry as JSON records of four layouts.
    """
    rows = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], rows.schema)
    records = chatformat.as_records(rows.unionByName(extra).withColumnRenamed("conv_id", "conv"))
    return chatformat.digest(chatformat.format_turns(chatformat.canonical_turns(records, "conv", "record")))


def op7_exact_dedup(spark, sf_dir):
    """Every document against a fresh digest index."""
    return exactdedup.dedup_once(_read(spark, sf_dir, "documents"))


def op8_ngram_join(spark, sf_dir):
    """Components of documents with Jaccard of 0.75 or more on 5-word shingles."""
    return ngramjoin.jaccard_components(_read(spark, sf_dir, "documents"))


def op9_secret_scan(spark, sf_dir):
    """Secrets of every document."""
    return secretscan.report(_read(spark, sf_dir, "documents"))


def op10_entropy_mix(spark, sf_dir):
    """Words that the mix takes from every document."""
    m = mixing.mix(_read(spark, sf_dir, "documents"))
    return m.select("doc_id", "size", "source_size", "target", "taken", "copies", "rate")


def op11_minmax_near_dedup(spark, sf_dir):
    """Components of documents with Jaccard of 0.85 or more on 5-word shingles."""
    return minmax.near_duplicates(_read(spark, sf_dir, "documents"))


def op12_conversation_trie(spark, sf_dir):
    """Prefix trie of the conversations, each rebuilt on the first turns of its family's first one."""
    return convtrie.trie(*convtrie.grafted(convtrie.turns(_read(spark, sf_dir, "conversations"))))


def looped(doc_id, words: list) -> list:
    """Every tenth document's words from some place on repeat their first few; a null id leaves them."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def op13_periodic_runs(spark, sf_dir):
    """Periodic runs of words in every document."""
    r = periodic.report(_read(spark, sf_dir, "documents"), edit=looped)
    return r.drop("n_words")


def pipeline(spark, sf_dir):
    """The stages of corpus_pipeline.py over documents."""
    import corpus_pipeline
    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (
    op1_decontamination, op2_language_id, op3_hilbert_shards, op4_wrapper_text, op5_toxicity, op6_chat_format,
    op7_exact_dedup, op8_ngram_join, op9_secret_scan, op10_entropy_mix,
    op11_minmax_near_dedup, op12_conversation_trie, op13_periodic_runs, pipeline)}
