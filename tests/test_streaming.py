"""Streaming: batch equivalence and restart without duplicates."""

from pyspark.sql import functions as F

from conftest import SF_SMALL
from winnow.operators import lexical as lex
from winnow.operators import reweight as rw
from winnow.session import scratch_path
from winnow.sources import tables as tb
from winnow.streaming import reweight_stream as rs


def _run(spark, src, sink, ckpt, anchors):
    stream = spark.readStream.schema("example_id long, text string").option("maxFilesPerTrigger", 1).parquet(src)
    rs.stream_reweight(stream, anchors, sink, ckpt).awaitTermination()


def test_stream_equals_batch_and_restart_is_idempotent(spark):
    docs = tb.examples(spark, SF_SMALL).select("example_id", "text")
    anchors = tb.target(spark, SF_SMALL).withColumnRenamed("item_id", "anchor_id")
    src, sink, ckpt = (scratch_path(spark, n) for n in ("in", "out", "ckpt"))
    docs.repartition(3, "example_id").write.parquet(src)
    _run(spark, src, sink, ckpt, anchors)
    first = sorted((r.example_id, round(r.weight, 12)) for r in spark.read.parquet(sink).collect())
    assert len(first) == docs.count()
    assert spark.read.parquet(sink).select("step").distinct().count() == 3
    # Restart on the same checkpoint: nothing is reprocessed, nothing duplicated.
    _run(spark, src, sink, ckpt, anchors)
    again = sorted((r.example_id, round(r.weight, 12)) for r in spark.read.parquet(sink).collect())
    assert again == first
    # Same weights as the batch form.
    batch = rw.weights_embed(lex.tokenize_whitespace(docs),
                             lex.tokenize_whitespace(anchors, id_col="anchor_id"))
    expect = sorted((r.example_id, round(r.weight, 12)) for r in batch.collect())
    assert first == expect
