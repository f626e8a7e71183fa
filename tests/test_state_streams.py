"""Anchor refresh with arriving anchors, and the streams that keep keyed state."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from winnow.operators import lexical as lex
from winnow.operators import policies as pol
from winnow.operators import reweight as rw
from winnow.operators import vectors as vec
from winnow.session import scratch_path
from winnow.streaming import reweight_stream as rs

EX = "example_id long, step long, text string"
AN = "anchor_id long, effective_step long, text string"
WORDS = ["red", "green", "blue", "sun", "moon", "tree", "river", "stone"]


def _texts(rng, n):
    return [" ".join(rng.choices(WORDS, k=rng.randint(1, 12))) for _ in range(n)]


@pytest.mark.parametrize("interval", [50, 7, 0, -1])
def test_anchor_refresh_is_as_of_mean(spark, interval):
    rng = np.random.default_rng(3)
    anchors = [(int(e), [float(x) for x in rng.normal(size=3)]) for e in [-4, 0, 0, 3, 7, 8, 49, 50, 51, 120, 900]]
    steps = [0, 1, 6, 7, 8, 49, 50, 99, 100, 130, 150]
    got = {r.step: (r.version, r.vec) for r in rw.anchor_refresh(
        spark.createDataFrame([(s,) for s in steps], "step long"),
        spark.createDataFrame(anchors, "effective_step long, vec array<double>").repartition(3), interval).collect()}
    r = interval or 50
    for s in steps:
        v = 0 if r < 0 else s // r * r
        seen = [x for e, x in anchors if max(e, 0) <= v]
        assert got[s][0] == v and np.allclose(got[s][1], np.mean(seen, axis=0))


def test_anchor_refresh_without_anchors(spark):
    steps = spark.createDataFrame([(0,), (60,)], "step long")
    late = spark.createDataFrame([(51, [1.0, 2.0])], "effective_step long, vec array<double>")
    assert {r.step: r.vec for r in rw.anchor_refresh(steps, late).collect()} == {0: None, 60: None}
    assert {r.step: r.vec for r in rw.anchor_refresh(steps, late.limit(0)).collect()} == {0: None, 60: None}


def _append(spark, rows, schema, path):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def _reweigh(spark, paths, sink, ckpt, interval):
    ex = spark.readStream.schema(EX).option("maxFilesPerTrigger", 1).parquet(paths[0])
    an = spark.readStream.schema(AN).option("maxFilesPerTrigger", 1).parquet(paths[1])
    rs.stream_reweight(ex, an, sink, ckpt, interval=interval, shards=3).awaitTermination()


def test_stream_follows_arriving_anchors_and_restarts(spark):
    rng = random.Random(5)
    ex = [(i, i // 4, t) for i, t in enumerate(_texts(rng, 160))]                      # steps 0 to 39
    an = [(k, e, t) for k, (e, t) in enumerate(zip([0, 0, 5, 10, 11, 20, 27, 30], _texts(rng, 8)))]
    phi = vec.encode_position_pool(lex.tokenize_whitespace(spark.createDataFrame(ex, EX)))
    centers = rw.anchor_refresh(
        spark.createDataFrame([(s,) for s in range(40)], "step long"),
        vec.encode_position_pool(lex.tokenize_whitespace(spark.createDataFrame(an, AN), id_col="anchor_id"), id_col="anchor_id")
        .join(spark.createDataFrame(an, AN), "anchor_id"), 10)
    center = {r.step: np.array(r.vec) for r in centers.collect()}
    assert len({r.version for r in centers.collect()}) == 4
    expect = {r.example_id: float(np.array(r.vec) @ center[r.example_id // 4]) for r in phi.collect()}
    cuts = [(0, 10), (10, 20), (20, 27), (27, 100)]
    runs = []
    for stop in (None, 2):                                                             # at once, and in two runs
        paths, sink, ckpt = [scratch_path(spark, n) for n in ("ex", "an")], scratch_path(spark, "o"), scratch_path(spark, "c")
        for n, (a, b) in enumerate(cuts):
            _append(spark, [r for r in ex if a <= r[1] < b], EX, paths[0])
            _append(spark, [r for r in an if a <= r[1] < b], AN, paths[1])
            if n + 1 == stop:
                _reweigh(spark, paths, sink, ckpt, 10)
                assert spark.read.parquet(sink).count() == 80
        _reweigh(spark, paths, sink, ckpt, 10)
        _reweigh(spark, paths, sink, ckpt, 10)                                         # nothing new: nothing changes
        rows = spark.read.parquet(sink).collect()
        assert len(rows) == 160 and all(r.step == r.example_id // 4 for r in rows)
        runs.append({r.example_id: (r.score, r.weight) for r in rows})
    for got in runs:
        assert all(got[i][0] == pytest.approx(expect[i], abs=1e-12) for i in expect)
        assert all(got[i][1] == pytest.approx(1 / (1 + np.exp(-expect[i]))) for i in expect)


def test_anchor_sums_settle():
    sums = rs.AnchorSums(10)
    for e in (0, 3, 12, 40):
        sums.add(e, np.array([float(e), 1.0]))
    before = [sums.centroid(v) for v in (20, 40)]
    sums.settle(20)
    assert sorted(sums.sums) == [20, 40]
    again = rs.AnchorSums(10, sums.saved())
    assert all((a == b).all() for a, b in zip(before, [again.centroid(v) for v in (20, 40)]))


def test_greats_batches_do_not_depend_on_files(spark):
    rng = np.random.default_rng(7)
    n, size, shards, k = 230, 16, 3, 4
    rows = [(int(i), [float(x) for x in rng.normal(size=5)]) for i in range(n)]
    goal = [float(x) for x in rng.normal(size=5)]
    gval = spark.createDataFrame([(goal,)], "gval array<double>")
    schema = "example_id long, grad array<double>"
    where = {r.example_id: r.s for r in spark.createDataFrame(rows, schema).select(
        "example_id", F.pmod(F.xxhash64("example_id"), F.lit(shards)).alias("s")).collect()}
    expect = set()
    for s in range(shards):
        own = [r for r in rows if where[r[0]] == s]
        for b in range(0, len(own), size):
            ids, g = np.array([r[0] for r in own[b:b + size]]), np.array([r[1] for r in own[b:b + size]])
            for rank, j in enumerate(pol.greats_batch(ids, g, np.array(goal), k, 0.1), 1):
                expect.add((b // size * shards + s, int(ids[j]), rank))
    for cuts in ([230], [3, 50, 51, 200, 230]):
        src, sink, ckpt = (scratch_path(spark, x) for x in ("g", "go", "gc"))
        a = 0
        for b in cuts:
            _append(spark, rows[a:b], schema, src)
            a = b
        read = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
        rs.stream_greats(read, gval, sink, ckpt, k, 0.1, batch_size=size, shards=shards).awaitTermination()
        full = {(r.batch_id, r.example_id, r.rank) for r in spark.read.parquet(sink).collect()}
        assert full < expect                                     # the rest waits
        _append(spark, [(10**9, None)], schema, src)
        rs.stream_greats(read, gval, sink, ckpt, k, 0.1, batch_size=size, shards=shards).awaitTermination()
        got = [(r.batch_id, r.example_id, r.rank) for r in spark.read.parquet(sink).collect()]
        assert set(got) == expect and len(got) == len(expect)


def test_rounds_are_written_by_all_tasks(spark, tmp_path):
    """F8: no round of the stream's input goes through one task; each round is one micro-batch."""
    from winnow.plans.queries import _in_rounds
    rows = spark.createDataFrame([(i, i // 4, t) for i, t in enumerate(_texts(random.Random(2), 64))], EX).repartition(4)
    seen = []

    def start(stream):
        def on_batch(df, step):
            got = df.select("example_id", F.input_file_name().alias("f")).collect()
            seen.append((sorted(r.example_id for r in got), len({r.f for r in got})))
        return stream.writeStream.foreachBatch(on_batch).option("checkpointLocation", str(tmp_path / "ckpt")) \
            .trigger(availableNow=True).start()
    _in_rounds(spark, [(rows, F.col("step"))], [3, 7, 11], start)
    assert [ids for ids, _ in seen] == [list(range(k, k + 16)) for k in (0, 16, 32, 48)]
    assert all(n > 1 for _, n in seen)
