"""Structured Streaming reweighting.

* With anchors that arrive as a stream, reweighting keeps keyed state: every shard holds
  the anchor sums per refresh version, adds anchors as they come, and weighs the examples
  of its shard by the centroid in force at their step (I5).  Anchors are few and go to all
  shards; examples are hashed to one, so no key holds the stream.
* With a fixed anchor set each micro-batch is one training step: ``foreachBatch(df, step)``
  weighs its rows with the same DataFrame functions as the batch form and writes them to
  ``{sink}/step={step}`` with mode overwrite, so a replayed batch after a failure rewrites
  the same files (idempotent).
* GREATS forms training batches of exactly ``batch_size`` rows in arrival order; rows that
  don't fill one wait in the shard's state for the next micro-batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from winnow.functions.vector import dot, to_double
from winnow.operators.budget import ID
from winnow.operators.lexical import tokenize_whitespace
from winnow.operators.policies import greats_batch
from winnow.operators.reweight import gate_expr
from winnow.operators.vectors import centroid, encode_position_pool
from winnow.session import materialize

# Groups that a stream's rows are dealt to; the state of each is one task's.
SHARDS = 16


def _spread(df: DataFrame) -> DataFrame:
    """A micro-batch with fewer partitions than cores (one small file) is spread
    round-robin; large batches keep their splits (no extra shuffle)."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def _started(writer, checkpoint: str, available_now: bool) -> StreamingQuery:
    w = writer.option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


def stream_reweight(stream: DataFrame, anchors: DataFrame, sink: str, checkpoint: str,
                    interval: int = 50, tau: float = 1.0, eps: float = 1e-8, w_min: float = 0.0,
                    w_max: float = 10.0, text_col: str = "text", id_col: str = ID,
                    anchor_id: str = "anchor_id", available_now: bool = True,
                    shards: int = SHARDS, spread: int | None = None) -> StreamingQuery:
    """Weight each arriving example; sink rows ``(step, example_id, score, weight)``.

    If ``anchors`` is a stream, it carries ``effective_step`` and ``stream`` carries ``step``:
    an example is weighed by the anchors with ``effective_step`` up to its version
    ``floor(step / interval) * interval`` (NULL while there are none).  Steps don't go back
    between micro-batches, and an anchor comes no later than the first example whose version
    counts it; one that comes later counts from then on.  ``spread`` deals a source of few
    splits over so many tasks before the texts are encoded.  A static ``anchors`` never changes,
    and the step is the micro-batch.
    """
    if anchors.isStreaming:
        return _stateful(stream, anchors, sink, checkpoint, interval or 50, tau, eps, w_min, w_max, text_col, id_col,
                         anchor_id, available_now, shards, spread)
    atok = tokenize_whitespace(anchors, text_col, anchor_id)
    center = materialize(centroid(encode_position_pool(atok, eps=eps, id_col=anchor_id)).select(F.col("vec").alias("_c")))

    def on_batch(df: DataFrame, step: int) -> None:
        df = _spread(df)
        phi = encode_position_pool(tokenize_whitespace(df, text_col, id_col), eps=eps, id_col=id_col)
        scored = phi.crossJoin(F.broadcast(center)).select(
            F.lit(step).cast("long").alias("step"), id_col, dot(F.col("vec"), F.col("_c")).alias("score"))
        out = scored.withColumn("weight", gate_expr(F.col("score"), tau, eps, w_min, w_max))
        out.write.mode("overwrite").parquet(f"{sink}/step={step}")
    return _started(stream.writeStream.foreachBatch(on_batch), checkpoint, available_now)


class AnchorSums:
    """Sums of anchor vectors by the first refresh version that counts them."""

    def __init__(self, interval: int, saved: tuple | None = None):
        self.interval, self.sums = interval, {}
        if saved:
            versions, counts, flat = saved
            rows = np.asarray(flat, np.float64).reshape(len(versions), -1)
            self.sums = {int(v): [int(c), row.copy()] for v, c, row in zip(versions, counts, rows)}

    def saved(self) -> tuple:
        v = sorted(self.sums)
        return v, [self.sums[x][0] for x in v], [float(x) for y in v for x in self.sums[y][1]]

    def version(self, step: int) -> int:
        return 0 if self.interval < 0 else step // self.interval * self.interval

    def add(self, effective: int, vec: np.ndarray) -> None:
        early = max(effective, 0)
        if self.interval < 0 and early:
            return                                    # after the only refresh
        v = 0 if self.interval < 0 else -(-early // self.interval) * self.interval
        held = self.sums.setdefault(v, [0, np.zeros(len(vec))])
        held[0] += 1
        held[1] += vec

    def centroid(self, version: int) -> np.ndarray | None:
        seen = [s for v, s in sorted(self.sums.items()) if v <= version]
        n = sum(c for c, _ in seen)
        return sum(x for _, x in seen) / n if n else None

    def settle(self, version: int) -> None:
        """No earlier version will be asked again: one entry stands for all up to this one."""
        old = sorted(v for v in self.sums if v <= version)
        if len(old) > 1:
            held = [self.sums.pop(v) for v in old]
            self.sums[old[-1]] = [sum(c for c, _ in held), sum(x for _, x in held)]


def _stateful(stream, anchors, sink, checkpoint, interval, tau, eps, w_min, w_max, text_col, id_col, anchor_id,
              available_now, shards, spread):
    ex = stream.select(F.struct(F.lit(False).alias("anchor"), F.col(id_col).cast("long").alias("id"),
                                F.col("step").cast("long").alias("step")).alias("row"), F.col(text_col).alias("text"))
    an = anchors.select(F.struct(F.lit(True).alias("anchor"), F.col(anchor_id).cast("long").alias("id"),
                                 F.col("effective_step").cast("long").alias("step")).alias("row"), F.col(text_col).alias("text"))
    rows = ex.repartition(spread).unionByName(an) if spread else ex.unionByName(an)
    phi = encode_position_pool(tokenize_whitespace(rows, "text", "row"), eps=eps, id_col="row")
    # an anchor goes to every shard, an example to one
    to = F.when(F.col("row.anchor"), F.sequence(F.lit(0), F.lit(shards - 1))).otherwise(
        F.array(F.pmod(F.xxhash64("row.id"), F.lit(shards)).cast("int")))
    dealt = phi.select(F.explode(to).alias("shard"), "row.anchor", "row.id", "row.step", "vec")

    def weigh(key, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        sums = AnchorSums(interval, state.get if state.exists else None)
        waiting = []
        for pdf in parts:
            for step, vec in zip(pdf["step"][pdf["anchor"]], pdf["vec"][pdf["anchor"]]):
                sums.add(int(step), np.asarray(vec))
            waiting.append(pdf[~pdf["anchor"]])
        last = None
        for pdf in waiting:
            score = np.full(len(pdf), np.nan)
            version = pdf["step"].map(sums.version).to_numpy(dtype=np.int64)
            for v in np.unique(version):
                c = sums.centroid(int(v))
                if c is not None:
                    own = version == v
                    score[own] = np.vstack(pdf["vec"][own].to_numpy()) @ c
                last = int(v) if last is None else max(last, int(v))
            if len(pdf):
                yield pd.DataFrame({"step": pdf["step"].to_numpy(), id_col: pdf["id"].to_numpy(), "score": score})
        if last is not None:
            sums.settle(last)
        state.update(sums.saved())
    scored = dealt.groupBy("shard").applyInPandasWithState(
        weigh, f"step long, {id_col} long, score double", "versions array<long>, counts array<long>, sums array<double>",
        "append", GroupStateTimeout.NoTimeout)
    out = scored.withColumn("weight", F.when(F.col("score").isNotNull(), gate_expr(F.col("score"), tau, eps, w_min, w_max)))
    return _started(out.writeStream.format("parquet").option("path", sink), checkpoint, available_now)


def stream_greats(stream: DataFrame, gval: DataFrame, sink: str, checkpoint: str, k: int = 4,
                  eta: float = 0.1, batch_size: int = 64, id_col: str = ID, order_col: str | None = None,
                  available_now: bool = True, shards: int = SHARDS, flush_seconds: int = 60) -> StreamingQuery:
    """GREATS per training batch; sink rows ``(batch_id, example_id, rank)``.

    ``stream`` rows carry ``(example_id, grad)`` and the arrival order (``order_col``, the id if
    not given).  They are dealt to shards by a hash of the id, as to parallel trainers; each
    shard cuts its rows, in arrival order, into batches of exactly ``batch_size``, whatever the
    micro-batches, and batch b of shard s has the id ``b * shards + s``.  A rest waits in the
    state for the next rows.  It becomes a smaller batch of its own when a row with a null
    gradient comes (an end marker, which goes to all shards) or, in a stream that goes on
    (``available_now=False``), when ``flush_seconds`` pass without rows.
    """
    order = F.col(order_col or id_col).cast("long")
    goal = np.asarray(gval.select(to_double("gval").alias("g")).first()["g"])
    to = F.when(F.col("grad").isNull(), F.sequence(F.lit(0), F.lit(shards - 1))).otherwise(
        F.array(F.pmod(F.xxhash64(id_col), F.lit(shards)).cast("int")))
    dealt = stream.select(F.explode(to).alias("shard"), F.col(id_col).cast("long").alias("id"), order.alias("at"),
                          to_double("grad").alias("grad"))

    def pick(key, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        number, ids, flat = state.get if state.exists else (0, [], [])
        ids, out = [int(x) for x in ids], []
        grads = list(np.asarray(flat, np.float64).reshape(len(ids), -1)) if ids else []
        ends = state.hasTimedOut
        if not ends:
            pdf = pd.concat(list(parts))
            ends = bool(pdf["grad"].isna().any())
            pdf = pdf[pdf["grad"].notna()].sort_values(["at", "id"])
            ids += [int(x) for x in pdf["id"]]
            grads += [np.asarray(g, np.float64) for g in pdf["grad"]]
        while len(ids) >= batch_size or (ends and ids):
            size = min(batch_size, len(ids))
            at = np.asarray(ids[:size])
            for rank, j in enumerate(greats_batch(at, np.vstack(grads[:size]), goal, k, eta), 1):
                out.append((number * shards + int(key[0]), int(at[j]), rank))
            ids, grads, number = ids[size:], grads[size:], number + 1
        state.update((number, ids, [float(x) for g in grads for x in g]))
        if ids and not available_now:
            state.setTimeoutDuration(flush_seconds * 1000)
        yield pd.DataFrame(out, columns=["batch_id", id_col, "rank"]).astype("int64")
    picked = dealt.groupBy("shard").applyInPandasWithState(
        pick, f"batch_id long, {id_col} long, rank long", "number long, ids array<long>, grads array<double>",
        "append", GroupStateTimeout.NoTimeout if available_now else GroupStateTimeout.ProcessingTimeTimeout)
    return _started(picked.writeStream.format("parquet").option("path", sink), checkpoint, available_now)
