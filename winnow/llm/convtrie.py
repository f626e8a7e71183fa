"""Prefix trie of conversations by burst tries.

A node stands for one distinct sequence of first turns; conversations that start with it
are its members.  Turns are compared by 128-bit digests of role and text, so the texts
stay where they are after the first pass.

1. *Sequences.*  Equal conversations become one, with their number: an order-free
   combination of (place, turn) hashes names a sequence, so no conversation is gathered.
2. *Bursting.*  A container holds the suffixes below one trie head, at first all of them
   below the root.  While a container has more rows than the limit, its common turns
   become a chain of nodes at once (counts per container and place), and it bursts by the
   next turn's id into smaller ones.  One round treats all oversized containers.
3. *Sweep.*  The remaining containers are dealt to shards, sorted, and swept into nodes,
   one container at a time in memory.
4. *Sums.*  Heads get their leaves and savings from their containers, round by round
   upwards.

No step holds more than one container of bounded size or one row per conversation's share.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from winnow.llm.common import cut, ready, small
from winnow.operators.ranking import rank_rows

# Rows (turns below the head) of a container that one task sweeps.
CONTAINER_ROWS = 512
# Ids joined into one string before a digest streams over the strings.
ID_RANGE = 1024
# Places summed by one window; longer chains have their chunks' sums summed.
CHUNK = 4096
# Nodes in one Arrow batch.
BATCH_NODES = 8192

KEY = ["k1", "k2"]
NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "end"]


def _long(digest, at: int):
    return F.conv(F.substring(digest, at, 16), 16, -10).cast("long")


def turns(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
          text_col: str = "text") -> DataFrame:
    """``(conv, pos, t1, t2, bytes)``: every turn's place (from 1), digest and text size.

    A conversation's turns are ordered by their number, null first; equal numbers by role, the
    text's first 256 characters and its digest.  A null role or text is empty.  Rows without a
    conversation id belong to no conversation and are left out.  Ids must be integers.
    """
    ready(conversations.sparkSession)
    role = F.coalesce(F.col(role_col).cast("string"), F.lit(""))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    # the role's size tells role and text apart
    said = F.sha2(F.concat_ws(":", F.octet_length(role).cast("string"), F.concat(role, text)).cast("binary"), 256)
    rows = conversations.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"), role.alias("role"),
        F.substring(text, 1, 256).alias("head"), _long(said, 1).alias("t1"), _long(said, 17).alias("t2"),
        F.octet_length(text).cast("long").alias("bytes"))
    most = rows.groupBy("conv").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
    order = [F.asc_nulls_first("turn"), F.asc("role"), F.asc("head"), F.asc("t1"), F.asc("t2")]
    ranked = rank_rows(rows, order, ["conv"], name="pos", max_group=most or 0)
    return cut(ranked.select("conv", "pos", "t1", "t2", "bytes"), "turns")


def grafted(rows: DataFrame, family: int = 5, spread: int = 9) -> tuple[DataFrame, DataFrame]:
    """Conversations rebuilt on the first turns of their family's first one.

    Conversation c becomes the first h turns of c - c % family (all if it has fewer, none if
    there is none), then its own turns after its first h; h = crc32(decimal c) % spread.
    Returns the turns and all conversations ``(conv)``, also those left without a turn.
    """
    h = (F.crc32(F.col("conv").cast("string")) % spread).cast("long")
    convs = rows.groupBy("conv").agg(F.count(F.lit(1)).alias("own"))
    convs = cut(convs.select("conv", "own", h.alias("h"), (F.col("conv") - F.pmod("conv", F.lit(family))).alias("base")),
                "convs")
    sizes = convs.select(F.col("conv").alias("base"), F.col("own").alias("there"))
    convs = cut(convs.join(sizes, "base", "left").withColumn(
        "taken", F.least("h", F.coalesce("there", F.lit(0)))), "grafts")
    # at most family * spread rows of a conversation go elsewhere
    heads = rows.where(F.col("pos") <= spread).withColumnRenamed("conv", "base").join(
        convs.select("conv", "base", "taken"), "base").where("pos <= taken")
    own = rows.join(small(convs.select("conv", "h", "taken")), "conv").where("pos > h").withColumn(
        "pos", F.col("pos") - F.col("h") + F.col("taken"))
    names = ["conv", "pos", "t1", "t2", "bytes"]
    return cut(heads.select(*names).unionByName(own.select(*names)), "grafted"), convs.select("conv")


def _stream_digest(batches):
    """Rows (s1, s2, size, ids) sorted by sequence and id: SHA-256 of a sequence's ids, in constant memory."""
    now, state, out = None, None, []

    def batch(rows):
        cols = list(zip(*rows))
        return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string())],
                                          names=["s1", "s2", "size", "ends_sha256"])
    for b in batches:
        for *key, ids in zip(*(b.column(k).to_pylist() for k in range(4))):
            if key != now:
                if now is not None:
                    out.append((*now, state.hexdigest()))
                now, state = key, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        if len(out) >= BATCH_NODES:
            yield batch(out)
            out = []
    if now is not None:
        out.append((*now, state.hexdigest()))
    if out:
        yield batch(out)


def _ends(named: DataFrame) -> DataFrame:
    """``(s1, s2, size, ends_sha256)``: digest of the ids with each sequence, ascending."""
    seq = ["s1", "s2", "size"]
    part = named.groupBy(*seq, F.floor(F.col("conv") / ID_RANGE).alias("part")).agg(F.array_sort(F.collect_list("conv")).alias("ids"))
    part = part.select(*seq, "part", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))
    part = part.repartition(*seq).sortWithinPartitions(*seq, "part").select(*seq, "ids")
    return part.mapInArrow(_stream_digest, "s1 long, s2 long, size long, ends_sha256 string")


def sweep(depth: int, up, size: int, members: list) -> list[tuple]:
    """Nodes of one container: its head at ``depth`` (below ``up``, last text of ``size`` bytes) and all below.

    ``members``: ``(conv, count, [turn, ...], [bytes, ...])`` per distinct suffix.  Gives NODE rows, the head first.
    """
    members.sort(key=lambda x: x[2])
    # depth, parent, bytes, members, least, children, leaves, saved, end
    nodes = [[depth, -1, size, 0, None, 0, 0, 0, None]]
    path, last = [0], []
    for conv, count, ids, sizes in members:
        same = 0
        while same < min(len(last), len(ids)) and last[same] == ids[same]:
            same += 1
        del path[same + 1:]
        for j in range(same, len(ids)):
            nodes[path[-1]][5] += 1
            nodes.append([depth + j + 1, path[-1], sizes[j], 0, None, 0, 0, 0, None])
            path.append(len(nodes) - 1)
        end = nodes[path[-1]]
        end[3], end[4], end[8] = end[3] + count, conv, conv
        last = ids
    for node in reversed(nodes):                       # children stand behind their parents
        node[6] = node[6] or 1
        node[7] += (node[3] - 1) * node[2]
        if node[1] >= 0:
            p = nodes[node[1]]
            p[3] += node[3]
            p[4] = node[4] if p[4] is None else min(p[4], node[4])
            p[6] += node[6]
            p[7] += node[7]
    return [(n[4], n[0], nodes[n[1]][4] if n[1] >= 0 else up, *(n[k] for k in (3, 5, 6, 7, 8))) for n in nodes]


def _sweeper(batches):
    """Rows (k1, k2, d, up, b, conv, count, pos, t1, t2, bytes) sorted by container, conversation and place."""
    key, head, members, out = None, None, [], []

    def batch(rows):
        names = NODE + KEY + ["top"]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in list(zip(*rows))[:-1]]
                                          + [pa.array([r[-1] for r in rows], pa.bool_())], names=names)

    def swept():
        return [(*node, *key, k == 0) for k, node in enumerate(sweep(*head, members))]
    for b in batches:
        for k1, k2, d, up, size, conv, count, pos, t1, t2, n in zip(*(c.to_pylist() for c in b.columns)):
            if (k1, k2) != key:
                if key is not None:
                    out += swept()
                key, head, members = (k1, k2), (d, up, size), []
            if not members or members[-1][0] != conv:
                members.append((conv, count, [], []))
            if pos is not None:
                members[-1][2].append((t1, t2))
                members[-1][3].append(n)
            while len(out) >= BATCH_NODES:
                yield batch(out[:BATCH_NODES])
                out = out[BATCH_NODES:]
    if key is not None:
        out += swept()
    if out:
        yield batch(out)


def _suffix_sums(chain: DataFrame) -> DataFrame:
    """``saved``: per (k1, k2, depth) the sum of ``v`` at this and greater depths of the chain."""
    c = chain.withColumn("chunk", F.expr(f"depth div {CHUNK}"))
    later = Window.partitionBy(*KEY).orderBy(F.desc("chunk")).rowsBetween(Window.unboundedPreceding, -1)
    sums = c.groupBy(*KEY, "chunk").agg(F.sum("v").alias("s"))
    sums = sums.select(*KEY, "chunk", F.coalesce(F.sum("s").over(later), F.lit(0)).alias("later"))
    here = Window.partitionBy(*KEY, "chunk").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    return c.join(sums, [*KEY, "chunk"]).withColumn("saved", F.sum("v").over(here) + F.col("later")).drop("chunk", "later")


def trie(rows: DataFrame, convs: DataFrame | None = None, container_rows: int = CONTAINER_ROWS) -> DataFrame:
    """Nodes of the prefix trie of ``rows(conv, pos, t1, t2, bytes)``, see :func:`turns`.

    Per node: ``conv_id`` (smallest member), ``depth``, ``parent_conv_id`` (the parent's
    conv_id; null for the root), ``n_convs`` (members), ``n_children``, ``n_leaves`` (childless
    nodes in its subtree, the own included), ``saved_tokens`` (summed over its subtree: members
    less one, times the bytes of the node's last text) and ``ends_sha256`` (digest of the
    members that end here, ids ascending and joined by commas).

    ``convs(conv)`` names all conversations; those without a turn are members of the root.
    Without any conversation there is no node.
    """
    ready(rows.sparkSession)
    if convs is None:
        convs = rows.select("conv").distinct()
    hashes = rows.groupBy("conv").agg(
        *(F.bit_xor(F.xxhash64(F.lit(k), "pos", "t1", "t2")).alias(f"s{k}") for k in (1, 2)),
        F.count(F.lit(1)).alias("size"))
    named = convs.join(hashes, "conv", "left").fillna(0, ["s1", "s2", "size"])
    named = cut(named.select("conv", "s1", "s2", "size"), "sequences")
    seqs = cut(named.groupBy("s1", "s2", "size").agg(F.min("conv").alias("conv"), F.count(F.lit(1)).alias("count"))
               .join(_ends(named), ["s1", "s2", "size"]), "distinct")
    rows = cut(rows.join(small(seqs.select("conv")), "conv", "left_semi"), "suffixes")

    members = seqs.select(F.lit(0).cast("long").alias("k1"), F.lit(0).cast("long").alias("k2"),
                          F.lit(0).cast("long").alias("d"), F.lit(None).cast("long").alias("up"),
                          F.lit(0).cast("long").alias("b"), "conv", "count", "size")
    parts, bursts = [], []
    while True:
        over = members.groupBy(*KEY).agg(F.sum(F.col("size") - F.col("d")).alias("r")).where(F.col("r") > container_rows)
        over = cut(over.select(*KEY), "over")
        if not over.limit(1).count():
            parts.append(members)
            break
        parts.append(members.join(small(over), KEY, "left_anti"))
        members, burst = _burst(members.join(small(over), KEY, "left_semi"), rows)
        bursts.append(burst)

    swept = parts[0]
    for p in parts[1:]:
        swept = swept.unionByName(p)
    below = rows.select(F.col("conv").alias("c"), "pos", "t1", "t2", "bytes")
    swept = swept.join(below, (F.col("conv") == F.col("c")) & (F.col("pos") > F.col("d")), "left")
    swept = swept.select(*KEY, "d", "up", "b", "conv", "count", "pos", "t1", "t2", "bytes")
    swept = swept.repartition(*KEY).sortWithinPartitions(*KEY, "conv", "pos")
    nodes = cut(swept.mapInArrow(_sweeper, ", ".join(f"{c} long" for c in NODE + KEY) + ", top boolean"), "swept")

    done = [nodes.select(*NODE)]
    sums = nodes.where("top").select(*KEY, "n_leaves", "saved_tokens")
    for burst in reversed(bursts):
        chain = _head_nodes(burst, sums)
        done.append(chain.select(*NODE))
        sums = sums.unionByName(chain.where("depth = d").select(*KEY, "n_leaves", "saved_tokens"))
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    ends = seqs.select(F.col("conv").alias("end"), "ends_sha256")
    return out.join(ends, "end", "left").select(
        *NODE[:-1], F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))


def _burst(members: DataFrame, rows: DataFrame):
    """Burst containers: ``(members of the new ones, what the heads' nodes need)``."""
    members = cut(members, "oversized")
    narrow = small(members.select(*KEY, "d", F.col("conv").alias("c")), members.count())
    each = rows.join(narrow, F.col("conv") == F.col("c")).where("pos > d")
    # per container and place: all members have it, and with one turn?
    places = each.groupBy(*KEY, F.col("pos").alias("depth")).agg(
        F.count(F.lit(1)).alias("n"), F.min("bytes").alias("bytes"),
        ((F.min("t1") == F.max("t1")) & (F.min("t2") == F.max("t2"))).alias("one"))
    places = cut(places, "places")
    heads = members.groupBy(*KEY).agg(F.first("d").alias("d"), F.first("up").alias("up"), F.first("b").alias("b"),
                                      F.count(F.lit(1)).alias("n"), F.sum("count").alias("w"), F.min("conv").alias("low"))
    split = places.join(heads.select(*KEY, F.col("n").alias("all")), KEY).groupBy(*KEY).agg(
        F.min(F.when(~F.col("one") | (F.col("n") < F.col("all")), F.col("depth") - 1)).alias("split"),
        F.max("depth").alias("last"))
    heads = heads.join(split, KEY).withColumn("e", F.coalesce("split", "last")).drop("split", "last", "n")
    heads = cut(heads, "heads")
    chain = (heads.select(*KEY, F.col("d").alias("depth"), F.col("b").alias("bytes"))
             .unionByName(places.join(heads.select(*KEY, "e"), KEY).where("depth <= e").select(*KEY, "depth", "bytes")))
    at = members.select(*KEY, "conv", "count", "size").join(heads.select(*KEY, "e", "low"), KEY)
    at = cut(at, "split")
    ended = at.where("size = e").select(*KEY, F.col("conv").alias("end"))
    step = small(at.where("size > e").select(F.col("conv").alias("c"), *KEY, "count", "size", "e", "low"), members.count())
    new = rows.join(step, (F.col("conv") == F.col("c")) & (F.col("pos") == F.col("e") + 1))
    child = [F.xxhash64(F.lit(k), "k1", "k2", "t1", "t2").alias(f"k{k}") for k in (1, 2)]
    new = cut(new.select(*child, F.col("pos").alias("d"), F.col("low").alias("up"), F.col("bytes").alias("b"), "conv",
                         "count", "size", F.col("k1").alias("p1"), F.col("k2").alias("p2")), "containers")
    parents = new.select(*KEY, "p1", "p2").distinct()
    return new.drop("p1", "p2"), (heads, chain, ended, parents)


def _head_nodes(burst, sums: DataFrame) -> DataFrame:
    """Nodes of one round's heads, from the sums of the containers below them."""
    heads, chain, ended, parents = burst
    below = parents.join(sums, KEY).groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(
        F.count(F.lit(1)).alias("children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("below"))
    full = heads.join(below, KEY, "left").join(ended, KEY, "left")
    c = chain.join(full, KEY).withColumn("v", (F.col("w") - 1) * F.col("bytes"))
    c = _suffix_sums(c)
    last = F.col("depth") == F.col("e")
    return cut(c.select(
        F.col("low").alias("conv_id"), "depth", F.when(F.col("depth") == F.col("d"), F.col("up")).otherwise(F.col("low"))
        .alias("parent_conv_id"), F.col("w").alias("n_convs"),
        F.when(last, F.coalesce("children", F.lit(0))).otherwise(1).cast("long").alias("n_children"),
        F.coalesce("leaves", F.lit(1)).cast("long").alias("n_leaves"),
        (F.col("saved") + F.coalesce("below", F.lit(0))).alias("saved_tokens"),
        F.when(last, F.col("end")).alias("end"), *KEY, "d"), "head-nodes")


def prefix_trie(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                text_col: str = "text", container_rows: int = CONTAINER_ROWS) -> DataFrame:
    """:func:`trie` of the conversations as they are; edge cases as in :func:`turns`."""
    return trie(turns(conversations, conv_col, turn_col, role_col, text_col), container_rows=container_rows)
