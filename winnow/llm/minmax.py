"""Near-duplicate documents by min-max hashing.

Each permutation of the shingle hashes keeps its minimum and its maximum: both agree
between two sets with a chance of their Jaccard similarity, so p evaluations give 2 p
values, and since minimum and maximum rarely agree together by chance, their mean varies
less than that of 2 p minima.  The values are banded:

1. *Signatures.*  One ``mapInArrow`` pass gives each document its set's digest, its size
   and one key per band.  Equal sets become one node, so exact copies form no pairs.
2. *Star.*  In each bucket (one band key) the members are compared with one pivot only,
   on full sets; connected components of the links follow.
3. *Tiles.*  Buckets that still hold several components are finished exactly: members of
   the main component are dealt against all others in bounded blocks, one task a tile,
   and a tile gives a spanning forest of its links, never its pairs.

A pair misses every band with a chance of (1 - J**rows)**bands: 2e-8 at J = 0.85.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winnow.llm.common import cut, mix64, ready, small
from winnow.llm.components import components
from winnow.llm.ngramjoin import Shingler, _digest

# Hash evaluations per shingle; each gives two values.
PERMUTATIONS = 48
# Values in a band.
ROWS = 4
# Rows and shingles of a tile's side (or one larger set).
TILE_ROWS = 256
TILE_GRAMS = 1 << 20
# Columns of a tile's membership matrix held at once.
COLUMNS = 4096


class MinMaxHasher:
    """Minima and maxima of sets of 64-bit hashes under random permutations."""

    def __init__(self, permutations: int = PERMUTATIONS, rows: int = ROWS):
        if permutations % rows:
            raise ValueError("permutations must be a multiple of rows")
        self.permutations, self.rows = permutations, rows
        draw = np.random.default_rng(11)
        self.masks = draw.integers(0, 2**64, permutations, dtype=np.uint64)
        self.odd = draw.integers(0, 2**64, permutations, dtype=np.uint64) | np.uint64(1)
        self.bands = 2 * permutations // rows
        self.weights = draw.integers(0, 2**64, (self.bands, rows), dtype=np.uint64) | np.uint64(1)

    def signatures(self, sets: list[np.ndarray]) -> np.ndarray:
        """One row per non-empty set: the minima, then the maxima."""
        grams = np.concatenate(sets)
        first = np.cumsum([0] + [len(s) for s in sets[:-1]])
        out = np.empty((len(sets), 2 * self.permutations), np.uint64)
        for k in range(self.permutations):
            h = (grams ^ self.masks[k]) * self.odd[k]
            out[:, k] = np.minimum.reduceat(h, first)
            out[:, self.permutations + k] = np.maximum.reduceat(h, first)
        return out

    def keys(self, signatures: np.ndarray) -> np.ndarray:
        """One bucket key per set and band."""
        v = mix64(signatures.reshape(len(signatures), self.bands, self.rows))
        return mix64((v * self.weights).sum(axis=2, dtype=np.uint64))


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Unbiased estimate of the Jaccard similarity of two sets from their signatures."""
    return float((a == b).mean())


def _signer(ngram: int, permutations: int, rows: int):
    """mapInArrow: (id, text) -> (id, key, key2, n, bands)."""
    def run(batches):
        shingler, hasher = Shingler(ngram), MinMaxHasher(permutations, rows)
        for b in batches:
            for first, sets in shingler.sets(b.column(1)):
                digests = b"".join(map(_digest, sets))
                pair = np.frombuffer(digests, np.int64).reshape(-1, 2)
                size = np.array([len(x) for x in sets], np.int64)
                keys = np.zeros((len(sets), hasher.bands), np.uint64)
                filled = np.flatnonzero(size)
                if len(filled):
                    keys[filled] = hasher.keys(hasher.signatures([sets[k] for k in filled]))
                off = np.arange(0, (len(sets) + 1) * hasher.bands, hasher.bands, dtype=np.int32)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(first, len(sets)), pa.array(pair[:, 0]), pa.array(pair[:, 1]), pa.array(size),
                     pa.ListArray.from_arrays(pa.array(off), pa.array(keys.ravel().view(np.int64)))],
                    names=["id", "key", "key2", "n", "bands"])
    return run


def _sets(ngram: int):
    """mapInArrow: (text) -> (key, key2, grams)."""
    def run(batches):
        shingler = Shingler(ngram)
        for b in batches:
            for _, sets in shingler.sets(b.column(0)):
                pair = np.frombuffer(b"".join(map(_digest, sets)), np.int64).reshape(-1, 2)
                off = np.cumsum([0] + [len(x) for x in sets]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(pair[:, 0]), pa.array(pair[:, 1]),
                     pa.ListArray.from_arrays(pa.array(off), pa.array(np.concatenate(sets).view(np.int64)))],
                    names=["key", "key2", "grams"])
    return run


def _links(pairs: DataFrame, full: DataFrame, pct: int) -> DataFrame:
    """The pairs ``(a, b)`` whose full sets reach the similarity."""
    left = full.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("grams").alias("ga"))
    right = full.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("grams").alias("gb"))
    sized = pairs.join(left.drop("ga"), "a").join(right.drop("gb"), "b").where(
        100 * F.least("na", "nb") >= pct * F.greatest("na", "nb"))
    both = sized.join(left.drop("na"), "a").join(right.drop("nb"), "b")
    overlap = F.size(F.array_intersect("ga", "gb"))
    return both.where((100 + pct) * overlap >= pct * (F.col("na") + F.col("nb"))).select("a", "b")


def _overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many elements each left set shares with each right one."""
    out = np.zeros((len(left), len(right)), np.float32)
    lg, rg = np.concatenate(left), np.concatenate(right)
    lo, ro = np.repeat(np.arange(len(left)), [len(x) for x in left]), np.repeat(np.arange(len(right)), [len(x) for x in right])
    shared = np.intersect1d(lg, rg)
    for k in range(0, len(shared), COLUMNS):
        part = shared[k:k + COLUMNS]
        sides = []
        for grams, owner, many in ((lg, lo, len(left)), (rg, ro, len(right))):
            at = np.minimum(np.searchsorted(part, grams), len(part) - 1)
            hit = part[at] == grams
            m = np.zeros((many, len(part)), np.float32)
            m[owner[hit], at[hit]] = 1
            sides.append(m)
        out += sides[0] @ sides[1].T
    return out


def _tile(pct: int):
    """applyInArrow per tile: a spanning forest of the links between its two sides."""
    def run(table: pa.Table) -> pa.Table:
        side = np.array(table.column("right").to_pylist())
        node, comp, n = (table.column(c).to_numpy() for c in ("node", "comp", "n"))
        grams = [np.asarray(g.values) for g in table.column("grams")]
        l, r = np.flatnonzero(~side), np.flatnonzero(side)
        if not len(l) or not len(r):
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        o = _overlaps([grams[k] for k in l], [grams[k] for k in r])
        ok = (100 + pct) * o.astype(np.int64) >= pct * (n[l][:, None] + n[r][None, :])
        ok &= comp[l][:, None] != comp[r][None, :]
        parent: dict = {}

        def find(x):
            while parent.setdefault(x, x) != x:
                parent[x] = x = parent[parent[x]]
            return x
        out = []
        for i, j in zip(*np.nonzero(ok)):
            x, y = find(comp[l[i]]), find(comp[r[j]])
            if x != y:
                parent[x] = y
                out.append((node[l[i]], node[r[j]]))
        return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})
    return run


def _open_links(members: DataFrame, labels: DataFrame, full: DataFrame, pct: int) -> DataFrame:
    """Links between members of one bucket that lie in different components, by tiles."""
    m = members.select("g", "node", "n").join(labels.select("node", F.col("comp.node").alias("comp")), "node", "left")
    m = m.withColumn("comp", F.coalesce("comp", "node"))
    by = m.groupBy("g", "comp").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("s"))
    total = by.groupBy("g").agg(
        F.count(F.lit(1)).alias("comps"), F.sum("c").alias("c"), F.sum("s").alias("s"),
        F.max(F.struct("c", "s", "comp")).alias("top"))
    # two members are a pivot and its only partner: compared already
    total = cut(total.where("comps > 1 and c > 2").select(
        "g", F.col("top.comp").alias("main"),
        F.ceil(F.greatest(F.col("top.c") / TILE_ROWS, F.col("top.s") / TILE_GRAMS)).cast("int").alias("mb"),
        F.ceil(F.greatest((F.col("c") - F.col("top.c")) / TILE_ROWS, (F.col("s") - F.col("top.s")) / TILE_GRAMS))
        .cast("int").alias("ob")), "open-buckets")
    rows = m.join(small(total), "g")
    own = F.col("comp") == F.col("main")
    block = F.pmod(F.xxhash64("node"), F.when(own, F.col("mb")).otherwise(F.col("ob"))).cast("int")
    rows = cut(rows.select("g", "node", "n", "comp", own.alias("own"), "mb", "ob", block.alias("r")), "open")
    # left sides: blocks of the main component, then of the others; right sides: the others
    left = rows.select("g", "node", "n", "comp", F.lit(False).alias("right"),
                       F.when(F.col("own"), F.col("r")).otherwise(F.col("mb") + F.col("r")).alias("i"),
                       F.explode(F.sequence(F.when(F.col("own"), F.lit(0)).otherwise(F.col("r")), F.col("ob") - 1)).alias("j"))
    right = rows.where("not own").select(
        "g", "node", "n", "comp", F.lit(True).alias("right"),
        F.explode(F.sequence(F.lit(0), F.col("mb") + F.col("r"))).alias("i"), F.col("r").alias("j"))
    tiles = left.unionByName(right).join(full.select("node", "grams"), "node")
    return tiles.groupBy("g", "i", "j").applyInArrow(_tile(pct), "a long, b long")


def _graph(links: DataFrame, sets: DataFrame) -> DataFrame:
    """Links as edges of named nodes: ordered by smallest id, null ids last."""
    name = F.struct(F.col("rep").isNull().alias("anon"), "rep", "node")
    who = sets.select(F.col("node").alias("k"), name.alias("name"))
    a = links.join(who.select(F.col("k").alias("a"), F.col("name").alias("x")), "a")
    return a.join(who.select(F.col("k").alias("b"), F.col("name").alias("y")), "b").select(
        F.col("x").alias("a"), F.col("y").alias("b"))


def _labels(links: DataFrame, sets: DataFrame) -> DataFrame:
    c = components(_graph(links, sets))
    return cut(c.select(F.col("node.node").alias("node"), "comp"), "labels")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ngram: int = 5, pct: int = 85,
                    permutations: int = PERMUTATIONS, rows: int = ROWS) -> DataFrame:
    """One row per document: ``id_col, n_shingles, component_id, kept``.

    Documents are linked when their sets of distinct word n-grams have a Jaccard similarity of
    pct / 100 or more, confirmed on the full sets; ``component_id`` is the smallest id reachable
    by links, the own included, and ``kept`` marks that document.

    Words are ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased.  A text of fewer than
    ``ngram`` words is one n-gram as a whole; a null or empty text has an empty set, is linked
    with nothing and keeps its own id.  Equal sets are linked.  Repeated rows are returned as
    often as they come, all with one mark.  A null id gets the smallest non-null id of its
    component, or null, and is kept only then.  An empty table gives an empty result.  Other
    columns are ignored, whatever their names.  N-grams are compared by 64-bit hashes, sets by
    128-bit digests.
    """
    if not 50 <= pct <= 100:
        raise ValueError("pct must be in 50..100")
    spark = docs.sparkSession
    ready(spark)
    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    bands = 2 * permutations // rows
    info = d.mapInArrow(_signer(ngram, permutations, rows),
                        f"id {d.schema['id'].dataType.simpleString()}, key long, key2 long, n long, bands array<long>")
    info = cut(info, "signatures")
    band = [F.col("bands")[k] for k in range(bands)]
    sets = (info.where("n > 0").groupBy("key", "key2")
            .agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"),
                 *(F.first(b).alias(f"b{k}") for k, b in enumerate(band)))
            .withColumn("node", F.monotonically_increasing_id()))
    sets = cut(sets, "sets")
    posts = sets.select("node", "n", F.explode(F.array(*(f"b{k}" for k in range(bands)))).alias("g"))
    buckets = posts.groupBy("g").agg(F.min("node").alias("pivot"), F.count(F.lit(1)).alias("m")).where("m > 1")
    members = cut(posts.join(small(cut(buckets.select("g", "pivot"), "buckets")), "g"), "members")

    alive = cut(members.select("node").distinct().join(sets.select("node", "key", "key2", "n", "rep"), "node"), "alive")
    reps = alive.select(F.col("rep").alias("id")).where("id is not null").distinct()
    # documents without an id are found by their sets alone
    picked = d if alive.where("rep is null").limit(1).count() else d.join(small(cut(reps, "reps")), "id", "left_semi")
    full = picked.select("text").mapInArrow(_sets(ngram), "key long, key2 long, grams array<long>")
    full = cut(full.join(alive.select("key", "key2", "node", "n"), ["key", "key2"])
               .dropDuplicates(["node"]).select("node", "n", "grams"), "full-sets")

    star = members.where("node <> pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct()
    links = cut(_links(star, full, pct), "links")
    labels = _labels(links, sets)
    late = cut(_open_links(members, labels, full, pct), "late-links")
    if late.limit(1).count():
        labels = _labels(links.unionByName(late), sets)

    told = sets.select("key", "key2", "node", "rep", "copies").join(labels, "node", "left")
    told = cut(told.where("copies > 1 or comp is not null").select(
        "key", "key2", F.when(F.col("comp").isNull(), F.col("rep")).otherwise(F.col("comp.rep")).alias("component_id"),
        F.lit(True).alias("told")), "told")
    out = info.select("id", "key", "key2", "n").join(small(told), ["key", "key2"], "left")
    comp = F.when(F.col("told"), F.col("component_id")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), comp.alias("component_id"),
                      F.col("id").eqNullSafe(comp).alias("kept"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without the rows that another one of their component stands for.

    Ids name documents: of rows that share an id all stay or all go.  Rows with a null id stay.
    """
    drop = near_duplicates(docs, id_col, text_col, **options).where(F.col(id_col).isNotNull() & ~F.col("kept"))
    drop = cut(drop.select(F.col(id_col).alias("_near_id")).distinct(), "near")
    return docs.join(drop, docs[id_col] == drop["_near_id"], "left_anti")
