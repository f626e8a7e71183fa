"""N-gram Jaccard join by vertical partitioning.

The n-grams have one global order, which is cut into fragments (ranges).  Every
document's set falls into one segment per fragment, the fragments count overlaps on
their own, and the partial counts are summed:

1. *Upper bounds per document.*  In hash order, the first half of a document's set
   (its prefix) goes to the fragments, packed per input batch.  A fragment counts how
   many of a document's n-grams occur in another set; the counts are summed per
   document.  A document linked to any other shares at least ``need(n)`` prefix
   n-grams, so all others are done.
2. *Candidates.*  The rest gets the order (frequency, hash).  Documents which share a
   rare prefix n-gram at positions that still allow the threshold are candidates:
   first each n-gram's members with one pivot (a star, so a group of n copies gives n
   pairs), later the pairs which lie in different components.
3. *Overlaps.*  Every fragment counts each candidate's overlap on its own; the sum per
   pair decides, exactly.

Equal sets count as one node, so exact copies never form pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winnow.llm.common import (ready, SPACES, WordHasher, cut, mix64, partitions, small, text_pieces,
                               with_text, word_spans)
from winnow.llm.components import components

# N-grams of the documents packed together (8 bytes each).
PACK_GRAMS = 1 << 20

_PACKED = "frag int, keys binary, counts binary, grams binary, keys2 binary, ids array<{id}>"


class Shingler:
    """Sets of distinct word n-grams as sorted 64-bit hashes, for Arrow text columns."""

    def __init__(self, n: int):
        self.n = n
        self.words = WordHasher()
        self.is_word = np.ones(256, bool)
        self.is_word[SPACES] = False
        # odd multipliers, one per place in the n-gram
        draws = np.random.default_rng(n).integers(0, 2**63, n, dtype=np.uint64)
        self.places = draws * np.uint64(2) + np.uint64(1)

    def sets(self, column) -> Iterator[tuple[int, list]]:
        """Yield ``(first_row, [sorted distinct hashes per row])``."""
        n = self.n
        for first, data, starts, _ in text_pieces(column):
            s, e, row = word_spans(data, starts, self.is_word)
            h = self.words.hashes(data, s, e)
            counts = np.bincount(row, minlength=len(starts))
            ends = np.cumsum(counts)
            if len(h) >= n:
                g = np.zeros(len(h) - n + 1, np.uint64)
                for k in range(n):
                    g += h[k:len(h) - n + 1 + k] * self.places[k]
                g = mix64(g)
            out = []
            for b, c in zip(ends.tolist(), counts.tolist()):
                if c >= n:
                    x = np.sort(g[b - c:b - n + 1])
                    if len(x) > 1:
                        keep = np.empty(len(x), bool)
                        keep[0] = True
                        np.not_equal(x[1:], x[:-1], out=keep[1:])
                        if not keep.all():
                            x = x[keep]
                elif c:
                    x = h[b - c:b] * self.places[:c]
                    x = mix64(np.array([x.sum(dtype=np.uint64) + np.uint64(c)], np.uint64))
                else:
                    x = h[:0]
                out.append(x)
            yield first, out


def _digest(x: np.ndarray) -> bytes:
    return hashlib.blake2b(x.tobytes(), digest_size=16).digest()


def least_overlap(n, pct: int):
    """Smallest overlap a set of ``n`` can have with a set it is linked to."""
    return -(-pct * n // 100)


def _prefix(n: int, pct: int) -> tuple[int, int]:
    """Length of the hash-order prefix, and how many n-grams of it a link must share."""
    k = max(1, (n - least_overlap(n, pct)))
    fewest = least_overlap(n, pct)          # the smallest partner
    need = max(1, fewest - least_overlap(fewest, pct))
    return min(n, n - least_overlap(n, pct) + k), min(k, need)


def _segments(ngram: int, pct: int, frags: int, schema_ids: pa.DataType):
    """mapInArrow: documents -> packed segments per fragment, and packed document keys.

    Copies within a pack go once.
    """
    names = pa.schema([("frag", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary()), ("grams", pa.binary()),
                       ("keys2", pa.binary()), ("ids", pa.list_(schema_ids))])

    def pack(ids, sets):
        rows = {n: [] for n in names.names}
        digests = [_digest(x) for x in sets]
        # the documents themselves stay spread: one row per pack
        rows["frag"].append(-1 - (int.from_bytes(digests[0][:4], "little") % frags))
        rows["keys"].append(b"".join(d[:8] for d in digests))
        rows["counts"].append(np.array([len(x) for x in sets], np.int64).tobytes())
        rows["grams"].append(b"")
        rows["keys2"].append(b"".join(d[8:] for d in digests))
        rows["ids"].append(ids)
        once = {d: k for k, (d, x) in enumerate(zip(digests, sets)) if len(x)}     # copies go once
        if once:
            owners = np.array(list(once.values()))
            parts = [sets[k][:_prefix(len(sets[k]), pct)[0]] for k in owners]
            keys = np.frombuffer(rows["keys"][0], np.uint64)
            grams = np.concatenate(parts)
            own = np.repeat(owners, [len(p) for p in parts])
            frag = (((grams >> np.uint64(32)) * np.uint64(frags)) >> np.uint64(32)).astype(np.int32)
            order = np.argsort(frag, kind="stable")
            grams, own, frag = grams[order], own[order], frag[order]
            bounds = np.flatnonzero(np.diff(frag, prepend=-1, append=frags + 1))
            for a, b in zip(bounds[:-1], bounds[1:]):
                o = own[a:b]
                at = np.flatnonzero(np.diff(o, prepend=-1, append=-2))
                rows["frag"].append(int(frag[a]))
                rows["keys"].append(keys[o[at[:-1]]].tobytes())
                rows["counts"].append(np.diff(at).astype(np.int32).tobytes())
                rows["grams"].append(grams[a:b].tobytes())
                rows["keys2"].append(None)
                rows["ids"].append(None)
        return pa.RecordBatch.from_pydict(rows, names)

    def run(batches):
        sh = Shingler(ngram)
        for batch in batches:
            first, sets, held = 0, [], 0
            for _, more in sh.sets(batch.column(1)):
                sets += more
                held += sum(map(len, more))
                if held >= PACK_GRAMS:
                    yield pack(batch.column(0).slice(first, len(sets)).to_pylist(), sets)
                    first, sets, held = first + len(sets), [], 0
            if sets:
                yield pack(batch.column(0).slice(first, len(sets)).to_pylist(), sets)
    return run


def _shared(frags: int):
    """applyInArrow per fragment: how many of a document's n-grams another set also has."""
    def run(table: pa.Table) -> pa.Table:
        if table.column("frag")[0].as_py() < 0:
            return table
        keys = np.concatenate([np.frombuffer(b, np.uint64) for b in table.column("keys").to_pylist()])
        counts = np.concatenate([np.frombuffer(b, np.int32) for b in table.column("counts").to_pylist()])
        grams = np.concatenate([np.frombuffer(b, np.uint64) for b in table.column("grams").to_pylist()])
        uniq, first, ids = np.unique(keys, return_index=True, return_inverse=True)
        once = np.zeros(len(keys), bool)
        once[first] = True                              # equal sets count once
        keep = np.repeat(once, counts)
        own = np.repeat(ids, counts)[keep]
        grams = grams[keep]
        order = np.argsort(grams)
        g = grams[order]
        same = g[1:] == g[:-1]
        both = np.zeros(len(g), bool)
        both[1:] |= same
        both[:-1] |= same
        n = np.bincount(own[order[both]], minlength=len(uniq))
        hit = np.flatnonzero(n)
        uniq, n = uniq[hit], n[hit].astype(np.int32)
        bucket = (uniq % np.uint64(frags)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        uniq, n, bucket = uniq[order], n[order], bucket[order]
        at = np.flatnonzero(np.diff(bucket, prepend=-1, append=frags + 1))
        k = len(at) - 1
        return pa.table({
            "frag": pa.array([int(bucket[a]) for a in at[:-1]], pa.int32()),
            "keys": pa.array([uniq[a:b].tobytes() for a, b in zip(at[:-1], at[1:])], pa.binary()),
            "counts": pa.array([n[a:b].tobytes() for a, b in zip(at[:-1], at[1:])], pa.binary()),
            "grams": pa.array([b""] * k, pa.binary()), "keys2": pa.nulls(k, pa.binary()),
            "ids": pa.nulls(k, table.schema.field("ids").type)})
    return run


def _sum_counts(table: pa.Table) -> pa.Table:
    """applyInArrow per key bucket: sum the fragments' counts of each document."""
    keys = np.concatenate([np.frombuffer(b, np.int64) for b in table.column("keys").to_pylist()])
    counts = np.concatenate([np.frombuffer(b, np.int32) for b in table.column("counts").to_pylist()])
    uniq, ids = np.unique(keys, return_inverse=True)
    return pa.table({"key": uniq, "shared": np.bincount(ids, counts, len(uniq)).astype(np.int64)})


def _unpack(id_type: pa.DataType):
    """mapInArrow: packed document rows -> (id, key, key2, n)."""
    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                ids = b.column(3)[i].values
                yield pa.RecordBatch.from_arrays(
                    [ids.cast(id_type),
                     pa.array(np.frombuffer(b.column(0)[i].as_py(), np.int64)),
                     pa.array(np.frombuffer(b.column(2)[i].as_py(), np.int64)),
                     pa.array(np.frombuffer(b.column(1)[i].as_py(), np.int64))],
                    ["id", "key", "key2", "n"])
    return run


def _full_sets(ngram: int):
    """mapInArrow: documents -> (key, key2, n, grams)."""
    def run(batches):
        sh = Shingler(ngram)
        for batch in batches:
            for _, sets in sh.sets(batch.column(1)):
                d = [_digest(x) for x in sets]
                off = np.concatenate(([0], np.cumsum([len(x) for x in sets]))).astype(np.int32)
                grams = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.frombuffer(b"".join(x[:8] for x in d), np.int64)),
                     pa.array(np.frombuffer(b"".join(x[8:] for x in d), np.int64)),
                     pa.array(np.diff(off).astype(np.int64)),
                     pa.ListArray.from_arrays(pa.array(off), pa.array(grams))],
                    ["key", "key2", "n", "grams"])
    return run


def _alpha(x: str, y: str, pct: int):
    """Smallest overlap of a linked pair of set sizes x, y: o >= pct/100 * (x + y - o)."""
    return F.expr(f"({pct} * ({x} + {y}) + {99 + pct}) div {100 + pct}")


def _fits(pct: int):
    """Sizes and positions of a shared n-gram still allow the threshold."""
    a = _alpha("n", "pn", pct)
    return ((100 * F.least("n", "pn") >= pct * F.greatest("n", "pn"))
            & (F.col("n") - F.col("i") >= a) & (F.col("pn") - F.col("pi") >= a))


def _verified(pairs: DataFrame, segs: DataFrame, pct: int) -> DataFrame:
    """Pairs (a, b, na, nb) whose fragment overlaps sum up to a link."""
    left = segs.select(F.col("key").alias("a"), "frag", F.col("grams").alias("ga"))
    right = segs.select(F.col("key").alias("b"), "frag", F.col("grams").alias("gb"))
    part = (pairs.join(left, "a").join(right, ["b", "frag"])
            .select("a", "b", "na", "nb", F.size(F.array_intersect("ga", "gb")).cast("long").alias("part")))
    return (part.groupBy("a", "b", "na", "nb").agg(F.sum("part").alias("o"))
            .where(F.col("o") >= _alpha("na", "nb", pct)).select("a", "b", "o"))


def _pairs(joined: DataFrame) -> DataFrame:
    """Distinct (a < b) pairs of the (key, n) x (pk, pn) rows."""
    lo = F.col("key") < F.col("pk")
    return joined.select(F.least("key", "pk").alias("a"), F.greatest("key", "pk").alias("b"),
                         F.when(lo, F.col("n")).otherwise(F.col("pn")).alias("na"),
                         F.when(lo, F.col("pn")).otherwise(F.col("n")).alias("nb")).distinct()


def _labels(links: DataFrame, sets: DataFrame) -> DataFrame:
    """``(node, comp, least)`` of linked sets: a component's label, and its smallest id.

    Nodes are ordered by their smallest id (null last), so the component's smallest node
    tells its smallest id, and no component is gathered for it.
    """
    name = F.struct(F.col("rep").isNull().alias("anon"), "rep", "key")
    who = sets.select(F.col("key").alias("k"), name.alias("name"))
    edges = (links.join(who.select(F.col("k").alias("a"), F.col("name").alias("x")), "a")
             .join(who.select(F.col("k").alias("b"), F.col("name").alias("y")), "b")
             .select(F.col("x").alias("a"), F.col("y").alias("b")))
    c = components(edges)
    return cut(c.select(F.col("node.key").alias("node"), F.col("comp.key").alias("comp"),
                        F.col("comp.rep").alias("least")), "comp")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       ngram: int = 5, pct: int = 75) -> DataFrame:
    """Connected components of documents whose n-gram sets have Jaccard >= pct / 100.

    Returns one row per input row: ``id_col``, ``n_shingles`` (set size),
    ``component_id`` (smallest id reachable by links, the own included).

    Words are ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased.  A text of fewer
    than ``ngram`` words is one n-gram as a whole; a null or empty text has an empty set,
    is linked with nothing and keeps its own id.  Equal sets are linked.  Repeated rows
    are returned as often as they come; a null id gets the smallest non-null id of its
    component, or null.  An empty table gives an empty result.  Other columns are
    ignored, whatever their names.  N-grams are compared by 64-bit hashes.
    """
    m = _members(docs, id_col, text_col, ngram, pct)
    return m.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")


def _members(docs: DataFrame, id_col: str, text_col: str, ngram: int = 5, pct: int = 75) -> DataFrame:
    """Per input row (id, key, key2, n, comp, component_id): its set's digest and size, and its component.

    ``comp`` tells components apart, also those with one smallest id; it is null for an empty set.
    """
    if not 50 <= pct <= 100:
        raise ValueError("pct must be in 50..100")
    spark = docs.sparkSession
    ready(spark)
    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    id_type = d.schema["id"].dataType
    frags = 2 * partitions(spark)
    schema = _PACKED.format(id=id_type.simpleString())
    arrow_id = _arrow_type(id_type)

    packed = (d.mapInArrow(_segments(ngram, pct, frags, arrow_id), schema)
              .groupBy("frag").applyInArrow(_shared(frags), schema))
    packed = cut(packed, "overlap-bounds")
    info = (packed.where("ids is not null").select("keys", "counts", "keys2", "ids")
            .mapInArrow(_unpack(arrow_id), f"id {id_type.simpleString()}, key long, key2 long, n long"))
    shared = (packed.where("ids is null").select("frag", "keys", "counts")
              .groupBy("frag").applyInArrow(_sum_counts, "key long, shared long"))
    sets = cut(info.where("n > 0").groupBy("key", "key2", "n").agg(F.min("id").alias("rep")), "sets")

    low = F.expr(f"n - ({pct} * n + 99) div 100")
    fewest = f"(({pct} * n + 99) div 100)"
    need = F.greatest(F.lit(1).cast("long"), F.least(
        F.greatest(F.lit(1).cast("long"), low),
        F.expr(f"{fewest} - ({pct} * {fewest} + 99) div 100")))
    alive = cut(sets.join(shared, "key").where(F.col("shared") >= need), "alive")

    reps = alive.select(F.col("rep").alias("id")).where("id is not null").distinct()
    if alive.where("rep is null").limit(1).count():
        picked = d                                    # unidentified documents: hash all again
    else:
        picked = d.join(small(cut(reps, "reps")), "id", "left_semi")
    full = (picked.mapInArrow(_full_sets(ngram), "key long, key2 long, n long, grams array<long>")
            .join(alive.select("key", "key2"), ["key", "key2"], "left_semi").dropDuplicates(["key"]))
    full = cut(full.select("key", "n", "grams"), "grams")

    each = full.select("key", "n", F.explode("grams").alias("g"))
    freq = each.groupBy("g").agg(F.count(F.lit(1)).alias("df")).where("df >= 2")
    order = (each.join(freq, "g").groupBy("key", "n")
             .agg(F.sort_array(F.collect_list(F.struct("df", "g"))).alias("grams"))
             .where(f"size(grams) * 100 >= {pct} * n"))
    order = cut(order, "order")
    posts = (order.select("key", "n", F.posexplode("grams").alias("p", "x"),
                          (F.col("n") - F.size("grams")).alias("alone"))
             .select(F.col("x.g").alias("g"), "key", "n", (F.col("p") + F.col("alone")).alias("i"))
             .where(F.col("i") <= F.expr(f"n - ({pct} * n + 99) div 100")))
    posts = cut(posts, "postings")
    frag = F.shiftrightunsigned("x", 61).cast("int")
    segs = (order.select("key", F.explode(F.col("grams.g")).alias("x"))
            .groupBy("key", frag.alias("frag")).agg(F.collect_list("x").alias("grams")))
    segs = cut(segs, "segments")

    # members of an n-gram with its pivot, the member where it stands first
    pivot = (posts.groupBy("g").agg(F.min(F.struct("i", "key", "n")).alias("v"), F.count(F.lit(1)).alias("m"))
             .where("m > 1").select("g", F.col("v.key").alias("pk"), F.col("v.n").alias("pn"),
                                    F.col("v.i").alias("pi")))
    star = cut(_pairs(posts.join(pivot, "g").where((F.col("key") != F.col("pk")) & _fits(pct))), "star")
    links = cut(_verified(star, segs, pct), "links")
    comp = _labels(links, sets)

    # pairs in different components, and not yet compared
    p = posts.join(comp.select(F.col("node").alias("key"), "comp"), "key", "left")
    p = p.withColumn("comp", F.coalesce("comp", "key"))
    split = p.groupBy("g").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 < c1")
    p = cut(p.join(split.select("g"), "g", "left_semi"), "open")
    q = p.select("g", F.col("key").alias("pk"), F.col("n").alias("pn"), F.col("i").alias("pi"),
                 F.col("comp").alias("pc"))
    rest = (_pairs(p.join(q, "g").where((F.col("key") < F.col("pk")) & (F.col("comp") != F.col("pc")) & _fits(pct)))
            .join(star.select("a", "b"), ["a", "b"], "left_anti"))
    late = cut(_verified(rest, segs, pct), "late")
    if late.limit(1).count():
        comp = _labels(links.unionByName(late), sets)

    named = sets.join(comp.withColumnRenamed("node", "key"), "key", "left")
    least = F.when(F.col("comp").isNull(), F.col("rep")).otherwise(F.col("least"))
    named = named.select("key", "key2", "n", F.coalesce("comp", "key").alias("comp"), least.alias("component_id"))
    out = info.join(named, ["key", "key2", "n"], "left")
    return out.select("id", "key", "key2", "n", "comp", F.coalesce("component_id", "id").alias("component_id"))


def _arrow_type(t):
    from pyspark.sql.pandas.types import to_arrow_type
    return to_arrow_type(t)


def _keyed(ngram: int, text_at: int, names: list[str]):
    """mapInArrow: rows -> rows with key, key2 and n of their sets."""
    def run(batches):
        sh = Shingler(ngram)
        for b in batches:
            d, n = [], []
            for _, sets in sh.sets(b.column(text_at)):
                d += map(_digest, sets)
                n += map(len, sets)
            if d:
                yield pa.RecordBatch.from_arrays(
                    [*b.columns, pa.array(np.frombuffer(b"".join(x[:8] for x in d), np.int64)),
                     pa.array(np.frombuffer(b"".join(x[8:] for x in d), np.int64)), pa.array(n, pa.int64())],
                    names=names)
    return run


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ngram: int = 5,
             pct: int = 75) -> DataFrame:
    """Documents without those that another one of their component stands for.

    The row with the smallest id stays; of several rows of the component with that id the
    one with the smallest text digest stays.  Rows with a null id and rows without words
    stay.  Every row counts by its own text, also where rows share an id.
    """
    twice = docs.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_twice_id")).agg(F.count(F.lit(1)).alias("m"))
    twice = cut(twice.where("m > 1").select("_twice_id"), "twice")
    repeated = twice.limit(1).count() > 0
    comp = _members(docs, id_col, text_col, ngram, pct)
    if repeated:
        comp = cut(comp, "members")
    c = comp.where("n > 0 and id is not null and id <> component_id")
    drop = cut(c.select(F.col("id").alias("_drop_id")).distinct(), "drop")
    if not repeated:
        return docs.join(drop, docs[id_col] == drop["_drop_id"], "left_anti")
    once = docs.join(twice, docs[id_col] == twice["_twice_id"], "left_anti")
    once = once.join(drop, once[id_col] == drop["_drop_id"], "left_anti")
    # rows of an id that others have too are told apart by their sets
    many, text_at, added = with_text(docs.join(twice, docs[id_col] == twice["_twice_id"], "left_semi"), text_col)
    id_at = docs.columns.index(id_col)
    safe = [f"c{k}" for k in range(len(many.columns))]
    many = many.toDF(*safe)
    schema = ", ".join([f"{n} {f.dataType.simpleString()}" for n, f in zip(safe, many.schema)]
                       + ["key long", "key2 long", "n long"])
    many = many.mapInArrow(_keyed(ngram, text_at, [*safe, "key", "key2", "n"]), schema)
    stay = (comp.join(twice, comp["id"] == twice["_twice_id"], "left_semi").where("n > 0 and id = component_id")
            .select(F.col("id").alias(safe[id_at]), "key", "key2", "comp").distinct())
    row = F.struct(*safe)
    best = F.struct(F.sha2(F.col(safe[text_at]), 256), F.sha2(F.to_json(row), 256))
    one = (many.where("n > 0").join(small(cut(stay, "stay")), [safe[id_at], "key", "key2"])
           .groupBy(safe[id_at], "comp").agg(F.min_by(row, best).alias("row")).select("row.*"))
    more = one.unionByName(many.where("n = 0").select(*safe)).select(*safe[:len(safe) - added])
    return once.unionByName(more.toDF(*docs.columns))
