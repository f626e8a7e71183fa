"""Vector scoring.

Vectors are ``ARRAY<DOUBLE>`` columns.  Token vectors for the built-in
encoder are hashed: token t gets the sign vector read from the bits of
md5(seed:tokvec:t) (bit 1 -> -1, bit 0 -> +1), i.e. a fixed random
projection of term counts, computed inside the row (no vocabulary join).

Nearest neighbours (F8) use a metric index: rows lie in cells around pivots, and the
triangle inequality of angles tells which blocks of rows can hold a better match than
the one a row has already; only those are compared, so the result is exact.

Max-similarity (F9) and the plain exact search run as tiled matrix
products: rows are hashed into blocks, each (row block, column block) tile
is one ``cogroup(...).applyInPandas`` task doing a numpy matmul, and only
each row's best match per tile leaves the task -- no pair rows are formed.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from winnow.functions.vector import dot, l2_normalize as l2_expr, to_double
from winnow.operators.budget import ID, score_direction, topk_by_score
from winnow.operators.token_vectors import pool_token_vectors
from winnow.session import materialize

DIM = 64
TOKVEC_SEED = 42


def _bits(token: Column, dim: int = DIM, seed: int = TOKVEC_SEED) -> Column:
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit("tokvec"), token))
    bits = F.lpad(F.conv(F.substring(h, 1, 16), 16, 2), 64, "0")
    if dim > 64:
        bits = F.concat(bits, F.lpad(F.conv(F.substring(h, 17, 16), 16, 2), 64, "0"))
    return bits


def _sign_vec(bits: Column, dim: int) -> Column:
    return F.transform(F.sequence(F.lit(1), F.lit(dim)),
                       lambda i: F.when(F.substring(bits, i, 1) == F.lit("1"), F.lit(-1.0))
                       .otherwise(F.lit(1.0)))


def token_vector(token: Column, dim: int = DIM, seed: int = TOKVEC_SEED) -> Column:
    """The hashed +-1 vector of one token."""
    return _sign_vec(_bits(token, dim, seed), dim)


def _zeros(dim: int) -> Column:
    return F.array_repeat(F.lit(0.0), dim)


def _token_bits(words: list, seed: int) -> np.ndarray:
    """First 64 bits of md5(seed:tokvec:word) per word, as uint64 (big-endian)."""
    out = np.empty(len(words), dtype=np.uint64)
    for i, w in enumerate(words):
        out[i] = int.from_bytes(hashlib.md5(f"{seed}:tokvec:{w}".encode("utf-8")).digest()[:8], "big")
    return out


def pool_record_batch(batch, id_col: str, dim: int, seed: int, positional: bool, eps: float):
    """One Arrow batch of ``(id, tokens)`` -> ``(id, vec)``.

    Tokens are dictionary-encoded, so each distinct token of the batch is
    hashed once; the per-row sums are one ``bincount`` per dimension.
    """
    import pyarrow as pa
    import pyarrow.compute as pc
    toks = batch.column("tokens")
    n_rows = batch.num_rows
    lengths = pc.fill_null(pc.list_value_length(toks), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = pc.list_flatten(toks)
    out = np.zeros((n_rows, dim), dtype=np.float64)
    if len(flat) > 0:
        enc = pc.dictionary_encode(flat).combine_chunks() if hasattr(flat, "combine_chunks") \
            else pc.dictionary_encode(flat)
        codes = enc.indices.to_numpy(zero_copy_only=False)
        bits = _token_bits(enc.dictionary.to_pylist(), seed)
        row = np.repeat(np.arange(n_rows), lengths)
        if positional:
            starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
            weight = (np.arange(len(codes)) - np.repeat(starts, lengths) + 1).astype(np.float64)
        else:
            weight = np.ones(len(codes))
        for d in range(dim):
            sign_u = 1.0 - 2.0 * ((bits >> np.uint64(63 - d)) & np.uint64(1)).astype(np.float64)
            out[:, d] = np.bincount(row, weights=weight * sign_u[codes], minlength=n_rows)
    n = lengths.astype(np.float64)
    if positional:
        out /= np.maximum(n * (n + 1) / 2.0, 1.0)[:, None]
        out /= np.maximum(np.sqrt((out * out).sum(axis=1)), eps)[:, None]
    else:
        out /= np.maximum(n, 1.0)[:, None]
    vec = pa.ListArray.from_arrays(pa.array(np.arange(0, (n_rows + 1) * dim, dim, dtype=np.int32)),
                                   pa.array(out.ravel()))
    return pa.RecordBatch.from_arrays([batch.column(id_col), vec], names=[id_col, "vec"])


def _pooled(tok: DataFrame, dim: int, seed: int, positional: bool, eps: float, id_col: str) -> DataFrame:
    if dim > 64:
        raise ValueError("the hashed encoder supports up to 64 dimensions")
    src = tok.select(id_col, "tokens")
    schema = src.schema[id_col].simpleString().replace(":", " ", 1) + ", vec array<double>"

    def run(batches):
        for b in batches:
            yield pool_record_batch(b, id_col, dim, seed, positional, eps)
    return src.mapInArrow(run, schema)


def encode_mean_pool(tok: DataFrame, dim: int = DIM, seed: int = TOKVEC_SEED,
                     id_col: str = ID, token_vecs: DataFrame | None = None) -> DataFrame:
    """mean of the token vectors (zero vector for no tokens).

    ``token_vecs`` (token, vec) gives the vectors, of any width; else they are hashed signs.

    Arrow batches (``mapInArrow``): tokens are dictionary-encoded so each
    distinct token of a batch is hashed once; sums are numpy ``bincount``s.
    (The same maths as higher-order functions over the token array, see
    :func:`token_vector`, is ~50x slower: lambdas are interpreted per token.)
    """
    if token_vecs is not None:
        return pool_token_vectors(tok, token_vecs, id_col=id_col)
    return _pooled(tok, dim, seed, False, 0.0, id_col)


def encode_position_pool(tok: DataFrame, dim: int = DIM, seed: int = TOKVEC_SEED,
                         eps: float = 1e-8, id_col: str = ID, token_vecs: DataFrame | None = None) -> DataFrame:
    """weight of the i-th token = i / sum(j), then L2-normalized (clamp eps); vectors as in F1."""
    if token_vecs is not None:
        return pool_token_vectors(tok, token_vecs, True, eps, id_col)
    return _pooled(tok, dim, seed, True, eps, id_col)


def l2_normalize(vecs: DataFrame, eps: float = 1e-12, mode: str = "clamp",
                 vec_col: str = "vec") -> DataFrame:
    """unit vectors; ``clamp`` divides by max(norm, eps), ``add`` by norm + eps."""
    return vecs.withColumn(vec_col, l2_expr(to_double(vec_col), eps, mode))


def centroid(vecs: DataFrame, vec_col: str = "vec") -> DataFrame:
    """one row ``(vec)``, the elementwise mean (partial aggregation per dimension)."""
    per_dim = (vecs.select(F.posexplode(to_double(vec_col)).alias("dim", "x"))
                   .groupBy("dim").agg(F.avg("x").alias("x")))
    return per_dim.agg(F.array_sort(F.collect_list(F.struct("dim", "x"))).alias("_s")) \
                  .select(F.transform("_s", lambda s: s["x"]).alias(vec_col))


def long_form(vecs: DataFrame, id_col: str = ID, vec_col: str = "vec") -> DataFrame:
    """``(id, dim, value)`` rows -- handy for checks and for joins per dimension."""
    return vecs.select(id_col, F.posexplode(vec_col).alias("dim", "value")) \
               .withColumn("dim", F.col("dim").cast("long"))


def cosine_to_centroid(vecs: DataFrame, ref_vecs: DataFrame | None = None,
                       id_col: str = ID, vec_col: str = "vec") -> DataFrame:
    """cos(vec, mean of the raw reference vectors); reference defaults to ``vecs``."""
    c = centroid(ref_vecs if ref_vecs is not None else vecs, vec_col).select(F.col(vec_col).alias("_c"))
    v = to_double(vec_col)
    num = dot(v, F.col("_c"))
    den = F.greatest(F.sqrt(dot(v, v)) * F.sqrt(dot(F.col("_c"), F.col("_c"))), F.lit(1e-8))
    return vecs.crossJoin(F.broadcast(c)).select(id_col, (num / den).alias("score"))


def select_embedding(vecs: DataFrame, val_vecs: DataFrame | None = None, budget: float = 0.05,
                     keep: str = "near", id_col: str = ID) -> DataFrame:
    """F5 against the validation centroid (else the train centroid), one tail."""
    if keep not in ("near", "far"):
        raise ValueError("keep must be 'near' or 'far'")
    scores = score_direction(cosine_to_centroid(vecs, val_vecs, id_col), keep)
    return topk_by_score(scores, budget)


def anchor_mean_cosine(vecs: DataFrame, anchors: DataFrame, id_col: str = ID,
                       vec_col: str = "vec") -> DataFrame:
    """phi(x) . mean(unit anchors): the mean cosine to the anchors (no renormalizing)."""
    c = centroid(anchors, vec_col).select(F.col(vec_col).alias("_c"))
    return vecs.crossJoin(F.broadcast(c)).select(id_col, dot(to_double(vec_col), F.col("_c")).alias("score"))


# --- tiled exact search -------------------------------------------------------

SIM_DIGITS = 9
# Numbers that a tile's side holds at most (the side given by the caller, if that is more), tiles that are enough to
# feed the cores, and similarities that a task holds at once.
TILE_ENTRIES = 1 << 21
TILES = 48
SIM_CELLS = 2_000_000


def _blocks(n: int, block: int) -> int:
    return max(1, int(math.ceil(n / float(block))))


def _tile_counts(n_left: int, n_right: int, dim: int, block: int) -> tuple[int, int]:
    """Blocks of the left and of the right rows.

    A row travels to every block of the other side, so sides are as long as memory allows, and the longer table is cut
    more often only to feed the cores; ``block`` is the least side.
    """
    most = max(block, TILE_ENTRIES // max(dim, 1))
    few, many = sorted((n_left, n_right))
    b_few = _blocks(few, most)
    b_many = max(_blocks(many, most), min(_blocks(many, block), _blocks(TILES, b_few)))
    return (b_few, b_many) if n_left <= n_right else (b_many, b_few)


def _tile_best(key, left: pd.DataFrame, right: pd.DataFrame, exclude_self: bool) -> pd.DataFrame:
    cols = ["example_id", "nn_id", "sim"]
    if left.empty or right.empty:
        return pd.DataFrame({c: pd.Series(dtype="int64" if c != "sim" else "float64") for c in cols})
    right = right.sort_values("rid")
    lv = np.vstack(left["v"].to_numpy())
    rv = np.vstack(right["rv"].to_numpy())
    lid = left["id"].to_numpy()
    rid = right["rid"].to_numpy()
    best, j = np.empty(len(lid)), np.empty(len(lid), np.int64)
    step = max(1, SIM_CELLS // len(rid))
    for lo in range(0, len(lid), step):
        part = slice(lo, lo + step)
        sims = np.round(lv[part] @ rv.T, SIM_DIGITS)
        if exclude_self:
            sims[lid[part, None] == rid[None, :]] = -np.inf
        j[part] = np.argmax(sims, axis=1)  # first maximum = lowest id among ties
        best[part] = sims[np.arange(len(sims)), j[part]]
    ok = np.isfinite(best)
    return pd.DataFrame({"example_id": lid[ok], "nn_id": rid[j][ok], "sim": best[ok]})


def _tiled(left: DataFrame, right: DataFrame, n_left: int, n_right: int, block: int,
           exclude_self: bool) -> DataFrame:
    """Best right row per left row by cosine (inputs already unit vectors ``(id, v)``)."""
    some = right.select(F.size("v").alias("d")).first()
    bl, br = _tile_counts(n_left, n_right, some["d"] if some else 1, block)
    lrep = left.select("id", "v", F.pmod(F.xxhash64("id"), F.lit(bl)).alias("rb"),
                       F.explode(F.sequence(F.lit(0), F.lit(br - 1)).cast("array<long>")).alias("cb"))
    # Distinct names on the right side: both sides may come from one plan.
    rrep = right.select(F.col("id").alias("rid"), F.col("v").alias("rv"),
                        F.explode(F.sequence(F.lit(0), F.lit(bl - 1)).cast("array<long>")).alias("rb"),
                        F.pmod(F.xxhash64("id"), F.lit(br)).alias("cb"))

    def tile(key, l_pdf, r_pdf):
        return _tile_best(key, l_pdf, r_pdf, exclude_self)

    per_tile = (lrep.groupBy("rb", "cb").cogroup(rrep.groupBy("rb", "cb"))
                    .applyInPandas(tile, "example_id long, nn_id long, sim double"))
    best = per_tile.groupBy("example_id").agg(
        F.max(F.struct(F.col("sim"), (-F.col("nn_id")).alias("neg_id"))).alias("_b"))
    return best.select("example_id", (-F.col("_b.neg_id")).alias("nn_id"), F.col("_b.sim").alias("sim"))


def _unit(vecs: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    return vecs.select(F.col(id_col).alias("id"), l2_expr(to_double(vec_col), 1e-12, "clamp").alias("v"))


def _tiled_grouped(rows: DataFrame, block: int) -> DataFrame:
    """Best other row per row within each group ``g`` (rows ``(g, id, v)``), tiled.

    Each group is cut into hash blocks of about ``block`` rows; every (row
    block, column block) pair of a group is one cogroup task, so a large group
    costs its quadratic work spread over many tasks and emits one best match
    per row per tile -- never the pairs themselves.
    """
    sizes = rows.groupBy("g").agg(F.count(F.lit(1)).alias("_n"))
    sizes = sizes.select("g", F.greatest(F.ceil(F.col("_n") / F.lit(float(block))), F.lit(1))
                         .cast("long").alias("_nb"))
    r = rows.join(sizes, "g")
    lrep = r.select("g", "id", "v", F.pmod(F.xxhash64("id"), F.col("_nb")).alias("rb"),
                    F.explode(F.sequence(F.lit(0).cast("long"), F.col("_nb") - 1)).alias("cb"))
    rrep = r.select(F.col("g").alias("rg"), F.col("id").alias("rid"), F.col("v").alias("rv"),
                    F.explode(F.sequence(F.lit(0).cast("long"), F.col("_nb") - 1)).alias("rb"),
                    F.pmod(F.xxhash64("id"), F.col("_nb")).alias("cb"))

    def tile(key, l_pdf, r_pdf):
        return _tile_best(key, l_pdf, r_pdf, True)

    per_tile = (lrep.groupBy("g", "rb", "cb").cogroup(rrep.groupBy("rg", "rb", "cb"))
                    .applyInPandas(tile, "example_id long, nn_id long, sim double"))
    best = per_tile.groupBy("example_id").agg(
        F.max(F.struct(F.col("sim"), (-F.col("nn_id")).alias("neg_id"))).alias("_b"))
    return best.select("example_id", (-F.col("_b.neg_id")).alias("nn_id"), F.col("_b.sim").alias("sim"))


def _hyperplane_buckets(unit: DataFrame, dim: int, tables: int, bits: int, seed: int) -> DataFrame:
    """``(g, id, v)``: one row per (row, hash table); g = table * 2^bits + sign pattern."""
    rng = np.random.default_rng(seed)
    planes = rng.standard_normal((tables * bits, dim)).tolist()
    spark = unit.sparkSession
    pl = spark.createDataFrame([(planes,)], "planes array<array<double>>")
    withp = unit.crossJoin(F.broadcast(pl))
    signs = F.transform("planes", lambda p: F.when(dot(F.col("v"), p) > 0, F.lit(1)).otherwise(F.lit(0)))
    keys = F.array(*[
        F.lit(t << bits) + F.aggregate(F.slice(signs, t * bits + 1, bits), F.lit(0),
                                       lambda acc, b: acc * 2 + b)
        for t in range(tables)]) if bits > 0 else F.array(*[F.lit(t) for t in range(tables)])
    return withp.select(F.explode(keys.cast("array<long>")).alias("g"), "id", "v")


# --- metric index ----------------------------------------------------------------

# Rows of a block, the most cells and blocks (their bounds are broadcast), and the
# visiting rows that one task compares with a group of blocks.  Tables are cut into about GROUPS groups (and
# as many parts of visiting rows) until a side has TILE_ENTRIES numbers.
INDEX_BLOCK = 1024
MAX_CELLS = 4096
MAX_BLOCKS = 200_000
VISIT_ROWS = 8192
GROUPS = 16
# Rings of a large cell, by the angle to its centre.
RINGS = 64
# Float error allowed for angles (arccos near 1) and rounded similarities.
ANGLE_SLACK, SIM_SLACK = 1e-7, 2e-9


class MetricIndex:
    """Cells around pivots, cut into blocks of bounded size: bounds per block, on the driver.

    ``rows`` are ``(id, v)`` distinct unit vectors (a zero vector counts as orthogonal to
    all, which keeps the triangle inequality).  At most MAX_CELLS centres and MAX_BLOCKS
    bounds are held; blocks grow with the table beyond that, and oversized rings are split
    by a hash of the id, so a dense cell is never one task's work.  Cells are numbered so that near ones
    follow each other; blocks in a row form a group, and a row travels once to each group that it visits.
    """

    def __init__(self, rows: DataFrame, n: int, block: int = INDEX_BLOCK, cells: int | None = None, seed: int = 42):
        self.n, self.block = n, max(block, -(-2 * n // MAX_BLOCKS))
        k = cells or min(MAX_CELLS, max(1, math.isqrt(n)))
        centers = lloyd_centers(rows, k, seed, 2, "id")
        centers = centers[_near_order(centers)]
        self.centers = centers / np.maximum(np.linalg.norm(centers, axis=1, keepdims=True), 1e-12)
        self.side = min(TILE_ENTRIES // max(centers.shape[1], 1), -(-n // GROUPS))
        bc = rows.sparkSession.sparkContext.broadcast(self.centers)

        def nearest(batches):
            for pdf in batches:
                for lo in range(0, len(pdf), 4096):
                    part = pdf.iloc[lo:lo + 4096]
                    angle = _angles(np.vstack(part["v"].to_numpy()), bc.value)
                    cell = np.argmin(angle, axis=1)
                    yield part[["id", "v"]].assign(cell=cell, angle=angle[np.arange(len(part)), cell])
        self.rows = materialize(rows.mapInPandas(nearest, "id long, v array<double>, cell long, angle double"))
        cuts = [(r + 1) / RINGS for r in range(RINGS - 1)]
        stats = self.rows.groupBy("cell").agg(
            F.count(F.lit(1)).alias("n"), F.min("angle").alias("lo"), F.max("angle").alias("hi"),
            F.percentile_approx("angle", cuts, 1000).alias("q")).orderBy("cell").collect()
        self.least = np.full(len(self.centers), np.inf)         # angle of each cell's innermost row
        self.first, self.rings, cell, lo, hi, base, held = {}, {}, [], [], [], 0, []
        for r in stats:
            self.least[r["cell"]] = r["lo"]
            rings = min(RINGS, -(-r["n"] // self.block))
            edges = np.unique([r["q"][j * RINGS // rings - 1] for j in range(1, rings)])
            parts = -(-r["n"] // (self.block * (len(edges) + 1)))
            self.first[r["cell"]], self.rings[r["cell"]] = base, (edges, parts)
            for a, b in zip([r["lo"], *edges], [*edges, r["hi"]]):
                cell += [r["cell"]] * parts
                lo += [a] * parts
                hi += [b] * parts
                held += [r["n"] / (len(edges) + 1) / parts] * parts
                base += parts
        self.cell, self.lo, self.hi = np.array(cell), np.array(lo), np.array(hi)
        self.group = ((np.cumsum(held) - held) // max(self.block, self.side)).astype(np.int32)

    def blocked(self) -> DataFrame:
        """``(id, v, blk)``: the rows with the number of their block."""
        bc = self.rows.sparkSession.sparkContext.broadcast((self.first, self.rings))

        def place(batches):
            first, rings = bc.value
            for pdf in batches:
                at = np.empty(len(pdf), np.int64)
                cells, angle, hashed = (pdf[c].to_numpy() for c in ("cell", "angle", "h"))
                for c in np.unique(cells):
                    own = cells == c
                    edges, parts = rings[int(c)]
                    at[own] = first[int(c)] + np.searchsorted(edges, angle[own]) * parts + hashed[own] % parts
                yield pdf[["id", "v"]].assign(blk=at)
        rows = self.rows.withColumn("h", F.pmod(F.xxhash64("id"), F.lit(1 << 30)))
        return rows.mapInPandas(place, "id long, v array<double>, blk long")

    def visits(self) -> DataFrame:
        """``(id, v, nn_id, sim, blocks, groups, starts)``: the best match in the own block, the other
        blocks that may hold a better one by the bounds, their groups and where those start in ``blocks``."""
        bc = self.rows.sparkSession.sparkContext.broadcast(
            (self.centers, self.cell, self.lo, self.hi, self.least, self.group))

        def own(key, pdf: pd.DataFrame) -> pd.DataFrame:
            centers, cell, lo, hi, least, group = bc.value
            pdf = pdf.sort_values("id")
            v, ids, blk = np.vstack(pdf["v"].to_numpy()), pdf["id"].to_numpy(), int(key[0])
            best, who, blocks = np.full(len(ids), -np.inf), np.full(len(ids), -1), []
            step = max(1, 4_000_000 // max(len(cell), len(ids)))
            for a in range(0, len(ids), step):
                part = slice(a, min(a + step, len(ids)))
                sims = np.round(v[part] @ v.T, SIM_DIGITS)
                sims[np.arange(sims.shape[0]), np.arange(a, part.stop)] = -np.inf
                j = np.argmax(sims, axis=1)                      # first maximum: lowest id
                best[part], who[part] = sims[np.arange(len(j)), j], ids[j]
                angle = _angles(v[part], centers)
                # some row lies at most so far away: the innermost one of any other cell
                far = angle + least
                far[:, cell[blk]] = np.inf
                sure = np.maximum(best[part], np.cos(np.minimum(far.min(axis=1) + ANGLE_SLACK, np.pi)))
                to = angle[:, cell]
                gap = np.maximum(np.maximum(to - hi, lo - to) - ANGLE_SLACK, 0)
                may = np.cos(gap) >= (sure - SIM_SLACK)[:, None]
                may[:, blk] = False
                blocks += [np.flatnonzero(m).astype(np.int32) for m in may]
            found = np.isfinite(best)
            starts = [np.flatnonzero(np.diff(group[b], prepend=-1)).astype(np.int32) for b in blocks]
            return pd.DataFrame({"id": ids, "v": list(v), "nn_id": np.where(found, who, -1),
                                 "sim": np.where(found, best, -2.0), "blocks": blocks,
                                 "groups": [group[b[at]] for b, at in zip(blocks, starts)], "starts": starts})
        return self.blocked().groupBy("blk").applyInPandas(
            own, "id long, v array<double>, nn_id long, sim double, blocks array<int>, groups array<int>, starts array<int>")

    def search(self) -> DataFrame:
        """``(id, nn_id, sim)`` of every row that has another one."""
        seen = materialize(self.visits())
        end = F.coalesce(F.get("starts", F.col("k") + 1), F.size("blocks"))
        ask = seen.select("id", "v", "blocks", "starts", F.posexplode("groups").alias("k", "grp")).select(
            "id", "v", "grp", F.slice("blocks", F.get("starts", "k") + 1, end - F.get("starts", "k")).alias("blocks"))
        rows = max(VISIT_ROWS, self.side)
        parts = seen.select(F.explode("groups").alias("grp")).groupBy("grp").agg(
            F.ceil(F.count(F.lit(1)) / rows).cast("long").alias("parts"))
        parts = materialize(parts)                               # one row per group
        ask = ask.join(F.broadcast(parts), "grp").withColumn("part", F.pmod(F.xxhash64("id", "grp"), F.col("parts")))
        group = self.rows.sparkSession.createDataFrame(
            [(k, int(g)) for k, g in enumerate(self.group)], "blk long, grp int")
        held = self.blocked().join(F.broadcast(group.join(F.broadcast(parts), "grp")), "blk").select(
            F.col("id").alias("rid"), F.col("v").alias("rv"), "blk", "grp",
            F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
        more = ask.groupBy("grp", "part").cogroup(held.groupBy("grp", "part")).applyInPandas(
            _visit_best, "id long, nn_id long, sim double")
        best = seen.where("sim > -2").select("id", "nn_id", "sim").unionByName(more).groupBy("id").agg(
            F.max(F.struct(F.col("sim"), (-F.col("nn_id")).alias("neg"))).alias("b"))
        return best.select("id", (-F.col("b.neg")).alias("nn_id"), F.col("b.sim").alias("sim"))


def _near_order(centers: np.ndarray) -> np.ndarray:
    """Numbers of the centres, near ones close to each other: halves along the axis of the greatest spread."""
    out, todo = [], [np.arange(len(centers))]
    while todo:
        some = todo.pop()
        if len(some) <= 2:
            out += some.tolist()
            continue
        axis = np.argmax(centers[some].var(axis=0))
        some = some[np.argsort(centers[some, axis], kind="stable")]
        todo += [some[len(some) // 2:], some[:len(some) // 2]]
    return np.array(out, np.int64)


def _visit_best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """Best row of ``right`` for each row of ``left``, among the blocks that it visits."""
    if not len(left) or not len(right):
        return pd.DataFrame({"id": [], "nn_id": [], "sim": []})
    right = right.sort_values(["blk", "rid"])
    lv, rv = np.vstack(left["v"].to_numpy()), np.vstack(right["rv"].to_numpy())
    ids, rid = left["id"].to_numpy(), right["rid"].to_numpy()
    visited = np.concatenate(left["blocks"].to_numpy())
    row = np.repeat(np.arange(len(left)), left["blocks"].map(len))
    order = np.argsort(visited, kind="stable")
    visited, row = visited[order], row[order]
    best, who = np.full(len(left), -np.inf), np.full(len(left), -1)
    blk, first = np.unique(right["blk"].to_numpy(), return_index=True)
    for b, lo, hi in zip(blk, first, [*first[1:], len(right)]):
        mine = row[np.searchsorted(visited, b):np.searchsorted(visited, b, "right")]
        step = max(1, SIM_CELLS // (hi - lo))
        for k in range(0, len(mine), step):
            at = mine[k:k + step]
            sims = np.round(lv[at] @ rv[lo:hi].T, SIM_DIGITS)
            j = np.argmax(sims, axis=1)                          # first maximum: lowest id
            sim, nn = sims[np.arange(len(at)), j], rid[lo + j]
            better = (sim > best[at]) | (sim == best[at]) & (nn < who[at])
            best[at[better]], who[at[better]] = sim[better], nn[better]
    ok = np.isfinite(best)
    return pd.DataFrame({"id": ids[ok], "nn_id": who[ok], "sim": best[ok]})


def _angles(v: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(v @ centers.T, -1.0, 1.0))


def _index_search(unit: DataFrame, block: int) -> DataFrame:
    """:class:`MetricIndex` over the distinct vectors; equal vectors answer each other."""
    unit = materialize(unit.select("id", "v", F.xxhash64(F.lit(1), "v").alias("h1"), F.xxhash64(F.lit(2), "v").alias("h2")))
    same = unit.groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("m")).where("m > 1")
    copies = materialize(unit.join(same, ["h1", "h2"]).where("id <> rep").select("id", "rep"))
    n = unit.count()
    none = unit.select("id", F.col("id").alias("nn_id"), F.lit(0.0).alias("sim")).limit(0)
    if n < 2:
        return none
    if not copies.limit(1).count():
        return MetricIndex(unit.select("id", "v"), n, block).search()
    once = materialize(unit.join(copies.select("id"), "id", "left_anti").select("id", "v"))
    n = once.count()
    found = materialize(MetricIndex(once, n, block).search()) if n > 1 else none
    # the least other id with the same vector, and what the vector's first row found
    second = copies.groupBy(F.col("rep").alias("id")).agg(F.min("id").alias("twin"))
    own = once.join(second, "id").select("id", F.col("id").alias("rep"), "twin").unionByName(
        copies.select("id", "rep", F.col("rep").alias("twin")))
    own = own.join(once.select(F.col("id").alias("rep"), F.round(dot("v", "v"), SIM_DIGITS).alias("self")), "rep")
    theirs = own.join(found.withColumnRenamed("id", "rep"), "rep", "left")
    pick = F.greatest(F.struct(F.col("self").alias("sim"), (-F.col("twin")).alias("neg")),
                      F.when(F.col("nn_id").isNotNull(), F.struct(F.col("sim"), (-F.col("nn_id")).alias("neg"))))
    merged = theirs.select("id", pick.alias("b")).select("id", (-F.col("b.neg")).alias("nn_id"), F.col("b.sim").alias("sim"))
    return found.join(own.select("id"), "id", "left_anti").select("id", "nn_id", "sim").unionByName(merged)


# Rows on which the hash tables' recall is measured, and the recall they must reach.
RECALL_ROWS = 256
RECALL = 0.9
MAX_TABLES = 64


def _lsh_search(unit: DataFrame, n: int, block: int, tables: int, bucket_rows: int, seed: int) -> DataFrame:
    """Random-hyperplane hash tables, doubled until the measured recall reaches RECALL.

    Recall is that of the first RECALL_ROWS rows by md5 against the exact search over all rows;
    if MAX_TABLES tables don't reach it, the exact index answers.  Rows alone in all their
    buckets are answered exactly.
    """
    from winnow.functions.hashing import draw_key
    unit = materialize(unit)
    dim = len(unit.select("v").first()["v"])
    bits = max(0, int(math.ceil(math.log2(max(n / float(bucket_rows), 1.0)))))
    sample = materialize(unit.orderBy(draw_key(seed, "recall", "id"), "id").limit(RECALL_ROWS))
    true = materialize(_tiled(sample, unit, RECALL_ROWS, n, block, True))
    while tables <= MAX_TABLES:
        found = materialize(_tiled_grouped(_hyperplane_buckets(unit, dim, tables, bits, seed), block))
        alone = materialize(unit.join(found.select(F.col("example_id").alias("id")), "id", "left_anti"))
        rest = _tiled(alone, unit, alone.count(), n, block, True)
        found = found.unionByName(rest)
        hit = true.join(found.select("example_id", F.col("sim").alias("got")), "example_id").where("got = sim").count()
        if hit >= RECALL * true.count():
            return found.withColumnRenamed("example_id", "id")
        tables *= 2
    return _index_search(unit, INDEX_BLOCK)


def nearest_neighbor(vecs: DataFrame, mode: str = "index", block: int = 512, id_col: str = ID,
                     vec_col: str = "vec", tables: int = 8, bucket_rows: int = 2048,
                     seed: int = 7) -> DataFrame:
    """F8: the most cosine-similar *other* row (ties to the lower id), ``(example_id, nn_id, sim)``.

    ``index``: exact, by a :class:`MetricIndex`; clustered vectors compare a fraction of all
    block pairs, without structure it degrades to all of them.
    ``exact``: tiled search of all pairs (work N^2 d / #cores, memory 2 * block * d per task).
    ``lsh``: approximate, at least ``tables`` hash tables with buckets of about
    ``bucket_rows``, more until the recall measured on a sample reaches RECALL.

    A single row has no neighbour and no result; rows with a null vector are left out.
    """
    unit = _unit(vecs.where(F.col(vec_col).isNotNull()), id_col, vec_col)
    if mode == "index":
        return _index_search(unit, INDEX_BLOCK).withColumnRenamed("id", id_col)
    n = unit.count()
    if mode == "exact":
        return _tiled(unit, unit, n, n, block, True).withColumnRenamed("example_id", id_col)
    if mode != "lsh":
        raise ValueError("mode must be 'index', 'exact' or 'lsh'")
    if n < 2:
        return _tiled(unit, unit, n, n, block, True).withColumnRenamed("example_id", id_col)
    return _lsh_search(unit, n, block, tables, bucket_rows, seed).select(F.col("id").alias(id_col), "nn_id", "sim")


def pairwise_similarity_agg(vecs: DataFrame, val_vecs: DataFrame, agg: str = "mean",
                            block: int = 512, id_col: str = ID, vec_col: str = "vec") -> DataFrame:
    """per row, mean or max cosine over the validation rows.

    mean = x_hat . mean(v_hat) (one broadcast centroid); max = tiled search.
    """
    left = _unit(vecs, id_col, vec_col)
    right = _unit(val_vecs, id_col if id_col in val_vecs.columns else val_vecs.columns[0], vec_col)
    if agg == "mean":
        c = centroid(right.withColumnRenamed("v", "vec"), "vec").select(F.col("vec").alias("_c"))
        return left.crossJoin(F.broadcast(c)).select(F.col("id").alias(id_col),
                                                     dot(F.col("v"), F.col("_c")).alias("score"))
    if agg != "max":
        raise ValueError("agg must be 'mean' or 'max'")
    best = _tiled(left, right, left.count(), right.count(), block, False)
    return best.select(F.col("example_id").alias(id_col), F.col("sim").alias("score"))


def kmeans_labels(vecs: DataFrame, k: int, seed: int = 42, iters: int = 25, id_col: str = ID,
                  vec_col: str = "vec", engine: str = "lloyd") -> DataFrame:
    """Lloyd's k-means -> ``(example_id, label)``.

    ``lloyd``: the k initial centres are the rows with the smallest
    md5(seed:kmeans-init:id) draws (partition-independent); each iteration is
    one job (nearest centre in numpy chunks with the k x d centres broadcast,
    then per-label ``Summarizer.mean`` with k x d numbers to the driver); an
    empty cluster keeps its centre; it stops early when the centres no longer
    change.  ``mllib``: MLlib KMeans
    with random init (its sample depends on the input partitioning).
    """
    from pyspark.ml.functions import array_to_vector
    if engine == "mllib":
        from pyspark.ml.clustering import KMeans
        feats = vecs.select(id_col, array_to_vector(to_double(vec_col)).alias("features"))
        model = KMeans(k=k, seed=seed, maxIter=iters, initMode="random", tol=0.0,
                       featuresCol="features", predictionCol="label").fit(feats)
        return model.transform(feats).select(id_col, F.col("label").cast("long").alias("label"))
    x = materialize(vecs.select(id_col, to_double(vec_col).alias("v")))
    used = lloyd_centers(x, max(1, min(k, x.count())), seed, iters, id_col)
    return _assign(x, used, id_col).select(id_col, "label")          # the labels of the last pass


def lloyd_centers(x: DataFrame, k: int, seed: int, iters: int, id_col: str) -> np.ndarray:
    """Centres that the last of ``iters`` passes over ``x(id, v)`` used (see :func:`kmeans_labels`)."""
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.stat import Summarizer
    from winnow.functions.hashing import draw_key
    init = (x.withColumn("_d", draw_key(seed, "kmeans-init", id_col))
             .orderBy("_d", id_col).limit(k).select("v").collect())
    centers = np.array([r["v"] for r in init], dtype=np.float64)
    used = centers
    for _ in range(iters):
        used = centers
        lab = _assign(x, centers, id_col).select("label", array_to_vector("v").alias("f"))
        means = lab.groupBy("label").agg(Summarizer.mean(F.col("f")).alias("m")).collect()
        new = centers.copy()
        for r in means:
            new[int(r["label"])] = r["m"].toArray()
        if np.array_equal(new, centers):
            break
        centers = new
    return used


def _assign(x: DataFrame, centers: np.ndarray, id_col: str) -> DataFrame:
    """``(id, v, label)``: nearest centre per row in numpy chunks (centres broadcast;
    distances to 9 digits, ties to the lower index)."""
    bc = x.sparkSession.sparkContext.broadcast(centers)

    def run(batches):
        c = bc.value
        half_norm = np.einsum("ij,ij->i", c, c) / 2
        chunk = max(1, 2_000_000 // max(len(c), 1))
        for pdf in batches:
            for lo in range(0, len(pdf), chunk):
                part = pdf.iloc[lo:lo + chunk]
                v = np.vstack(part["v"].to_numpy()) if len(part) else np.zeros((0, c.shape[1]))
                # |v - c|^2 orders the centres as |c|^2 / 2 - v.c does.
                far = np.round(half_norm - v @ c.T, SIM_DIGITS)
                out = part[[id_col, "v"]].copy()
                out["label"] = np.argmin(far, axis=1).astype(np.int64)
                yield out
    return x.mapInPandas(run, f"{id_col} long, v array<double>, label long")


__all__ = ["encode_mean_pool", "encode_position_pool", "l2_normalize", "centroid",
           "cosine_to_centroid", "select_embedding", "anchor_mean_cosine", "nearest_neighbor",
           "pairwise_similarity_agg", "kmeans_labels", "token_vector", "long_form", "MetricIndex"]
