"""Mixing sources to target weights by entropy balancing (DataFrame operations only).

Each source has one constraint: the tokens taken from it equal its target.  The rates
``w`` in [0, 2] of least relative entropy to a uniform rate of one copy are an
exponential tilt by the token count,

    w = 2 e^(l x) / (1 + e^(l x)),   x = size / mean size of the source,

with one multiplier ``l`` per source, the solution of the convex dual.  Newton steps,
kept inside a bracket, solve all sources at once; each is one grouped aggregation over
the counts per (source, size), which hold all documents exactly.

Rates are rounded by sequential Poisson sampling with hash draws: per source, documents
are ordered by draw / fraction and taken up to the tokens still due.  The cut is found
in histograms of the order (each level splits the bin that the cut falls in), then a few
single documents are toggled to come nearer.  No source is ever sorted or gathered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from winnow.llm.common import cut, ready, small

NEWTON_STEPS = 16
# Bins per level, and levels, of the search for the cut.
BINS, LEVELS = 1024, 3
TOGGLES = 6


def size_of(text):
    """Number of ``[^\\x20\\x09-\\x0D]+`` in the text, null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit("[^ \\t\\n\\x0B\\f\\r]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, share: float = 1.5, weights=(3, 1, 2), cap: float = 2.0) -> DataFrame:
    """``sizes(source, tokens)``, one row per source -> target tokens per source.

    Sources by code point, null last, take ``weights`` in turn and share ``share`` times
    all tokens; a target stops at ``cap`` times its source's tokens and the excess is
    shared among the rest by weight until none is above.  The level ``k`` at which
    ``sum(min(cap * tokens, k * weight))`` is the total solves this at once: sources in
    order of ``cap * tokens / weight`` are full up to a point.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    at = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), at + 1)
    t = sizes.withColumn("weight", weight).withColumn("most", F.col("tokens") * F.lit(float(cap)))
    t = t.withColumn("ratio", F.col("most") / F.col("weight"))
    by = Window.orderBy("ratio", F.col("source").isNull(), "source")
    every = Window.partitionBy()
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    t = (t.withColumn("full", F.coalesce(F.sum("most").over(before), F.lit(0.0)))
         .withColumn("open", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
         .withColumn("total", F.sum("tokens").over(every) * F.lit(float(share)))
         .withColumn("k", (F.col("total") - F.col("full")) / F.col("open")))
    # the first source that its level does not fill fixes the level of all that follow
    t = t.withColumn("level", F.min(F.when(F.col("ratio") >= F.col("k"), F.struct("ratio", "full", "k"))).over(every)["k"])
    return t.select("source", "tokens", "weight",
                    F.when(F.col("level").isNull(), F.col("most"))
                    .otherwise(F.least(F.col("most"), F.col("level") * F.col("weight"))).alias("target"))


def _rate(l, x):
    """2 e^(lx) / (1 + e^(lx)), without overflow."""
    e = F.exp(-F.abs(l * x))
    return F.when(l * x >= 0, 2.0 / (1.0 + e)).otherwise(2.0 * e / (1.0 + e))


def solve(hist: DataFrame, goal: DataFrame, steps: int = NEWTON_STEPS) -> DataFrame:
    """``hist(source, size, n)``, ``goal(source, tokens, docs, target)`` -> ``(source, l, mean, target, tokens)``.

    Newton steps on every source's dual at once; a step that leaves the bracket becomes a
    bisection.  A target of 0 or of twice the tokens has its solution at the limit.
    """
    state = goal.select("source", "target", "tokens", (F.col("tokens") / F.col("docs")).alias("mean"),
                        F.lit(0.0).alias("l"), F.lit(-1e6).alias("lo"), F.lit(1e6).alias("hi"))
    for step in range(steps):
        h = hist.select(F.col("source").alias("hs"), "size", "n")
        j = h.join(state, F.col("hs").eqNullSafe(F.col("source")))
        x = F.col("size") / F.col("mean")
        w = _rate(F.col("l"), x)
        got = j.groupBy("source", "target", "tokens", "mean", "l", "lo", "hi").agg(
            F.sum(F.col("n") * F.col("size") * w).alias("got"),
            F.sum(F.col("n") * F.col("size") * x * w * (1.0 - w / 2.0)).alias("slope"))
        miss = F.col("target") - F.col("got")
        got = (got.withColumn("lo", F.when(miss > 0, F.greatest("lo", "l")).otherwise(F.col("lo")))
               .withColumn("hi", F.when(miss < 0, F.least("hi", "l")).otherwise(F.col("hi"))))
        newton = F.col("l") + F.try_divide(miss, F.col("slope"))
        mid = F.greatest(F.lit(-60.0), F.least(F.lit(60.0), (F.col("lo") + F.col("hi")) / 2.0))
        inside = (F.col("slope") > 0) & (newton > F.col("lo")) & (newton < F.col("hi"))
        state = got.select("source", "target", "tokens", "mean",
                           F.when(miss == 0, F.col("l")).when(inside, newton).otherwise(mid).alias("l"), "lo", "hi")
        if step % 4 == 3 or step == steps - 1:
            state = cut(state, "dual")
    # sums in another order differ in the last bits, which no rate may depend on
    return state.withColumn("l", F.round("l", 9))


def rates(docs: DataFrame, source_col: str, text_col: str, row_key: list[str], **options):
    """Written tables ``(rows with size, source and key; sources with their dual)``."""
    text, source = F.col(text_col).cast("string"), F.col(source_col).cast("string")
    rows = cut(docs.select(*[F.col(c) for c in row_key], source.alias("source"), size_of(text).alias("size")), "sizes")
    hist = cut(rows.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "hist")
    per = hist.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("tokens"), F.sum("n").alias("docs"))
    per = cut(per, "sources")
    goal = targets(per.select("source", "tokens"), **options)
    goal = per.select(F.col("source").alias("s"), "docs").join(goal, F.col("s").eqNullSafe(F.col("source"))).drop("s")
    goal = cut(goal, "targets")
    return rows, goal, solve(hist.where("size > 0"), goal.where("tokens > 0"))


def _drawn(rows: DataFrame, duals: DataFrame) -> DataFrame:
    """``rows (id, source, size, ...)`` with the rate, its whole copies ``base`` and the place ``v`` of the rest in the order."""
    j = rows.join(duals, F.col("source").eqNullSafe(F.col("gs"))).drop("gs")
    rate = (F.when(F.col("size") == 0, 1.0).when(F.col("target") >= 2.0 * F.col("source_size"), 2.0)
            .when(F.col("target") <= 0, 0.0).otherwise(_rate(F.col("l"), F.col("size") / F.col("mean"))))
    # a uniform draw in (0, 1) from 52 bits of an md5
    draw = (F.conv(F.substring(F.md5(F.concat_ws(":", F.coalesce(F.col("id").cast("string"), F.lit("null")),
                                                 F.col("size").cast("string"))), 1, 13), 16, 10).cast("double")
            + 0.5) / float(1 << 52)
    return (j.withColumn("rate", rate).withColumn("u", draw).drop("l", "mean")
            .withColumn("base", F.floor("rate")).withColumn("part", F.col("rate") - F.col("base"))
            .withColumn("v", F.when(F.col("part") > 0, F.col("u") / (F.col("u") + F.col("part")))))


def _rounded(drawn: DataFrame, due: DataFrame) -> DataFrame:
    """``copies`` of every drawn row: the whole ones, and one more before its source's cut."""
    return (drawn.join(due.select("s", "low"), F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
            .withColumn("copies", (F.col("base") + F.when(F.col("v") < F.col("low"), 1).otherwise(0)).cast("int"))
            .drop("low", "u", "base", "part"))


def _moved(rows: DataFrame, moved: DataFrame | None) -> DataFrame:
    """``copies`` after the toggles."""
    if moved is None:
        return rows
    return (rows.join(moved, F.col("id").eqNullSafe(F.col("mid")) & F.col("source").eqNullSafe(F.col("ms"))
                      & (F.col("size") == F.col("msize")), "left")
            .withColumn("copies", F.col("copies") + F.coalesce("way", F.lit(0)))
            .drop("mid", "ms", "msize", "way"))


def _planned(docs: DataFrame, id_col: str, source_col: str, text_col: str, share: float, weights, cap: float, toggles: int):
    """Written tables ``(rows with rate and rounded copies; per source its dual, its cut; toggles or None)``.

    The last three have a row or a few per source and decide the copies of a row by its id, source and size.
    """
    if cap != 2.0:
        raise ValueError("rates lie in [0, 2]")
    ready(docs.sparkSession)
    rows, goal, dual = rates(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"),
                                         F.col(text_col).alias("text")),
                             "source", "text", ["id"], share=share, weights=weights, cap=cap)
    g = goal.select(F.col("source").alias("gs"), F.col("tokens").alias("source_size"), "target")
    d = dual.select(F.col("source").alias("ds"), "l", "mean")
    g = cut(g.join(d, F.col("gs").eqNullSafe(F.col("ds")), "left").drop("ds"), "dual")
    b = cut(_drawn(rows.select("id", "source", "size"), g), "rates")

    # tokens due above the whole copies, then the cut in the order of v, level by level
    due = b.groupBy("source").agg(F.first("target").alias("goal"),
                                  F.sum(F.col("base") * F.col("size")).alias("sure"))
    due = cut(due.select(F.col("source").alias("s"), (F.col("goal") - F.col("sure")).alias("due"),
                         F.lit(0.0).alias("low"), F.lit(1.0).alias("width")), "due")
    open_ = b.where("v is not null and size > 0")
    for _ in range(LEVELS):
        j = open_.join(due, F.col("source").eqNullSafe(F.col("s"))).where("v >= low and v < low + width")
        bins = (j.withColumn("bin", F.least(F.lit(BINS - 1), F.floor((F.col("v") - F.col("low")) / F.col("width") * BINS)))
                .groupBy("s", "due", "low", "width", "bin").agg(F.sum("size").alias("tokens")))
        run = Window.partitionBy("s").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        bins = bins.withColumn("upto", F.sum("tokens").over(run))
        # the first bin that reaches what is due; if none does, all are taken
        first = (bins.where("upto >= due").groupBy("s")
                 .agg(F.min(F.struct("bin", "upto", "tokens", "due", "low", "width")).alias("x")))
        w = F.col("x.width") / BINS
        step = first.select(F.col("s").alias("s2"), (F.col("x.due") - F.col("x.upto") + F.col("x.tokens")).alias("due2"),
                            (F.col("x.low") + F.col("x.bin") * w).alias("low2"), w.alias("width2"))
        due = cut(due.join(step, F.col("s").eqNullSafe(F.col("s2")), "left")
                  .select("s", F.coalesce("due2", F.lit(0.0)).alias("due"),
                          F.coalesce("low2", F.col("low") + F.col("width")).alias("low"),
                          F.coalesce("width2", F.lit(0.0)).alias("width")), "due")

    # toggle single documents: the largest that still fits into what is missing
    out = cut(_rounded(b, due), "rounded")
    state = cut(out.groupBy("source").agg(F.first("target").alias("goal"),
                                          F.sum(F.col("copies") * F.col("size")).alias("got"))
                .select(F.col("source").alias("s"), (F.col("goal") - F.col("got")).alias("miss")), "miss")
    moved = None
    for _ in range(toggles):
        j = out.where("size > 0").join(state, F.col("source").eqNullSafe(F.col("s")))
        if moved is not None:
            j = j.join(moved.select(F.col("mid"), F.col("ms"), F.col("msize")),
                       F.col("id").eqNullSafe(F.col("mid")) & F.col("source").eqNullSafe(F.col("ms"))
                       & (F.col("size") == F.col("msize")), "left_anti")
        up = (F.col("miss") > 0) & (F.col("copies") < 2)
        down = (F.col("miss") < 0) & (F.col("copies") > 0)
        # |miss| after the toggle must be smaller; the smallest remainder wins, then the smallest id
        rest = F.abs(F.abs("miss") - F.col("size"))
        pick = (j.where((up | down) & (rest < F.abs("miss"))).groupBy("s")
                .agg(F.min(F.struct(rest.alias("rest"), F.col("size").alias("size"), F.col("id").alias("id"),
                                    F.signum("miss").cast("int").alias("way"))).alias("p"),))
        now = pick.select(F.col("p.id").alias("mid"), F.col("s").alias("ms"), F.col("p.size").alias("msize"),
                          F.col("p.way").alias("way"))
        now = cut(now, "toggle")
        if not now.limit(1).count():
            break
        moved = now if moved is None else moved.unionByName(now)
        # repeated rows move together
        m = now.select("ms", "mid", "msize", "way")
        change = (out.join(m, F.col("id").eqNullSafe(F.col("mid")) & F.col("source").eqNullSafe(F.col("ms"))
                           & (F.col("size") == F.col("msize")))
                  .groupBy("ms").agg(F.sum(F.col("way") * F.col("size")).alias("d")))
        state = cut(state.join(change, F.col("s").eqNullSafe(F.col("ms")), "left")
                    .select("s", (F.col("miss") - F.coalesce("d", F.lit(0))).alias("miss")), "miss")
    return out, g, due, moved


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
        share: float = 1.5, weights=(3, 1, 2), cap: float = 2.0, toggles: int = TOGGLES) -> DataFrame:
    """Copies of every document in the mix: ``id_col, source, size, source_size, target, rate, copies, taken``.

    ``taken = copies * size`` with copies 0, 1 or 2.  A null source is a source of its own
    (last in order); null and empty texts have size 0 and are taken once; a source without
    tokens has target 0.  Rows are drawn by the hash of their id and size, so reruns and
    other partitionings agree; repeated rows draw alike.  An empty table gives an empty one.
    """
    out, _, _, moved = _planned(docs, id_col, source_col, text_col, share, weights, cap, toggles)
    out = _moved(out, moved)
    return out.select(F.col("id").alias(id_col), "source", "size", "source_size", "target", "rate", "copies",
                      (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def mixed(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
          share: float = 1.5, weights=(3, 1, 2), cap: float = 2.0, toggles: int = TOGGLES) -> DataFrame:
    """The mix itself: every document as often as it has copies; same columns.

    A row's id, source and size decide its copies, given the tables per source, so the texts are read once more and
    never shuffled; repeated rows are safe.
    """
    _, duals, due, moved = _planned(docs, id_col, source_col, text_col, share, weights, cap, toggles)
    safe = [f"c{k}" for k in range(len(docs.columns))]
    named = dict(zip(docs.columns, safe))
    d = docs.toDF(*safe).withColumns({"id": F.col(named[id_col]), "source": F.col(named[source_col]).cast("string"),
                                      "size": size_of(F.col(named[text_col]).cast("string"))})
    n = duals.count()
    j = _rounded(_drawn(d, small(duals, n, 100_000)), small(due, n, 100_000))
    j = _moved(j, None if moved is None else small(moved, limit=100_000))
    return (j.withColumn("mix_no", F.explode(F.sequence(F.lit(0), F.col("copies"))))
            .where(F.col("mix_no") > 0).select(*[F.col(s).alias(c) for c, s in named.items()]))
