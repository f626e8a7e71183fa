"""Benchmark decontamination with a generalized suffix automaton.

The normalized benchmark items build one suffix automaton over words (in blocks of a
bounded size, so its broadcast is bounded too).  Documents stream through it: after
each word the automaton gives the longest suffix that occurs in an item.  A suffix of
at least ``window`` words ends an occurrence of a window; so does an item shorter than
that when it occurs whole.

Nothing is shuffled.  Of a benchmark beyond one block, each task holds one automaton at a time:
it builds them in turn from the blocks' items and streams a stretch of documents through each,
which extends the spans found so far.  PASS_BLOCKS blocks make a pass; passes are written tables.
"""

from __future__ import annotations

import re
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winnow.llm.common import cut, ready, slices, with_text

# Item text in one automaton (about 400 bytes of memory per byte at the most).
BLOCK_BYTES = 1 << 20
# Blocks whose items are broadcast at once, and the documents that stream through one automaton before
# the next one is built (a build takes about a third of the time of such a stretch).
PASS_BLOCKS = 32
STRETCH_BYTES = 32 << 20

# UTF-8 bytes that are not a word's: controls, space and ASCII punctuation.
_TABLE = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80
               else 0x20 for b in range(256))
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
# The same as characters, for Spark.
_CHARS = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"


def words(text: str | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased."""
    return text.encode().translate(_TABLE).split() if text else []


class Automaton:
    """Suffix automaton of word sequences, with the windows each state completes."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int):
        self.window = window
        self.next, self.link, self.length = [{}], [-1], [0]
        seqs = [(name, words(text)) for name, text in items]
        for _, seq in seqs:
            last = 0
            for w in seq:
                last = self._extend(last, w)
        # `least[s]`: the shortest match in s that completes a window; `long[s]`: the state
        # of its last `window` words; `short[s]`: (length, items) of whole short items.
        n = len(self.link)
        never = 1 << 60
        self.long, self.least, self.short = [-1] * n, [never] * n, [()] * n
        self.items, whole = defaultdict(set), defaultdict(set)
        for s in sorted(range(1, n), key=self.length.__getitem__):
            up = self.link[s]
            if self.length[s] >= window:
                self.long[s] = self.long[up] if self.long[up] >= 0 else s
                self.least[s] = window
        for name, seq in seqs:
            s = 0
            for i, w in enumerate(seq):
                s = self.next[s][w]          # the item itself is in the automaton
                if i + 1 >= window:
                    self.items[self.long[s]].add(name)
            if 0 < len(seq) < window:
                whole[s].add((len(seq), name))
        for s in sorted(range(1, n), key=self.length.__getitem__):
            up = self.link[s]
            own = tuple(sorted(whole[s], key=str)) if s in whole else ()
            self.short[s] = self.short[up] + own
            if self.short[up]:
                self.least[s] = 0
            elif own:
                self.least[s] = min(self.least[s], own[0][0])

    def _extend(self, last: int, w: bytes) -> int:
        nxt, link, length = self.next, self.link, self.length
        if w in nxt[last]:
            q = nxt[last][w]
            return q if length[q] == length[last] + 1 else self._clone(last, w, q)
        cur = len(link)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and w not in nxt[p]:
            nxt[p][w] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][w]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, w, q)
        return cur

    def _clone(self, p: int, w: bytes, q: int) -> int:
        c = len(self.link)
        self.next.append(dict(self.next[q]))
        self.link.append(self.link[q])
        self.length.append(self.length[p] + 1)
        self.link[q] = c
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = c
            p = self.link[p]
        return c

    def scan(self, seq: list[bytes]) -> tuple[list[tuple[int, int]], set, int]:
        """Hit word spans ``[start, end)``, names of items with an occurring window, longest match."""
        nxt, link, length, least = self.next, self.link, self.length, self.least
        root = nxt[0]
        s = n = longest = 0
        ends = []
        for i, w in enumerate(seq):
            t = nxt[s].get(w)
            if t is None:
                if not s:
                    continue
                while t is None and s:
                    s = link[s]
                    t = nxt[s].get(w)
                if t is None:
                    n = 0
                    continue
                n = length[s]
            s = t
            n += 1
            if n >= least[s]:
                ends.append((i, s, n))
            elif n > longest:
                longest = n
        del root
        spans, names = [], set()
        for i, s, n in ends:
            longest = max(longest, n)
            size = 0
            if n >= self.window:
                size = self.window
                names |= self.items[self.long[s]]
            for m, name in self.short[s]:
                if m <= n:
                    size = max(size, m)
                    names.add(name)
            if size:
                a = i + 1 - size
                while spans and spans[-1][1] >= a:
                    a = min(a, spans.pop()[0])
                spans.append((a, i + 1))
        return spans, names, longest


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


_FOUND = [("n_words", "long"), ("longest", "long"), ("items", "array<string>"),
          ("spans", "array<struct<start:long,end:long>>")]
_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _found(a: Automaton, b: pa.RecordBatch, first: bool, text_at: int, names: list[str]) -> pa.RecordBatch:
    """The batch with what the automaton finds, added to what the last four columns hold unless ``first``."""
    n_words, longest, items, spans = [], [], [], []
    old = [] if first else [b.column(b.num_columns - 4 + k).to_pylist() for k in range(4)]
    for r, text in enumerate(b.column(text_at).to_pylist()):
        seq = words(text)
        got, who, most = a.scan(seq)
        who = {x for x in who if x is not None}
        if not first:
            most = max(most, old[1][r])
            who |= set(old[2][r])
            if old[3][r]:
                got = merge_spans(got + [(x["start"], x["end"]) for x in old[3][r]])
        n_words.append(len(seq))
        longest.append(most)
        items.append(sorted(who))
        spans.append([{"start": x, "end": y} for x, y in got])
    keep = [b.column(k) for k in range(b.num_columns - (0 if first else 4))]
    return pa.RecordBatch.from_arrays(
        keep + [pa.array(n_words, pa.int64()), pa.array(longest, pa.int64()),
                pa.array(items, pa.list_(pa.string())), pa.array(spans, _SPAN)], names=names)


def _scan(automaton, text_at: int, names: list[str]):
    """All batches through the one broadcast automaton."""
    def run(batches):
        a = automaton.value
        for b in slices(batches):
            yield _found(a, b, True, text_at, names)
    return run


def _stretches(batches, limit: int):
    """Lists of batches of together about ``limit`` bytes."""
    held, size = [], 0
    for b in batches:
        held.append(b)
        size += b.nbytes
        if size >= limit:
            yield held
            held, size = [], 0
    if held:
        yield held


def _walk(blocks: list, window: int, first: bool, text_at: int, names: list[str], limit: int):
    """All batches through the automata of broadcast blocks of items, one automaton at a time."""
    def run(batches):
        for held in _stretches(slices(batches), limit):
            for k, block in enumerate(blocks):
                a = Automaton(block.value, window)
                held = [_found(a, b, first and k == 0, text_at, names) for b in held]
                del a
            yield from held
    return run


def block_items(items: DataFrame, block, k: int) -> list[tuple[str | None, str | None]]:
    """The items of block ``k``, at most about a block's bytes."""
    return [(r["i"], r["t"]) for r in items.where(block == k).collect()]


def find_items(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id",
               item_text: str = "text", window: int = 10, block_bytes: int = BLOCK_BYTES,
               column: str = "found", finish=None) -> DataFrame:
    """``docs`` plus the struct ``column``: n_words, longest, items, spans.

    ``items`` are the ids (as strings, sorted) of items with an occurring window, ``spans``
    the merged word ranges ``[start, end)`` that lie in occurrences, ``longest`` the longest
    match.  A null or empty text has no words; an item without words matches nothing; an
    item with a null id marks words but isn't listed; repeated items add nothing, repeated
    documents each count for themselves.  An empty benchmark leaves all documents clean.

    ``finish(text position, column names)`` may give a function over the batches of the
    last pass that returns batches of the input's columns; these are the result then.
    """
    spark = docs.sparkSession
    ready(spark)
    it = items.select(F.col(item_id).cast("string").alias("i"), F.col(item_text).cast("string").alias("t"))
    it = cut(it.distinct(), "items")
    size = it.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
    blocks = max(1, -(-size // block_bytes))
    block = F.pmod(F.xxhash64("i", "t"), F.lit(blocks))
    df, text_at, added = with_text(docs, text_col)
    keep = list(df.columns)
    safe = [f"c{k}" for k in range(len(keep))]
    df = df.toDF(*safe)
    schema = ", ".join([f"{n} {f.dataType.simpleString()}" for n, f in zip(safe, df.schema)]
                       + [f"{n} {t}" for n, t in _FOUND])
    bare = schema.split(f", {_FOUND[0][0]} ")[0]
    names = safe + [n for n, _ in _FOUND]
    sc = spark.sparkContext
    for lo in range(0, blocks, PASS_BLOCKS):
        if blocks == 1:
            step = _scan(sc.broadcast(Automaton(block_items(it, block, 0), window)), text_at, names)
        else:
            held = [sc.broadcast(block_items(it, block, k)) for k in range(lo, min(blocks, lo + PASS_BLOCKS))]
            step = _walk(held, window, lo == 0, text_at, names, STRETCH_BYTES)
        if lo + PASS_BLOCKS < blocks:
            df = cut(df.mapInArrow(step, schema), "pass")
        elif finish is None:
            df = df.mapInArrow(step, schema)
        else:                                                # in the same worker
            df = df.mapInArrow(_chained(step, finish(text_at, safe)), bare)
            return df.select(*[F.col(s).alias(n) for s, n in list(zip(safe, keep))[:len(keep) - added]])
    return df.select(*[F.col(s).alias(n) for s, n in list(zip(safe, keep))[:len(keep) - added]],
                     F.struct(*[n for n, _ in _FOUND]).alias(column))


def cut_spans(text: str, spans) -> str:
    """The text without the bytes of the words in ``spans``."""
    raw = text.encode()
    at = [(m.start(), m.end()) for m in _WORD.finditer(raw)]
    out, done = [], 0
    for a, b in spans:
        out.append(raw[done:at[a][0]])
        done = at[b - 1][1]
    out.append(raw[done:])
    return b"".join(out).decode()


def _chained(first, second):
    def run(batches):
        return second(first(batches))
    return run


def _remove(min_span: int, coverage: float, whole: bool = False):
    """The function of the last pass; with ``whole`` only spans that cover the document by themselves count."""
    def finish(text_at: int, names: list[str]):
        def run(batches):
            for b in batches:
                n_words = b.column(b.num_columns - 4).to_pylist()
                spans = b.column(b.num_columns - 1).to_pylist()
                keep, texts = [], {}
                for r, s in enumerate(spans):
                    cut = [(x["start"], x["end"]) for x in s if x["end"] - x["start"] >= min_span
                           and not (whole and x["end"] - x["start"] <= coverage * n_words[r])]
                    if cut and sum(y - x for x, y in cut) > coverage * n_words[r]:
                        continue
                    if cut:
                        texts[r] = cut_spans(b.column(text_at)[r].as_py(), cut)
                    keep.append(r)
                cols = b.columns[:len(names)]
                if texts:
                    column = cols[text_at].to_pylist()
                    for r, t in texts.items():
                        column[r] = t
                    cols[text_at] = pa.array(column, cols[text_at].type)
                out = pa.RecordBatch.from_arrays(cols, names=names)
                yield out if len(keep) == b.num_rows else out.take(pa.array(keep, pa.int64()))
        return run
    return finish


def decontaminate(docs: DataFrame, items: DataFrame, text_col: str = "text", window: int = 10,
                  min_span: int = 1, max_coverage: float = 0.5, spare_short: bool = False, **options) -> DataFrame:
    """``docs`` with benchmark passages removed; same columns.

    Spans of at least ``min_span`` words are cut out of the text; a document of which they
    cover more than ``max_coverage`` is dropped.  Clean documents are returned unchanged.
    Null and empty texts are clean.

    With ``spare_short`` items of fewer than ``window`` words aren't cut out, as they may be
    common words: they drop a document only where one run of their words covers more than
    ``max_coverage`` of it.
    """
    if docs.schema[text_col].dataType.simpleString() != "string":
        raise TypeError(f"{text_col} is no string column")
    if spare_short:
        n = F.regexp_count(F.coalesce(F.col(options.get("item_text", "text")).cast("string"), F.lit("")), F.lit(_CHARS))
        short, items = items.where((n > 0) & (n < window)), items.where(n >= window)
        if short.limit(1).count():
            docs = find_items(docs, short, text_col, window=window, finish=_remove(1, max_coverage, True), **options)
    return find_items(docs, items, text_col, window=window, finish=_remove(min_span, max_coverage), **options)


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """Per document: id, n_words, n_hit, n_items, items_sha256, contaminated, longest, spans."""
    d = docs.select(F.col(id_col), F.col(options.pop("text_col", "text")).alias("text"))
    f = find_items(d, items, "text", **options).select(id_col, "found.*")
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return f.select(id_col, "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                    F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
                    (hit > 0).alias("contaminated"), "longest", "spans")
