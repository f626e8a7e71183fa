"""Periodic runs of words: recompression grammar, exact extensions, harmonic grid.

A run is a stretch of consecutive words with smallest period q, at least ``max(24, 3 q)``
words long, that no neighbouring word extends.  Documents are independent rows, so the
search is one ``mapInArrow`` pass without a shuffle.  Inside a task, runs of documents are
laid end to end (a symbol of its own between them):

1. *Candidates.*  For every period q, words on a grid of step q are compared with those q
   further.  A run covers two neighbouring grid points whose words agree, so nothing is
   missed; all grids together have n ln n points.  Texts without a candidate end here.
2. *Grammar.*  The others get a run-length grammar by recompression: block compression
   (a stretch of one symbol becomes one) alternates with pair compression (symbols fall
   into left and right ones by a hash; each left-right neighbour pair becomes one).
3. *Extensions.*  Equal stretches get equal symbols but at their ends, so the longest
   common extension of two places climbs the levels while symbols agree and descends
   where they differ.  Both directions give the run of a candidate exactly.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winnow.llm.common import fresh, mix64, ready, slices, with_text

LEAST_LENGTH = 24
LEAST_POWER = 3
# Bytes of text handled together (or one longer text).
GROUP_BYTES = 2 << 20
# Extension queries answered together.
QUERIES = 1 << 17

Edit = Callable[[object, list], list]


class Grammar:
    """Run-length grammar of a sequence of ids by recompression.

    Level t has the start of each symbol and the symbols; ``block[t]`` says how level
    t + 1 came from it.  Equal symbols stand for equal stretches.  The first and the last
    id must occur once, so that no extension leaves the sequence.
    """

    def __init__(self, ids: np.ndarray, least: int = 16):
        n = len(ids)
        self.starts, self.symbols, self.block = [np.arange(n + 1)], [ids.astype(np.int64)], []
        top = int(ids.max(initial=0)) + 1
        stalled = 0
        while len(self.symbols[-1]) > least and stalled < 3:
            size = len(self.symbols[-1])
            top = self._blocks(top)
            top = self._pairs(top)
            stalled = 0 if len(self.symbols[-1]) < size else stalled + 1

    def _level(self, first: np.ndarray, symbols: np.ndarray, block: bool) -> None:
        self.starts.append(np.append(self.starts[-1][first], self.starts[-1][-1]))
        self.symbols.append(symbols)
        self.block.append(block)

    def _blocks(self, top: int) -> int:
        s = self.symbols[-1]
        first = np.flatnonzero(np.diff(s, prepend=s[0] - 1))
        if len(first) == len(s):
            return top
        count = np.diff(first, append=len(s))
        out = s[first]
        many = np.flatnonzero(count > 1)
        kinds, which = np.unique(out[many] * (int(count.max()) + 1) + count[many], return_inverse=True)
        out[many] = top + which
        self._level(first, out, True)
        return top + len(kinds)

    def _pairs(self, top: int) -> int:
        s = self.symbols[-1]
        seed = np.uint64((0x9E3779B97F4A7C15 * (len(self.block) + 1)) % 2**64)
        right = (mix64(s.astype(np.uint64) ^ seed) & np.uint64(1)).astype(bool)
        at = np.flatnonzero(~right[:-1] & right[1:])
        if not len(at):
            # the next round's hash differs
            self.block.append(False)
            self.starts.append(self.starts[-1])
            self.symbols.append(s)
            return top
        kinds, which = np.unique(s[at] * top + s[at + 1], return_inverse=True)
        out = s.copy()
        out[at] = top + which
        keep = np.ones(len(s), bool)
        keep[at + 1] = False
        first = np.flatnonzero(keep)
        self._level(first, out[first], False)
        return top + len(kinds)

    def _step(self, t: int, x: np.ndarray, y: np.ndarray, back: bool) -> np.ndarray:
        """Words by which both places may move over equal symbols of level t.

        That is one symbol, or what both have of a block of one symbol.
        """
        starts, symbols = self.starts[t], self.symbols[t]
        a, b = (np.searchsorted(starts, p) - back for p in (x, y))
        same = symbols[a] == symbols[b]
        if t < len(self.block) and self.block[t]:
            over = self.starts[t + 1]
            if back:
                room = [p - over[np.searchsorted(over, p) - 1] for p in (x, y)]
            else:
                room = [over[np.searchsorted(over, p, "right")] - p for p in (x, y)]
            size = np.minimum(*room)
        else:
            size = starts[a + 1] - starts[a]
        return np.where(same, size, 0)

    def _edge(self, t: int, x: np.ndarray) -> np.ndarray:
        return self.starts[t][np.searchsorted(self.starts[t], x)] == x

    def extension(self, x: np.ndarray, y: np.ndarray, back: bool = False) -> np.ndarray:
        """Per pair of different places the longest common stretch from them on.

        ``back``: the longest one that ends just before them.
        """
        moved = np.zeros(len(x), np.int64)
        top = len(self.symbols) - 1
        stop = np.full(len(x), top)
        sign = -1 if back else 1
        live = np.arange(len(x))
        for t in range(top):
            if not len(live):
                break
            p, q = x[live] + sign * moved[live], y[live] + sign * moved[live]
            low = np.flatnonzero(~(self._edge(t + 1, p) & self._edge(t + 1, q)))
            if len(low):
                step = self._step(t, p[low], q[low], back)
                moved[live[low]] += step
                p, q = p[low] + sign * step, q[low] + sign * step
                ends = (step == 0) | ~(self._edge(t + 1, p) & self._edge(t + 1, q))
                stop[live[low[ends]]] = t
                keep = np.ones(len(live), bool)
                keep[low[ends]] = False
                live = live[keep]
        while len(live):
            step = self._step(top, x[live] + sign * moved[live], y[live] + sign * moved[live], back)
            moved[live] += step
            live = live[step > 0]
        for t in range(top - 1, -1, -1):
            live = np.flatnonzero(stop > t)
            if len(live):
                moved[live] += self._step(t, x[live] + sign * moved[live], y[live] + sign * moved[live], back)
        return moved


def grid_candidates(ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places x and periods q such that a run with period q may cover x to x + q.

    ``ids`` are stretches of ``sizes`` words, longest first, each followed by one id of
    its own.  A run of period q has words x and x + q equal on ``max(24, 3 q) - q`` places,
    so at two neighbouring points of a grid of half that step.
    """
    xs, qs = [], []
    ends = np.cumsum(sizes + 1)
    longest = int(sizes[0]) if len(sizes) else 0
    q = 1
    while max(LEAST_LENGTH, LEAST_POWER * q) <= longest:
        least = max(LEAST_LENGTH, LEAST_POWER * q)
        n = int(ends[np.searchsorted(-sizes, -least, "right") - 1])       # the texts of at least that size
        g = (least - q) // 2
        same = ids[:n - q:g] == ids[q:n:g]
        at = np.flatnonzero(same[:-1] & same[1:]) * g
        for off in (g // 2, 1, g - 1, g // 3):
            if not len(at):
                break
            at = at[ids[at + off] == ids[at + off + q]]
        if len(at):
            xs.append(at)
            qs.append(np.full(len(at), q))
        q += 1
    if not xs:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(xs), np.concatenate(qs)


class _Ids(dict):
    def __missing__(self, word):
        self[word] = k = len(self)
        return k


def find_all(texts: list[list]) -> list[list[tuple[int, int, int]]]:
    """Per list of words its runs ``(start, length, period)`` by start, then period."""
    out: list[list] = [[] for _ in texts]
    ids = _Ids()
    long = [k for k in range(len(texts)) if len(texts[k]) >= LEAST_LENGTH]
    long.sort(key=lambda k: -len(texts[k]))
    if not long:
        return out
    rows = [np.fromiter(map(ids.__getitem__, texts[k]), np.int64, len(texts[k])) for k in long]
    sizes = np.array([len(r) for r in rows])
    # a symbol of its own after each text
    laid = [part for k, r in enumerate(rows) for part in (r, [len(ids) + k])]
    x, q = grid_candidates(np.concatenate(laid), sizes)
    ends = np.cumsum(sizes + 1)
    inside = x + q < ends[np.searchsorted(ends, x, "right")]
    x, q = x[inside], q[inside]
    if not len(x):
        return out
    # the texts that have candidates, with a symbol of its own in front
    with_any, which = np.unique(np.searchsorted(ends, x, "right"), return_inverse=True)
    begin = np.concatenate(([1], 1 + np.cumsum(sizes[with_any] + 1)))
    x = x - (ends - sizes - 1)[with_any][which] + begin[:-1][which]
    laid = [[len(ids)], *(part for j, k in enumerate(with_any) for part in (rows[k], [len(ids) + 1 + j]))]
    grammar = Grammar(np.concatenate(laid), least=4 * len(with_any) + 16)
    found = []
    for lo in range(0, len(x), QUERIES):
        a, p = x[lo:lo + QUERIES], q[lo:lo + QUERIES]
        left = grammar.extension(a, a + p, back=True)
        size = left + grammar.extension(a, a + p) + p
        ok = size >= np.maximum(LEAST_LENGTH, LEAST_POWER * p)
        found.append(np.unique(np.stack([a - left, size, p])[:, ok], axis=1))
    start, size, p = np.unique(np.concatenate(found, axis=1), axis=1)
    # a stretch with several periods has their least
    first = np.ones(len(start), bool)
    first[1:] = (start[1:] != start[:-1]) | (size[1:] != size[:-1])
    start, size, p = start[first], size[first], p[first]
    text = np.searchsorted(begin, start, "right") - 1
    order = np.lexsort((p, start))
    for s, n, period, t in zip(start[order].tolist(), size[order].tolist(), p[order].tolist(), text[order].tolist()):
        out[long[with_any[t]]].append((s - int(begin[t]), n, period))
    return out


def kept_words(words: list, runs: list) -> list:
    """The words without those that a run contains after its first period."""
    if not runs:
        return words
    depth = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        depth[start + period] += 1
        depth[start + length] -= 1
    return [words[k] for k in np.flatnonzero(np.cumsum(depth[:-1]) == 0)]


def _analysed(batch: pa.RecordBatch, id_at: int, text_at: int, edit: Edit | None) -> Iterator[tuple]:
    """``(first row, [(words, runs), ...])`` for groups of rows of bounded size."""
    ids = batch.column(id_at).to_pylist() if edit else None
    texts = batch.column(text_at).cast(pa.large_binary())
    first, words, held = 0, [], 0
    for k in range(batch.num_rows):
        raw = texts[k].as_py() or b""
        w = raw.split()                          # bytes split at exactly [\x20\x09-\x0D]
        words.append(edit(ids[k], w) if edit else w)
        held += len(raw)
        if held >= GROUP_BYTES or k + 1 == batch.num_rows:
            yield first, list(zip(words, find_all(words)))
            first, words, held = k + 1, [], 0


def strongest(runs: list) -> tuple[int, int, int]:
    """The run with the greatest length / period, then smallest start, then smallest period."""
    return min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]))


def _hex(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def _reporter(edit: Edit | None):
    def run(batches):
        for batch in batches:
            for b in slices([batch]):
                for first, group in _analysed(b, 0, 1, edit):
                    rows = []
                    for words, runs in group:
                        best = strongest(runs) if runs else (None, None, None)
                        rows.append((len(words), len(runs), *best, 1000 * best[1] // best[2] if runs else None,
                                     _hex("".join("%d,%d,%d\n" % r for r in runs).encode()),
                                     _hex(b" ".join(kept_words(words, runs)))))
                    cols = list(zip(*rows))
                    yield pa.RecordBatch.from_arrays(
                        [b.column(0).slice(first, len(group)), *(pa.array(c, pa.int64()) for c in cols[:6]),
                         *(pa.array(c, pa.string()) for c in cols[6:])],
                        names=["id", "n_words", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256",
                               "collapsed_sha256"])
    return run


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edit: Edit | None = None) -> DataFrame:
    """One row per document: how many runs, the strongest one, digests of all and of the rest.

    ``n_words``, ``n_runs``; ``start``, ``length``, ``period`` and ``exponent_milli`` of the run
    with the greatest length / period (null without runs); ``runs_sha256`` over the lines
    ``start,length,period`` of all runs; ``collapsed_sha256`` over the words that no run
    repeats, joined by one space.  ``edit(id, words)`` may replace the words first.

    Words are ``[^\\x20\\x09-\\x0D]+``, compared as they are.  A null or empty text has no words
    and no runs.  Repeated rows and null ids are rows like others; an empty table gives an
    empty result.  Other columns are ignored.  A text is one task's work, of any length.
    """
    ready(docs.sparkSession)
    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    t = d.schema["id"].dataType.simpleString()
    out = d.mapInArrow(_reporter(edit), f"id {t}, n_words long, n_runs long, start long, length long, period long, "
                                        "exponent_milli long, runs_sha256 string, collapsed_sha256 string")
    return out.withColumnRenamed("id", id_col)


def _lister(batches):
    for batch in batches:
        for b in slices([batch]):
            for first, group in _analysed(b, 0, 1, None):
                found = [(first + k, *r) for k, (_, runs) in enumerate(group) for r in runs]
                if found:
                    at, *cols = zip(*found)
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), *(pa.array(c, pa.int64()) for c in cols)],
                                                     names=["id", "start", "length", "period"])


def runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per run: ``id_col, start, length, period`` (word numbers from 0).

    Edge cases as in :func:`report`; a document without runs has no row.
    """
    ready(docs.sparkSession)
    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    t = d.schema["id"].dataType.simpleString()
    return d.mapInArrow(_lister, f"id {t}, start long, length long, period long").withColumnRenamed("id", id_col)


def _collapser(text_at: int, names: list[str]):
    def run(batches):
        for batch in batches:
            for b in slices([batch]):
                texts = []
                for _, group in _analysed(b, text_at, text_at, None):
                    at = len(texts)
                    texts += [b.column(text_at)[at + k].as_py() if not found else b" ".join(kept_words(words, found)).decode()
                              for k, (words, found) in enumerate(group)]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], names=names)
    return run


def collapse(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with each run cut down to its first period.

    Texts with a run become their remaining words joined by one space; all others, nulls
    included, stay as they are.  All rows and columns are kept.
    """
    ready(docs.sparkSession)
    d, text_at, _ = with_text(docs, text_col)
    safe = [f"c{k}" for k in range(len(d.columns))]
    new = fresh("new", safe)
    schema = ", ".join(f"{n} {f.dataType.simpleString()}" for n, f in zip(safe, d.schema)) + f", {new} string"
    out = d.toDF(*safe).mapInArrow(_collapser(text_at, [*safe, new]), schema)
    return out.select(*(F.col(new if c == text_col else s).alias(c) for s, c in zip(safe, docs.columns)))
