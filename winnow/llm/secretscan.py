"""Secret scans with a trigram index.

From each rule's regular expression a Boolean query over trigrams is derived: what every
match must contain.  Each block of documents gets an inverted index of the trigrams that
any rule asks for (postings over the block's documents), the queries intersect and unite
postings, and the regex verifies the candidates.  A rule without mandatory trigrams (a
bare character class) scans every document.  Blocks are a few MB, so the index is bounded.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from re import _constants as op
from re import _parser as parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winnow.llm.common import ready, text_pieces

# Alternatives kept while joining exact strings, and characters of a class spelled out.
MAX_STRINGS, MAX_CLASS = 64, 10


@dataclass(frozen=True)
class Rule:
    """``pattern`` (ASCII case rules), of which matches with a ``group`` below ``least`` are dropped."""
    kind: str
    pattern: str
    ignore_case: bool = False
    group: int = 0
    least: int = 0

    def compiled(self):
        return re.compile(self.pattern, re.ASCII | (re.IGNORECASE if self.ignore_case else 0))


# The first three kinds, in the order in which equal starts are listed.
BASE_RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
         True, 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", False, 0, 20),
    Rule("hex", r"[0-9a-f]{24,}"),
)
# Public key formats with a fixed prefix.
MORE_RULES = (
    Rule("github", r"gh[oprsu]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)
RULES = BASE_RULES + MORE_RULES

# Queries: True (anything), a trigram, ("and", queries) or ("or", queries).


def _both(queries):
    parts = [q for q in queries if q is not True]
    return True if not parts else parts[0] if len(parts) == 1 else ("and", tuple(parts))


def _either(queries):
    queries = list(queries)
    return True if any(q is True for q in queries) or not queries else \
        queries[0] if len(queries) == 1 else ("or", tuple(queries))


def _fold(c: str) -> str:
    return c.lower() if c.isascii() else c


def _grams(strings) -> object:
    """What holds for a text that contains one of ``strings``; trigrams are of folded UTF-8."""
    def one(s):
        b = s.encode()
        return _both(b[i:i + 3] for i in range(len(b) - 2)) if len(b) > 2 else True
    return _either(one(s) for s in sorted(strings))


def _class(items) -> set | None:
    out = set()
    for kind, value in items:
        if kind is op.LITERAL:
            out.add(_fold(chr(value)))
        elif kind is op.RANGE and value[1] - value[0] < MAX_CLASS:
            out |= {_fold(chr(c)) for c in range(value[0], value[1] + 1)}
        else:
            return None
    return out if len(out) <= MAX_CLASS else None


def _exact(node) -> set | None:
    """All strings a node matches, folded, or None."""
    kind, value = node
    if kind is op.LITERAL:
        return {_fold(chr(value))}
    if kind is op.IN:
        return _class(value)
    if kind is op.AT:
        return {""}
    if kind is op.SUBPATTERN:
        return _exact_all(value[-1])
    if kind is op.BRANCH:
        parts = [_exact_all(p) for p in value[1]]
        return None if None in parts else set().union(*parts)
    if kind is op.MAX_REPEAT and value[1] <= 4:
        part, out = _exact_all(value[2]), set()
        if part is None:
            return None
        for n in range(value[0], value[1] + 1):
            strings = {""}
            for _ in range(n):
                strings = {a + b for a in strings for b in part}
            out |= strings
        return out if len(out) <= MAX_STRINGS else None
    return None


def _exact_all(nodes) -> set | None:
    out = {""}
    for n in nodes:
        e = _exact(n)
        if e is None or len(out) * len(e) > MAX_STRINGS:
            return None
        out = {a + b for a in out for b in e}
    return out


def _query(nodes):
    parts, run = [], {""}
    for node in nodes:
        e = _exact(node)
        if e is not None and len(run) * len(e) <= MAX_STRINGS:
            run = {a + b for a in run for b in e}
            continue
        parts.append(_grams(run))
        run = {""}
        kind, value = node
        if kind is op.SUBPATTERN:
            parts.append(_query(value[-1]))
        elif kind is op.BRANCH:
            parts.append(_either(_query(p) for p in value[1]))
        elif kind in (op.MAX_REPEAT, op.MIN_REPEAT) and value[0] > 0:
            parts.append(_query(value[2]))
    return _both(parts + [_grams(run)])


def trigram_query(rule: Rule):
    """The Boolean trigram query that every text with a match of ``rule`` satisfies."""
    return _query(parser.parse(rule.pattern, re.ASCII | (re.IGNORECASE if rule.ignore_case else 0)))


def query_trigrams(query) -> set[bytes]:
    if query is True:
        return set()
    return {query} if isinstance(query, bytes) else set().union(*(query_trigrams(q) for q in query[1]))


class Index:
    """Postings of chosen trigrams over the documents of one block."""

    def __init__(self, trigrams):
        self.at = {t: k for k, t in enumerate(sorted(trigrams))}
        self.table = np.zeros(1 << 24, np.uint16)
        for t, k in self.at.items():
            self.table[t[0] << 16 | t[1] << 8 | t[2]] = k + 1
        self.fold = np.arange(256, dtype=np.uint32)
        self.fold[65:91] += 32

    def build(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        self.posts = np.zeros((len(self.at), len(starts)), bool)
        if len(data) < 3:
            return
        b = self.fold[data]
        hit = self.table[(b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]]
        pos = np.flatnonzero(hit)
        row = np.searchsorted(starts, pos, "right") - 1
        inside = pos + 2 < ends[row]
        self.posts[hit[pos[inside]] - 1, row[inside]] = True

    def search(self, query) -> np.ndarray:
        if query is True:
            return np.ones(self.posts.shape[1], bool)
        if isinstance(query, bytes):
            return self.posts[self.at[query]]
        parts = [self.search(q) for q in query[1]]
        return (np.logical_and if query[0] == "and" else np.logical_or).reduce(parts)


def find(text: str, rule: Rule, regex) -> list[tuple[int, int]]:
    return [m.span() for m in regex.finditer(text) if m.end(rule.group) - m.start(rule.group) >= rule.least]


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def _scanner(rules):
    def run(batches):
        regexes = [r.compiled() for r in rules]
        queries = [trigram_query(r) for r in rules]
        index = Index(set().union(*(query_trigrams(q) for q in queries)))
        for batch in batches:
            found = [[] for _ in range(batch.num_rows)]
            column = batch.column(1)
            for first, data, starts, ends in text_pieces(column):
                index.build(data, starts, ends)
                texts = {}
                for k, (rule, regex, query) in enumerate(zip(rules, regexes, queries)):
                    for r in np.flatnonzero(index.search(query) & (ends > starts)).tolist():
                        if r not in texts:
                            texts[r] = data[starts[r]:ends[r]].tobytes().decode()
                        for s, e in find(texts[r], rule, regex):
                            found[first + r].append((s, k, e))
            rows = [[{"kind": rules[k].kind, "start": s, "end": e} for s, k, e in sorted(f)] for f in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, _SPANS)], names=["id", "found"])
    return run


def scan(docs: DataFrame, rules=RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, found``: per row the matches ``array<struct<kind, start, end>>``.

    Offsets are code points, the end exclusive; matches are sorted by start, then by the
    order of ``rules``.  Matches of one rule don't overlap, those of two may.  Null and
    empty texts have none; repeated rows are returned as often as they come, null ids too;
    an empty table gives an empty result.  Other columns are ignored.
    """
    ready(docs.sparkSession)
    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = f"id {d.schema['id'].dataType.simpleString()}, found array<struct<kind:string,start:long,end:long>>"
    return d.mapInArrow(_scanner(tuple(rules)), schema).withColumnRenamed("id", id_col)


def listing(found):
    """``kind:start:end`` of an array of matches, comma-joined."""
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def report(docs: DataFrame, rules=RULES, base=tuple(r.kind for r in BASE_RULES), id_col: str = "doc_id",
           text_col: str = "text") -> DataFrame:
    """Per row: counts of the base kinds (``n_<kind>``), sha256 of their listing, listing of all."""
    s = scan(docs, rules, id_col, text_col)
    kinds = F.filter("found", lambda x: x["kind"].isin(*base))

    def count(kind):
        return F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in base]
    return s.select(id_col, *counts, F.sha2(listing(kinds), 256).alias("base_sha256"),
                    listing(F.col("found")).alias("spans"))
