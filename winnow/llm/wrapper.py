"""Main text of web pages by wrapper induction.

Every host gets a reference page (its smallest digest).  Each page of the host is aligned
with the reference by simple tree matching of the block elements.  Over all pages of the
host, grouped aggregation tells for each reference node how often the aligned nodes have
the reference's own text (template) or other text (slot), and how much.  The content
region is the deepest element with nearly all varying text.  A page's main text is taken
from the node aligned with that region, without its template nodes and without elements
that are boilerplate by kind (menus, headers, footers, sidebars, notices, adverts, forms,
scripts, styles, comments).  The page's own article is taken instead where the region has
no counterpart on the page, or one outside the article with less text that varies.

Paragraphs of articles of different length align by place only, so inside articles a block
is template also if nearly all pages have its text somewhere in their articles.  Copies are
no evidence: equal pages count once, and a page with nearly the text of the reference
doesn't count for the nodes of articles.

Pages are never gathered by host: statistics are pre-aggregated per task, and a wrapper is
one small row per host.
"""

from __future__ import annotations

import html
import math
import re
from bisect import bisect_right
from collections import OrderedDict
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winnow.llm.common import cut, ready, slices, small

# Reference pages are broadcast up to this many bytes in all.
REFERENCE_BYTES = 8 << 20
# A reference node is template if this share of its aligned nodes has its text, of this many at least.
TEMPLATE_SHARE, TEMPLATE_PAGES = 0.9, 3
# In an article, nodes aligned on fewer than this share of the pages are no template.
TEMPLATE_ALIGNED = 0.5
# A page with this share of its text, and of the reference's, in common is a copy of the reference.
COPY_SHARE = 0.8
# The content region holds this share of the varying text.
REGION_SHARE = 0.9

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol p pre section summary "
    "table tbody td tfoot th thead tr ul".split())
# Elements that are no main text.
DROP = frozenset(
    "head title script style noscript template iframe object embed svg math canvas audio video nav footer aside "
    "input select textarea button datalist dialog menu noembed noframes".split())
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar "
                  "toolbar form".split())
# Words of class and id names that mark boilerplate.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox adslot sponsor sponsored promo promotion banner "
    "cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup "
    "social share sharing sidebar sidebars aside widget widgets menu menus nav navbar navigation breadcrumb "
    "breadcrumbs pagination pager footer footers comment comments reply replies respond disqus related "
    "recommended login search skip toolbar masthead".split())
_HEADER = frozenset(["header", "topbar"])
_NEGATED = frozenset("no not non without has have with".split())
_ABSENT = frozenset("free less off none disabled".split())
# Marks of what readers add; no share of the text makes that the page's own.
_READERS = frozenset("comment comments reply replies respond disqus".split())
# Marked elements with this share of their article's (or page's) text outside links are the text.
OWN_SHARE = 0.8
_HEAD = frozenset("base link meta noscript script style template title".split())
_CLOSES_P = BLOCK - frozenset("body head html caption dd dt li tbody td tfoot th thead tr summary figcaption".split())
_SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"),
             "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "thead": ("tr", "td", "th"),
             "tbody": ("tr", "td", "th", "thead", "tbody"), "tfoot": ("tr", "td", "th", "tbody")}
_SCOPE = {"li": ("ul", "ol", "menu", "dir"), "dt": ("dl",), "dd": ("dl",)}
_TABLE = ("table",)
_BARRIER = ("td", "th", "table", "article", "body")           # inline end tags don't close these

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>"
    r"|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(/?)([A-Za-z][^\s/>]*)([^>]*)>", re.S)
_ATTR = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_SPLIT = re.compile(r"[^A-Za-z0-9]+|(?<=[a-z])(?=[A-Z])")
# Attributes up to this length are read once for all elements that have them.
KNOWN_ATTRS = 200


class Node:
    __slots__ = ("tag", "attrs", "kids", "blocks", "inner", "text", "at", "junk", "size", "inside", "marks", "own")

    def __init__(self, tag: str, attrs: str = ""):
        self.tag, self.attrs, self.kids = tag, attrs, []


class _Open:
    """The open elements, with the places of each tag among them."""

    def __init__(self, root: Node):
        self.nodes, self.places = [root], {}

    def push(self, node: Node) -> None:
        self.places.setdefault(node.tag, []).append(len(self.nodes))
        self.nodes.append(node)

    def last(self, tags) -> int:
        """Place of the innermost open element with one of ``tags``, 0 if there is none."""
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)

    def close(self, place: int) -> None:
        """Close the element at ``place`` and all inside it."""
        for node in self.nodes[place:]:
            self.places[node.tag].pop()
        del self.nodes[place:]

    def imply_end(self, tags: tuple, scope: tuple) -> None:
        """Close the outermost element of ``tags`` inside the innermost one of ``scope``."""
        tags = [t for t in tags if self.places.get(t)]
        if not tags:
            return
        bound = self.last(scope)
        found = []
        for t in tags:
            places = self.places[t]
            k = bisect_right(places, bound)
            if k < len(places):
                found.append(places[k])
        if found:
            self.close(min(found))


def parse(source: str) -> Node:
    """A tolerant tree: elements are Nodes, text is str; omitted end tags are implied."""
    root = Node("html")
    stack, at, n = _Open(root), 0, len(source)
    last_end = source.rfind(">")
    while at < n:
        # behind the last ">" only an unclosed comment is no text
        m = _TOKEN.search(source, at) if at <= last_end or "<!--" in source[at:] else None
        if m is None:
            stack.nodes[-1].kids.append(source[at:])
            break
        if m.start() > at:
            stack.nodes[-1].kids.append(source[at:m.start()])
        at = m.end()
        tag = m[2] or m[5]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1] or m[4]:                                     # an end tag closes up to its element
            place = stack.last((tag,))
            if place and (tag in BLOCK or stack.last(_BARRIER) <= place):
                stack.close(place)
            continue
        attrs = (m[3] if m[2] else m[6]) or ""
        if tag in ("html", "body", "head") and any(s.tag == tag for s in stack.nodes[:3]):
            if tag == "html" and not root.attrs:
                root.attrs = attrs
            continue
        if tag not in _HEAD:
            stack.imply_end(("head",), ())
        if tag in _CLOSES_P:
            stack.imply_end(("p",), ("td", "th", "table", "button"))
        if tag in _SIBLINGS:
            stack.imply_end(_SIBLINGS[tag], _SCOPE.get(tag, _TABLE))
        node = Node(tag, attrs)
        stack.nodes[-1].kids.append(node)
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*>", re.I).search(source, at)
            if tag in ("title", "textarea"):
                node.kids.append(source[at:end.start() if end else n])
            at = end.end() if end else n
        elif tag not in VOID and not attrs.endswith("/"):
            stack.push(node)
    return root


def attributes(attrs: str) -> dict:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTR.finditer(attrs)}


def is_junk(node: Node, in_article: bool) -> bool:
    """Boilerplate by element or role; an article's own header isn't."""
    if node.tag in DROP or node.tag == "header" and not in_article:
        return True
    if not node.attrs or node.tag in ("article", "main", "body", "html"):
        return False
    return _hidden(node.attrs) if len(node.attrs) <= KNOWN_ATTRS else _hidden.__wrapped__(node.attrs)


@lru_cache(4096)
def _hidden(attrs: str) -> bool:
    a = attributes(attrs)
    if "hidden" in a or a.get("aria-hidden", "").lower() == "true" or a.get("role", "").lower() in ROLES:
        return True
    return "style" in a and bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", a["style"], re.I))


def marks_of(node: Node, in_article: bool) -> frozenset:
    """Words of the class and id that hint at boilerplate; forms hint at it by their tag.

    A name that says that something is absent or only there as well (``no-comments``,
    ``has-sidebar``, ``ad-free``) gives no hint.
    """
    found = _NO_MARKS
    if node.attrs and node.tag not in ("article", "main", "body", "html"):
        read = _named if len(node.attrs) <= KNOWN_ATTRS else _named.__wrapped__
        found = read(node.attrs, in_article)
    return found | {"form"} if node.tag == "form" else found


_NO_MARKS = frozenset()
_KNOWN = {True: MARKS, False: MARKS | _HEADER}


@lru_cache(4096)
def _named(attrs: str, in_article: bool) -> frozenset:
    a, known, found = attributes(attrs), _KNOWN[in_article], set()
    for name in f"{a.get('class', '')} {a.get('id', '')}".split():
        words = [w.lower() for w in _SPLIT.split(name) if w]
        for k, w in enumerate(words):
            if w in known and not _NEGATED & set(words[:k]) and not _ABSENT & set(words[k + 1:]):
                found.add(w)
    return frozenset(found)


def text_of(raw: list[str]) -> str:
    return " ".join(html.unescape("".join(raw)).split())


def prepare(root: Node) -> list[Node]:
    """Number the block elements in page order; set their block children, junk mark and own text blocks.

    ``blocks`` of a node lists, in order, its block children (``inner``) and its own runs of text (``text``).
    """
    order: list[Node] = []

    def visit(node: Node, junk: bool, article: bool, marks: frozenset) -> None:
        node.at, node.junk, node.inside, node.marks, node.own = len(order), junk, article, marks, 0
        order.append(node)
        node.blocks, run = [], []

        def flush():
            if run:
                t = text_of(run)
                run.clear()
                if t:
                    node.blocks.append(t)

        work, links = [(iter(node.kids), False)], 0          # inline elements are walked without recursion
        while work:
            for kid in work[-1][0]:
                if isinstance(kid, str):
                    run.append(kid)
                    node.own += 0 if links else len(kid.strip())
                elif kid.tag in BLOCK:
                    flush()
                    inner = article or kid.tag in ("article", "main")
                    node.blocks.append(kid)
                    todo.append((kid, junk or is_junk(kid, article), inner, marks_of(kid, article)))
                elif kid.tag == "br":
                    run.append(" ")
                elif not is_junk(kid, article) and not marks_of(kid, article):
                    link = kid.tag in ("a", "label")
                    links += link
                    work.append((iter(kid.kids), link))
                    break
            else:
                links -= work.pop()[1]
        flush()
        node.inner = [k for k in node.blocks if isinstance(k, Node)]
        node.text = "\n".join(k for k in node.blocks if isinstance(k, str))

    todo = [(root, False, False, frozenset())]
    while todo:                                              # breadth-first numbering, no recursion limit
        batch, todo = todo, []
        for item in batch:
            visit(*item)
    for node in reversed(order):                             # size of the subtree, a cheap shape signature
        node.size = hash((node.tag, tuple([k.size for k in node.inner])))
    _settle(order)
    return order


def _settle(order: list[Node]) -> None:
    """Marked elements become junk, unless they hold an article or most of its text.

    A mark is a hint: what lies around an article or main element is layout, and so are
    marked elements that together (all with the same marks) hold OWN_SHARE of the text
    outside links of their article, or of the page.
    """
    own = [0 if x.junk else x.own for x in order]
    holds = [x.tag in ("article", "main") and not x.junk for x in order]
    for x in reversed(order):                                # children have larger numbers
        for k in _kids(x):
            own[x.at] += own[k.at]
            holds[x.at] |= holds[k.at]
    scope, outer = [0] * len(order), [False] * len(order)    # the article around a node; is it in a marked one
    mass: dict = {}
    for x in order:
        if x.marks and not x.junk and not holds[x.at] and not outer[x.at]:
            key = (scope[x.at], x.marks)
            mass[key] = mass.get(key, 0) + own[x.at]
        for k in _kids(x):
            scope[k.at] = x.at if x.tag in ("article", "main") else scope[x.at]
            outer[k.at] = outer[x.at] or bool(x.marks) and not holds[x.at]
    for x in order:
        if x.marks and not x.junk and not holds[x.at]:
            most = mass.get((scope[x.at], x.marks), 0) >= OWN_SHARE * max(own[scope[x.at]], 1)
            x.junk = bool(x.marks & _READERS) or not most
        if x.junk:
            for k in _kids(x):
                k.junk = True


def _aligned(xs: list[Node], ys: list[Node], weight, pairs: bool):
    """The alignment of two lists in order with the greatest weight: its pairs, or its weight only.

    ``weight`` depends on the shapes of its two nodes alone, so it is asked once per pair of shapes with one tag, and a
    row of the table is a few numpy steps.  For the pairs, every so many rows one is kept and those between are
    made again, so memory grows with the square root of the table and no list is cut.
    """
    shapes: dict = {}
    code = np.array([shapes.setdefault(y.size, len(shapes)) for y in ys])
    first = {y.size: y for y in reversed(ys)}
    gains: dict = {}

    def gain(u: Node) -> np.ndarray:
        """Weight of ``u`` with every item of ``ys``; 0 where the tags differ."""
        if u.size not in gains:
            gains[u.size] = np.array([weight(u, first[z]) if first[z].tag == u.tag else 0 for z in shapes], np.int64)
        return gains[u.size][code]

    def after(row: np.ndarray, u: Node) -> np.ndarray:
        out = np.maximum(row[1:], row[:-1] + gain(u))
        return np.concatenate(([0], np.maximum.accumulate(out)))

    step = math.isqrt(len(xs)) + 1
    row, kept = np.zeros(len(ys) + 1, np.int64), []
    for i, u in enumerate(xs):
        if pairs and i % step == 0:
            kept.append(row)
        row = after(row, u)
    if not pairs:
        return int(row[-1])
    found, i, j = [], len(xs), len(ys)
    while i and j:
        lo = (i - 1) // step * step
        rows = [kept[lo // step]]
        for u in xs[lo:i]:
            rows.append(after(rows[-1], u))
        while i > lo and j:
            here = rows[i - lo][j]
            if here == rows[i - lo - 1][j]:
                i -= 1
            elif here == rows[i - lo][j - 1] or xs[i - 1].tag != ys[j - 1].tag:
                j -= 1
            else:
                i, j = i - 1, j - 1
                found.append((xs[i], ys[j]))
    return found


def match(ref: Node, page: Node) -> list[tuple[Node, Node]]:
    """Simple tree matching: pairs (reference node, page node) of a top-down alignment.

    Children align in order; equal shapes at both ends of two child lists align greedily.  Of what is
    between their ends, the alignment has the most pairs, however long the lists are.
    """
    memo: dict = {}

    def weigh(a: Node, b: Node) -> int:
        """Size of the best alignment of two nodes with one tag; explicit stack, memoized by shapes."""
        stack = [(a, b)]
        while stack:
            x, y = stack[-1]
            if (x.size, y.size) in memo:
                stack.pop()
                continue
            xs, ys = _kids(x), _kids(y)
            head, tail = _ends(xs, ys)
            mx, my = xs[head:len(xs) - tail], ys[head:len(ys) - tail]
            pairs = list(zip(xs[:head], ys[:head])) + (list(zip(xs[-tail:], ys[-tail:])) if tail else [])
            kinds_x, kinds_y = ({k.size: k for k in m}.values() for m in (mx, my))
            need = [(u, v) for u in kinds_x for v in kinds_y if u.tag == v.tag and (u.size, v.size) not in memo]
            need += [(u, v) for u, v in pairs if (u.size, v.size) not in memo]
            if need:
                stack += need
                continue
            stack.pop()
            total = 1 + sum(memo[u.size, v.size] for u, v in pairs)
            if mx and my:
                total += _aligned(mx, my, lambda u, v: memo[u.size, v.size], False)
            memo[x.size, y.size] = total
        return memo[a.size, b.size]

    out, todo = [], [(ref, page)]
    while todo:
        a, b = todo.pop()
        out.append((a, b))
        xs, ys = _kids(a), _kids(b)
        if not xs or not ys:
            continue
        head, tail = _ends(xs, ys)
        todo += zip(xs[:head], ys[:head])
        if tail:
            todo += zip(xs[-tail:], ys[-tail:])
        mx, my = xs[head:len(xs) - tail], ys[head:len(ys) - tail]
        if mx and my:
            todo += _aligned(mx, my, weigh, True)
    return out


def _kids(node: Node) -> list[Node]:
    return node.inner


def _ends(xs: list[Node], ys: list[Node]) -> tuple[int, int]:
    n, head, tail = min(len(xs), len(ys)), 0, 0
    while head < n and xs[head].size == ys[head].size:
        head += 1
    while tail < n - head and xs[-1 - tail].size == ys[-1 - tail].size:
        tail += 1
    return head, tail


def region(ref: list[Node], stats: dict) -> Node | None:
    """The deepest reference node with REGION_SHARE of the text that varies and isn't junk."""
    mass = {n.at: (stats[n.at][2] if n.at in stats and not n.junk else 0) for n in ref}
    parent = {}
    for n in ref:
        for k in _kids(n):
            parent[k.at] = n
    for n in reversed(ref):                                  # children have larger numbers
        if n.at in parent:
            mass[parent[n.at].at] += mass[n.at]
    total = mass[ref[0].at]
    if not total:
        return None
    node = ref[0]
    while True:
        deeper = [k for k in _kids(node) if mass[k.at] >= REGION_SHARE * total]
        if not deeper:
            break
        node = deeper[0]
    up = node
    while up is not None:                                    # an article is taken whole
        if up.tag in ("article", "main"):
            return up
        up = parent.get(up.at)
    return node


def main_text(order: list[Node], start: Node | None, template: set[int]) -> str:
    """Text blocks below ``start`` (or the page's article, main or body) that aren't template, joined by newlines."""
    marked = _outermost(order[0], "article") or _outermost(order[0], "main")
    if start is None or start.junk:
        roots = marked or [order[0]]
    else:
        roots = [start]
        if start.tag not in ("article", "main"):
            around = [m for m in marked if any(x is start for x in _below(m))]
            if around:
                roots = around                               # an article is taken whole
            elif sum(map(len, _lines(marked, template))) > sum(map(len, _lines(roots, template))):
                roots = marked                               # a page of another layout
    return "\n".join(_lines(roots, template))


def _lines(roots: list[Node], template: set[int]) -> list[str]:
    lines = []
    for root in roots:
        stack = [root]
        while stack:
            x = stack.pop()
            if isinstance(x, str):
                lines.append(x)
            elif not x.junk:
                keep = x.at not in template
                stack += [k for k in reversed(x.blocks) if keep or isinstance(k, Node)]
    return lines


def _below(node: Node):
    stack = [node]
    while stack:
        x = stack.pop()
        yield x
        stack += _kids(x)


def _outermost(top: Node, tag: str) -> list[Node]:
    out, stack = [], [top]
    while stack:
        x = stack.pop()
        if x.junk:
            continue
        if x.tag == tag:
            out.append(x)
        else:
            stack += reversed(_kids(x))
    return out


def texts_of(order: list[Node]) -> dict:
    """(is in an article, tag, own text) -> the nodes that have it, without boilerplate."""
    out: dict = {}
    for x in order:
        if not x.junk:
            if x.text:
                out.setdefault((x.inside, x.tag, x.text), []).append(x)
    return out


def _is_copy(ref: dict, page: dict) -> bool:
    """The pages' texts are nearly the same."""
    same = sum(len(k[2]) for k in page if k in ref)
    return same >= COPY_SHARE * max(sum(len(k[2]) for k in ref), sum(len(k[2]) for k in page), 1)


def constants(order: list[Node], table: dict) -> tuple[set, set]:
    """Numbers of the reference's template nodes, and the keys of texts found in nearly all articles."""
    nodes = {k for k, (n, same, _, _) in table.items() if k >= 0 and n >= TEMPLATE_PAGES and same >= TEMPLATE_SHARE * n
             and (not order[k].inside or n >= TEMPLATE_ALIGNED * table[0][0])}
    pages = table.get(-1, (0,))[0]                           # pages that count for articles
    texts = {k for k, xs in texts_of(order).items() if k[0] and pages >= TEMPLATE_PAGES
             and table.get(xs[0].at, (0, 0, 0, 0))[3] >= TEMPLATE_SHARE * pages}
    return nodes, texts


class _References:
    """Parsed reference pages of the hosts seen last."""

    def __init__(self, most: int = 64):
        self.most, self.held = most, OrderedDict()

    def get(self, host: str, source: str, stats=None):
        if host not in self.held:
            tree = parse(source)
            order = prepare(tree)
            found = template = None
            if stats is not None:
                table = {s["node"]: (s["n"], s["same"], s["chars"], s["has"]) for s in stats.as_py()}
                found = region(order, table)
                template = constants(order, table)
            self.held[host] = (tree, texts_of(order), found, template)
            if len(self.held) > self.most:
                self.held.popitem(last=False)
        self.held.move_to_end(host)
        return self.held[host]


def _align(batches):
    """mapInArrow: (host, html, ref) -> per task (host, node, n, same, chars, has); node -1 counts the pages
    that are evidence for articles."""
    refs, sums = _References(), {}
    for b in slices(batches):
        for host, source, ref in zip(*(b.column(k).to_pylist() for k in range(3))):
            tree, own, _, _ = refs.get(host, ref)
            page = parse(source)
            texts = texts_of(prepare(page))
            copy = source != ref and _is_copy(own, texts)
            mine = sums.setdefault(host, {})
            if not copy:
                mine.setdefault(-1, [0, 0, 0, 0])[0] += 1
                for k in texts:
                    if k[0] and k in own:
                        mine.setdefault(own[k][0].at, [0, 0, 0, 0])[3] += 1
            for x, y in match(tree, page):
                if copy and x.inside:
                    continue
                s = mine.setdefault(x.at, [0, 0, 0, 0])
                s[0] += 1
                if y.text == x.text:
                    s[1] += 1
                else:
                    s[2] += len(y.text)
        if sum(map(len, sums.values())) > 100_000:           # bounded memory
            yield _sums(sums)
            sums = {}
    yield _sums(sums)


def _sums(sums) -> pa.RecordBatch:
    rows = [(h, k, *v) for h, nodes in sums.items() for k, v in nodes.items()]
    types = (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)],
                                      names=["host", "node", "n", "same", "chars", "has"])


def _extract(batches):
    refs = _References()
    for b in slices(batches):
        texts = []
        stats = b.column(5)                                  # as long as the reference, so read once a host
        for i, (host, source, ref) in enumerate(zip(*(b.column(k).to_pylist() for k in range(2, 5)))):
            page = parse(source)
            order = prepare(page)
            start, template = None, set()
            if ref is not None and stats[i].is_valid and len(stats[i]):
                tree, _, found, constant = refs.get(host, ref, stats[i])
                pairs = match(tree, page)
                if found is not None:
                    start = next((y for x, y in pairs if x is found), None)
                nodes, known = constant
                template = {y.at for x, y in pairs if x.at in nodes and x.text == y.text}
                if known:
                    template |= {y.at for k, ys in texts_of(order).items() if k in known for y in ys}
            texts.append(main_text(order, start, template))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())],
                                         names=["page_id", "url", "text"])


def host_of(url):
    """Lower-case host of an address, '' if it has none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")),
                                    r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def wrappers(pages: DataFrame) -> DataFrame:
    """``pages(host, html)`` -> per host its reference page and the statistics of its nodes."""
    pages = pages.withColumn("key", F.md5("html"))
    each = cut(pages.groupBy("host", "key").agg(F.count(F.lit(1)).alias("m")), "digests")
    twice = cut(each.where("m > 1").select("host", "key"), "twice")
    if twice.limit(1).count():                               # equal pages count once
        one = pages.join(small(twice), ["host", "key"], "left_semi").groupBy("host", "key").agg(F.first("html").alias("html"))
        pages = (pages.join(small(twice), ["host", "key"], "left_anti").select("host", "key", "html")
                 .unionByName(one))
    first = cut(each.groupBy("host").agg(F.min("key").alias("digest")), "references")
    ref = (pages.join(small(first), "host").where(F.col("key") == F.col("digest"))
           .select("host", F.col("html").alias("ref")).dropDuplicates(["host"]))
    ref = cut(ref, "references")
    size = ref.agg(F.coalesce(F.sum(F.octet_length("ref") + 100), F.lit(0))).first()[0]
    near = F.broadcast(ref) if size <= REFERENCE_BYTES else ref
    sums = (pages.join(near, "host").select("host", "html", "ref")
            .mapInArrow(_align, "host string, node int, n long, same long, chars long, has long")
            .groupBy("host", "node").agg(*[F.sum(c).alias(c) for c in ("n", "same", "chars", "has")]))
    # as many rows per host as its reference page has blocks
    stats = sums.groupBy("host").agg(F.collect_list(F.struct("node", "n", "same", "chars", "has")).alias("stats"))
    return cut(ref.join(stats, "host"), "wrappers")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per page: id, url, text (main text, blocks joined by newlines), n_chars.

    A null page is empty and has the text ''.  Pages without an address share the host ''.
    A host with one page, or with equal pages only, has no slots: its pages give their own
    article, main or body without boilerplate.  Repeated rows are returned as they come;
    an empty table gives an empty one; other columns are ignored.
    """
    ready(pages.sparkSession)
    p = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"),
                     F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    p = p.withColumn("host", host_of(F.col("url")))
    w = wrappers(p.select("host", "html"))
    size = w.agg(F.coalesce(F.sum(F.octet_length("ref") + 40 * F.size("stats") + 100), F.lit(0))).first()[0]
    near = F.broadcast(w) if size <= REFERENCE_BYTES else w
    t = p.schema["page_id"].dataType.simpleString()
    out = (p.join(near, "host", "left").select("page_id", "url", "host", "html", "ref", "stats")
           .mapInArrow(_extract, f"page_id {t}, url string, text string"))
    return out.select(F.col("page_id").alias(id_col), F.col("url").alias(url_col), "text",
                      F.char_length("text").cast("long").alias("n_chars"))
