"""HTML extraction by minimum cut.

A page is split into text blocks at block-level tags. The nodes of the graph are these
blocks and the elements whose tag, class, id or role says something ("evidence").

Terminals: a block's capacity is the log odds that a logistic classifier gives to its own
text and tag (length, link share, punctuation, tag, the like of its parent), fitted on the
labelled pages of html_fixtures; it knows nothing of the containers. An element's capacity
is its evidence. What the operator's contract excludes by name (menus, footers, sidebars,
adverts, notices, forms, comments, hidden parts) has infinite capacity to the sink.
Edges, in the same unit: neighbours in page order, the stronger the nearer they are in the
DOM; neighbours under one grandparent; a block or element and the nearest element with
evidence above it. The blocks on the source's side of the minimum cut are the article. So
a one-word paragraph, boilerplate by itself, is kept between the paragraphs of an article,
and a long advert is dropped with the sidebar around it.

Nodes whose capacity exceeds all their edges are on one side of every minimum cut; they
are settled first, their edges move into their neighbours' capacities, and only what is
left goes through the maximum flow.

A name is outbid by the page's text itself: an element called a sidebar or a form that holds
the page's first article, main or h1 (a theme's wrapper) is not excluded for its name, and what
else lies in it is judged by its own names and by the cut.

A class or id is read as a compound of which the last word says what it is: post-comments
are comments, a legal-analysis is an analysis. Before words for any container (comment-list,
footer-inner) the word before decides.

Decoding: scripts, styles, templates, titles, comments and markup go; character
references are decoded once; white space inside a block becomes one space; blocks are
joined in page order by one space. Nothing is capped.

Defined cases: a null, empty or blank page has the empty text; unclosed tags end with
their parents, unclosed comments and raw elements at the page's end; a "<" that starts no
tag is text; equal capacities go to the sink; repeated rows are extracted each; other
input columns pass by their keys, those that clash with a result's name by theirs alone.
"""

from __future__ import annotations

import html
import re
from collections import deque
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scriptoria.llm import html_fixtures

_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|title|noscript|template|textarea|iframe|svg|select)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<[!?/][^>]*>",
    re.S | re.I,
)
_NAMES = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_MAY_HIDE = re.compile(r"hidden|display", re.I)
_NO_DISPLAY = re.compile(r"(?:^|;)\s*display\s*:\s*none\b", re.I)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")

# HTML's void and inline elements; all others are blocks.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var wbr br img ruby rt rp label object "
    "math mrow mi mo mn ms mtext mspace msup msub msubsup mfrac msqrt mroot mover munder munderover mtable mtr mtd mstyle mpadded mphantom menclose merror mmultiscripts mprescripts none semantics annotation annotation-xml".split()
)
#: Elements that are boilerplate or content by their tag.
BOILER_TAGS = frozenset("nav footer aside menu dialog button fieldset".split())
CONTENT_TAGS = frozenset("article main".split())
#: Words for boilerplate, as the head of a name.
BOILER_HEADS = frozenset(
    "ad ads adsense advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal nav navbar navigation menu breadcrumb breadcrumbs "
    "footer masthead sidebar comment comments respond reply replies disqus share sharing social related recommended newsletter subscribe subscription signup login search widget pager pagination copyright legal disclaimer "
    "complementary contentinfo toolbar skip".split()
)
#: Those of them that also decide before a word for any container.
BOILER_FIRST = frozenset("ad ads advert advertisement sponsor sponsored promo banner cookie cookies nav navbar navigation menu breadcrumb breadcrumbs footer masthead sidebar comment comments disqus share social related newsletter popup modal widget".split())
CONTAINERS = frozenset("content body text list area wrap wrapper container inner outer section box block item items link links bar title main slot zone panel form holder group region row col column left right top bottom header unit thread button buttons".split())
CONTENT_WORDS = frozenset("article content post entry story main prose".split())
#: Names that begin with these speak of a page's state.
STATES = frozenset("no not with without has is hide show".split())
SITE_WORDS = frozenset("site page top global".split())
#: Capacities in tenths of log odds, in the unit of the classifier.
HARD = 1 << 30
EVIDENCE, HEADER, MOST = 80, -60, 60
NEAR, ASIDE, UNDER, OVER = 60, 8, 90, 40


def _hides(rest: str) -> bool:
    """Whether a tag's attributes hide it: hidden, aria-hidden=true or a style of display: none."""
    if not _MAY_HIDE.search(rest):
        return False
    for m in _ATTRIBUTE.finditer(rest):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or (name == "aria-hidden" and value.strip().lower() == "true") or (name == "style" and _NO_DISPLAY.search(value)):
            return True
    return False


def _says(name: str) -> int:
    """What one class, id or role says: HARD below 0, EVIDENCE, HEADER or 0."""
    parts = [p.lower() for p in _PARTS.findall(name)]
    parts = [p for p in parts if len(p) > 1]
    if not parts or parts[0] in STATES:
        return 0
    head, before = parts[-1], parts[:-1]
    if head in BOILER_HEADS or (head in CONTAINERS and not BOILER_FIRST.isdisjoint(before)):
        return -HARD
    if head in ("header", "head") and not SITE_WORDS.isdisjoint(before):
        return -HARD
    if head in CONTENT_WORDS or (head in CONTAINERS and not CONTENT_WORDS.isdisjoint(before)):
        return EVIDENCE
    return 0


class _Element:
    __slots__ = ("depth", "evidence", "hard", "links", "named", "near", "node", "out", "parent", "seen", "tag", "title", "words")

    def __init__(self, tag: str, parent: _Element | None, rest: str):
        self.tag, self.parent = tag, parent
        self.depth = parent.depth + 1 if parent else 0
        self.words = self.links = 0  # of the blocks right under it
        self.node, self.evidence, self.hard, self.named, self.title = -1, 0, False, False, False
        self.out: bool | None = None  # whether the contract excludes it, once asked
        self.seen: set[str] = parent.seen if parent else set()  # of the page
        self.near = parent.near if parent else None  # the nearest with evidence, itself included
        if tag in ("html", "body", "head"):
            return
        said = [0]
        if rest and "=" in rest:
            said += [_says(name) for m in _NAMES.finditer(rest) for name in (m[2] or m[3] or m[4] or "").split()]
        if tag in ("h1", "article", "main") and tag not in self.seen and min(said) == 0:
            self.seen.add(tag)  # the page's first: what holds it holds the page's text
            e = parent
            while e is not None and not e.title:
                e.title = True
                e = e.parent
        if tag in BOILER_TAGS or (rest and _hides(rest)):
            self.hard = True
        elif min(said) < 0:
            self.named = True
        elif tag in CONTENT_TAGS or max(said) > 0:
            self.evidence, self.near = EVIDENCE, self
        elif tag == "header" and self.near is None:
            self.evidence, self.near = HEADER, self

    def excluded(self) -> bool:
        """Whether the contract excludes it, by what it or an element around it is: a form or
        a name doesn't count where the page's first article, main or h1 lies below it."""
        path, e = [], self
        while e is not None and e.out is None:
            path.append(e)
            e = e.parent
        out = e is not None and e.out
        for e in reversed(path):
            out = e.out = out or e.hard or ((e.named or e.tag == "form") and not e.title)
        return out


def blocks_of(page: str) -> list[tuple[str, _Element, float]]:
    """(text, parent element, share of characters inside links) of each text block."""
    found: list[tuple[str, _Element, float]] = []
    at = _Element("html", None, "")
    parts: list[str] = []
    owner, linked, in_link = at, 0, 0

    def flush() -> None:
        nonlocal parts, linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                found.append((text, owner, min(1.0, linked / len(text))))
            parts, linked = [], 0

    def say(text: str) -> None:
        nonlocal owner, linked
        if not parts:
            owner = at
            while owner.tag in INLINE and owner.parent:
                owner = owner.parent
        parts.append(text)
        if in_link:
            linked += len(text)

    end = 0
    for m in _MARKUP.finditer(page):
        if m.start() > end:
            say(page[end : m.start()])
        end = m.end()
        tag = m["tag"]
        if tag is None:
            if m["raw"]:
                flush()
            continue
        tag = tag.lower()
        inline = tag in INLINE
        if not inline:
            flush()
        if m["close"]:
            e = at
            while e is not None and e.tag != tag:
                if inline and e.tag not in INLINE:
                    e = None  # an inline tag closes nothing beyond its block
                    break
                e = e.parent
            if e is not None and e.parent is not None:
                at = e.parent
                in_link = _links(at)
            continue
        if tag in VOID:
            if tag == "br" and parts:
                say(" ")
            continue
        if not inline:
            e = at
            while e.tag in INLINE and e.parent:
                e = e.parent
            if e.tag == "p" or (e.tag == tag and tag in ("li", "dt", "dd", "tr", "td", "th", "option")):
                at = e.parent
            in_link = _links(at)
        at = _Element(tag, at, m["rest"])
        in_link += tag == "a"
    if end < len(page):
        say(page[end:])
    flush()
    return found


def _links(e: _Element | None) -> int:
    n = 0
    while e is not None and e.tag in INLINE:
        n += e.tag == "a"
        e = e.parent
    return n + (e is not None and e.parent is not None and e.parent.tag == "a")


_TAGS = {"p": 0, "h1": 1, "h2": 2, "h3": 2, "h4": 2, "h5": 2, "h6": 2, "li": 3, "dd": 3, "dt": 3, "td": 4, "th": 4, "blockquote": 5, "pre": 5}
_SIGNS = re.compile(r"[©|»«·›→•]")
_ENDS = frozenset(".?!:;\"”…")
_ONE_HOT = [tuple(float(k == t) for k in range(7)) for t in range(7)]
N_FEATURES = 18


def features(blocks: list[tuple[str, _Element, float]]) -> np.ndarray:
    """(blocks, N_FEATURES): what a block's own text, its tag and its parent's text are like."""
    words = [text.count(" ") + 1 for text, _, _ in blocks]
    for (_, parent, linked), n in zip(blocks, words, strict=True):
        parent.words += n
        parent.links += n * linked
    rows = [
        (1.0, n, n >= 10, n >= 25, linked, linked > 0.5, text[-1] in _ENDS, (text.count(",") + text.count(". ")) / n, _SIGNS.search(text) is not None, *_ONE_HOT[_TAGS.get(parent.tag, 6)], parent.words, parent.links / parent.words)
        for (text, parent, linked), n in zip(blocks, words, strict=True)
    ]
    x = np.array(rows, dtype=np.float64)
    x[:, 1] = np.minimum(5.0, np.log(x[:, 1]))
    x[:, 7] = np.minimum(3.0, 10.0 * x[:, 7])
    x[:, 16] = np.minimum(6.0, np.log(x[:, 16]))
    return x


@cache
def weights() -> tuple[float, ...]:
    """The classifier: logistic regression on the fixture pages by Newton's steps, with a
    small ridge, on the blocks that the contract doesn't exclude. It takes a second and gives the same weights everywhere."""
    xs, ys = [], []
    for page in html_fixtures.pages():
        blocks = blocks_of(page)
        open_ = [not parent.excluded() for _, parent, _ in blocks]
        xs.append(features(blocks)[open_])
        ys += [html_fixtures.is_content(b[0]) for b, o in zip(blocks, open_, strict=True) if o]
    x, y, w = np.concatenate(xs), np.array(ys, dtype=np.float64), np.zeros(N_FEATURES)
    for _ in range(12):
        p = 1 / (1 + np.exp(-x @ w))
        w += np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.eye(N_FEATURES), x.T @ (y - p) - w)
    return tuple(w.tolist())


def scores(blocks: list[tuple[str, _Element, float]], fitted: tuple[float, ...] | None = None) -> list[int]:
    """The classifier's log odds for content in tenths, at most MOST either way."""
    if not blocks:
        return []
    odds = np.clip(np.rint(10 * (features(blocks) @ np.array(fitted or weights()))), -MOST, MOST)
    return odds.astype(np.int64).tolist()


def distance(a: _Element, b: _Element) -> int:
    """Steps between two elements in the DOM tree."""
    n = 0
    while a is not b:
        n += 1
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
    return n


def settle(capacity: list[int], edges: list[tuple[int, ...]]) -> list[bool | None]:
    """The side of each node that the capacities settle, None for the others, whose
    capacities are changed to what the settled neighbours' edges add."""
    n = len(capacity)
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(n)]
    spend = [[0, 0] for _ in range(n)]  # what a node may pay on the source's side, on the sink's
    for a, b, there, *back in edges:
        back = back[0] if back else there
        out[a].append((b, there, back))
        out[b].append((a, back, there))
        spend[a][0] += there
        spend[a][1] += back
        spend[b][0] += back
        spend[b][1] += there
    side: list[bool | None] = [None] * n
    queue = deque(range(n))
    while queue:
        v = queue.popleft()
        if side[v] is not None:
            continue
        if capacity[v] > 0 and capacity[v] >= spend[v][0]:
            side[v] = True
        elif capacity[v] <= 0 and -capacity[v] >= spend[v][1]:
            side[v] = False
        else:
            continue
        for u, there, back in out[v]:
            if side[u] is None:
                capacity[u] += there if side[v] else -back
                spend[u][0] -= back
                spend[u][1] -= there
                queue.append(u)
    return side


def source_side(scores: list[int], edges: list[tuple[int, ...]]) -> list[bool]:
    """Whether each node is on the source's side of the minimum cut. An edge (a, b, there,
    back) costs `there` if a is on the source's side and b is not, and `back` (if not given,
    as much) the other way round."""
    capacity = list(scores)
    side = settle(capacity, edges)
    left = [v for v, s in enumerate(side) if s is None]
    if left:
        at = {v: k for k, v in enumerate(left)}
        inner = [(at[e[0]], at[e[1]], *e[2:]) for e in edges if e[0] in at and e[1] in at]
        for v, s in zip(left, _maximum_flow([capacity[v] for v in left], inner), strict=True):
            side[v] = s
    return [bool(s) for s in side]


def _maximum_flow(scores: list[int], edges: list[tuple[int, ...]]) -> list[bool]:
    """The source's side by blocking flows over the level graph."""
    n = len(scores)
    source, sink = n, n + 1
    to: list[int] = []
    room: list[int] = []
    out: list[list[int]] = [[] for _ in range(n + 2)]

    def add(a: int, b: int, there: int, back: int) -> None:
        out[a].append(len(to))
        out[b].append(len(to) + 1)
        to.extend((b, a))
        room.extend((there, back))

    for v, s in enumerate(scores):
        if s > 0:
            add(source, v, s, 0)
        elif s < 0:
            add(v, sink, -s, 0)
    for a, b, there, *back in edges:
        add(a, b, there, back[0] if back else there)
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            v = queue.popleft()
            for e in out[v]:
                if room[e] and level[to[e]] < 0:
                    level[to[e]] = level[v] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [x >= 0 for x in level[:n]]
        turn = [0] * (n + 2)
        path: list[int] = []
        v = source
        while True:
            if v == sink:
                flow = min(room[e] for e in path)
                for e in path:
                    room[e] -= flow
                    room[e ^ 1] += flow
                k = next(k for k, e in enumerate(path) if not room[e])
                v = to[path[k] ^ 1]
                del path[k:]
                continue
            while turn[v] < len(out[v]):
                e = out[v][turn[v]]
                if room[e] and level[to[e]] == level[v] + 1:
                    break
                turn[v] += 1
            if turn[v] < len(out[v]):
                path.append(out[v][turn[v]])
                v = to[path[-1]]
            elif v == source:
                break
            else:
                level[v] = -1
                v = to[path.pop() ^ 1]


def graph(blocks: list[tuple[str, _Element, float]], fitted: tuple[float, ...] | None = None) -> tuple[list[int], list[tuple[int, ...]]]:
    """Capacities and edges: the blocks first, then the elements with evidence."""
    capacity = scores(blocks, fitted)
    edges: list[tuple[int, ...]] = []
    last_under: dict[int, int] = {}
    parents = [parent for _, parent, _ in blocks]
    for v, p in enumerate(parents):
        if p.excluded():
            capacity[v] = -HARD
        else:
            below, e = v, p.near
            while e is not None:
                new = e.node < 0
                if new:
                    e.node = len(capacity)
                    capacity.append(e.evidence)
                edges.append((e.node, below, UNDER, OVER))
                below, e = e.node, e.parent.near if new and e.parent else None
        if v:
            edges.append((v - 1, v, max(1, NEAR // (1 + distance(parents[v - 1], p)))))
        above = id(p.parent or p)
        if above in last_under and last_under[above] != v - 1:
            edges.append((last_under[above], v, ASIDE))
        last_under[above] = v
    return capacity, edges


def main_text(page: str | None, fitted: tuple[float, ...] | None = None) -> str:
    blocks = blocks_of(page or "")
    kept = source_side(*graph(blocks, fitted))
    return " ".join(b[0] for b, k in zip(blocks, kept, strict=False) if k)


def extract(pages: DataFrame, key_cols: list[str], html_col: str = "html") -> DataFrame:
    """Key columns, text and n_chars (code points) of every page."""
    schema = T.StructType([pages.schema[k] for k in key_cols] + [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    n, fitted = len(key_cols), weights()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py(), fitted) for x in batch.column(n)]
            columns = [*batch.columns[:n], pa.array(texts, type=pa.string()), pa.array([len(t) for t in texts], type=pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in schema.fields])

    return pages.select(*[F.col(f"`{k}`") for k in key_cols], F.col(f"`{html_col}`")).mapInArrow(run, schema)
