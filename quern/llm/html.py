"""Operator 5: main text of HTML pages by minimum-cut labelling.

A page is cut into blocks of text at block-level tags; hidden elements are not shown and give no text, and an advert within a
line is a block of its own. A linear classifier gives each block, from how it looks (words, share of link text, sentence
ends, headings), the cost of calling it content or boilerplate: its capacity from the source or to the sink. Elements that say
what they hold (by tag, role, class or id) are nodes too, with capacities that grow with the blocks under them.
Smoothness edges join neighbours in page order, blocks under one parent, blocks with the nearest element that says something,
and such elements with the one around them. A maximum flow separates the two sides; the blocks on the source's side, in page
order, are the text. So a short line in an article stays and a long comment goes, because of what stands around them.

The classifier is fitted by logistic regression, drawn towards given weights, on a bounded sample of pages: blocks of
elements that leave no doubt teach it how content looks elsewhere. The sample is runs of consecutive ids, so that the reader
can skip other row groups; `sample` pages at most, `PER_PAGE` blocks of each. Every page is extracted, whole, in one narrow
pass without a shuffle; a page is handled alone, with a few edges a block.

Edge cases: a null, empty or text-free page gives an empty text; unclosed and stray tags close as browsers close them, nearly
enough for text; raw elements that never end hide the rest of the page; rows with a null id are extracted but teach nothing;
without enough blocks to learn from the given weights hold; equal rows are each extracted; an empty table gives no rows;
extra columns are left out of the result.
"""

from __future__ import annotations

import functools
import html
import math
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import emitted, rows

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|</?([a-zA-Z][^\s/>]*+)((?:[^>"'=]++|=\s*+(?:"[^"]*+"|'[^']*+')|[="'])*+)>""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))|([^\s=/"'>]+)""")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

#: What HTML's elements do.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript template iframe noframes xmp".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark math q rp rt ruby s samp small span strike strong sub sup svg time tt u var wbr".split())
OUTSIDE = frozenset("nav footer aside form dialog menu button select option datalist head address".split())
INSIDE = frozenset(("article", "main"))
BAD_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar".split())
GOOD_ROLES = frozenset(("main", "article"))
#: Words of class and id names that tell what an element is for.
ADVERTS = frozenset("ad ads adv advert adverts advertisement advertisements advertising adsense adsbygoogle sponsor sponsored promo promos promotion".split())
BAD_WORDS = ADVERTS | frozenset("banner banners breadcrumb breadcrumbs captcha comment comments commentlist cookie cookies consent copyright disclaimer disqus feedback footer form gdpr header hidden infobar legal login masthead menu menus modal nav navbar navigation newsletter notice notices notification overlay pager paging pagination paywall popup recommend recommended recommendations related replies reply respond search share sharing sidebar sidebars signin signup skip skyscraper social subscribe subscription tags tagcloud teaser teasers toolbar topbar tracking warning widget widgets".split())
BAD_ARTICLES = ADVERTS | frozenset("comment comments related replies reply teaser".split())
GOOD_WORDS = frozenset("article body content entry main post story text".split())
#: Words beside a bad one that don't change what a name says, and words that turn it.
BESIDE = GOOD_WORDS | frozenset("area articles aside bar block bottom box buttons card col column container floating form group inner item items left links list message mobile desktop global news outer page panel posts primary right row secondary section site slot small sticky stories text title top unit wrap wrapper".split())
NEGATIONS = frozenset("has hide layout no non show with without".split())


@dataclass(frozen=True)
class Weights:
    """The linear classifier of blocks, and the capacities and edges of the cut."""

    bias: float = -2.0
    words: float = 1.0  # of log(1 + words), up to `enough`
    links: float = -3.0  # of the share of characters in links
    sentence: float = 0.8  # ends as sentences do
    heading: float = 0.5
    rights: float = -3.0  # a rights mark
    enough: float = math.log1p(64)
    most: float = 2.5  # of a block's capacity: less than `hold`, so that an element without doubt decides
    hold: float = 3.0  # a block and the nearest element that says something
    within: float = 2.0  # such an element and the one around it, for each block under it
    sure: float = 8.0  # capacity of an element without doubt, for each block under it
    hint: float = 1.0  # of one that hints
    same_parent: float = 1.0  # neighbours in page order
    next_block: float = 0.5
    across: float = 0.1  # neighbours that different elements hold
    siblings: float = 0.5  # the next block under the same parent


#: The classifier's own weights, in the order of `looks`.
FITTED = ("bias", "words", "links", "sentence", "heading", "rights")


class Element:
    """An element that says something of what it holds: +1 or -1, surely or as a hint."""

    __slots__ = ("blocks", "says", "sure", "up")

    def __init__(self, up: int, says: float, sure: bool):
        self.up, self.says, self.sure, self.blocks = up, says, sure, 0


class Block:
    __slots__ = ("holder", "links", "parent", "parts", "tag")

    def __init__(self, tag: str, parent: int, holder: int):
        self.tag, self.parent, self.holder = tag, parent, holder
        self.parts: list[str] = []
        self.links = 0


class Open:
    """An open element: its number, the telling element around its text, and what goes on when it closes."""

    __slots__ = ("deep", "hidden", "holder", "inside", "number", "resumed", "tag", "within")

    def __init__(self, tag: str, number: int, holder: int, inside: bool, hidden: bool, within: bool = False, resumed: Block | None = None):
        self.tag, self.number, self.holder, self.inside, self.hidden, self.within, self.resumed = tag, number, holder, inside, hidden, within, resumed
        self.deep = 0  # elements of the same tag within one that stands in a line


@functools.lru_cache(maxsize=4096)
def _named(value: str, bad: frozenset, inside: bool) -> tuple[float, bool]:
    """What a class or id attribute says: (-1, sure) if a name consists of telling words, else hints added up."""
    hints = 0.0
    for name in value.split():
        tokens = [x.lower() for x in _NAME.findall(name)]
        if any(t in NEGATIONS for t in tokens):
            continue
        if any(t in bad and not (t == "header" and inside) for t in tokens):
            if all(t in bad or t in BESIDE or t.isdigit() for t in tokens):
                return -1.0, True
            hints -= 1
        elif any(t in GOOD_WORDS for t in tokens):
            hints += 1
    return max(-1.0, min(1.0, hints)), False


def _said(tag: str, attributes: str, inside: bool) -> tuple[float, bool, bool]:
    """(says, sure, hidden) of a block-level element."""
    says, sure = (-1.0, True) if tag in OUTSIDE or tag == "header" and not inside else (1.0, True) if tag in INSIDE else (0.0, False)
    if not attributes or attributes.isspace():
        return says, sure, False
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = (m[1] or m[5]).lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or name == "aria-hidden" and value.strip().lower() == "true" or name == "style" and re.search(r"(?i)display\s*:\s*none|visibility\s*:\s*hidden", value):
            return says, sure, True
        if sure and says < 0:
            continue
        if name == "role":
            role = value.strip().lower()
            says, sure = (-1.0, True) if role in BAD_ROLES else (1.0, True) if role in GOOD_ROLES else (says, sure)
        elif name == "itemprop" and value.strip() == "articleBody":
            says, sure = 1.0, True
        elif name in ("class", "id") and tag not in ("html", "body"):
            told, certain = _named(value, BAD_ARTICLES if tag in INSIDE else BAD_WORDS, inside)
            if certain:
                says, sure = told, True
            elif not sure:
                says = max(-1.0, min(1.0, says + told))
    return says, sure, False


def _in_line(attributes: str) -> tuple[bool, bool]:
    """(advert, hidden) of an element within a line."""
    advert = False
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = (m[1] or m[5]).lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or name == "aria-hidden" and value.strip().lower() == "true" or name == "style" and re.search(r"(?i)display\s*:\s*none|visibility\s*:\s*hidden", value):
            return False, True
        if name in ("class", "id", "role"):
            advert = advert or _named(value, ADVERTS, False) == (-1.0, True)
    return advert, False


_CLOSES_ITSELF = ("li", "dt", "dd", "option", "tr", "td", "th")
_TEXT_TAGS = frozenset("p li h1 h2 h3 h4 h5 h6 dt dd td th".split())


def parse(page: str) -> tuple[list[Block], list[Element]]:
    """The blocks of a page that hold shown text, in page order, and its telling elements; the first stands for the page."""
    found: list[Block] = []
    elements = [Element(-1, 0.0, False)]
    stack = [Open("", 0, 0, False, False)]
    block: Block | None = None
    number, link, at = 0, False, 0
    end = page.rfind(">") + 1

    def text(piece: str) -> None:
        nonlocal block
        top = stack[-1]
        if top.hidden:
            return
        if block is None:
            if not piece or piece.isspace():
                return
            # a paragraph's own element says little; what holds it counts as the parent
            holder = stack[-2] if len(stack) > 1 and top.tag in _TEXT_TAGS else top
            block = Block(top.tag, holder.number, top.holder)
            found.append(block)
        block.parts.append(piece)
        if link:
            block.links += len(piece)

    def telling(says: float, sure: bool, up: int) -> int:
        """The number of a new telling element; what a bad one holds stays bad, and nothing is said twice."""
        around = elements[up]
        if not says or around.sure and (around.says < 0 or not sure and says > 0):
            return up
        elements.append(Element(up, says, sure))
        return len(elements) - 1

    while at < end:
        m = _TOKEN.search(page, at, end)
        if m is None:
            break
        if m.start() > at:
            text(page[at : m.start()])
        at = m.end()
        if not m[1]:
            continue
        tag, top = m[1].lower(), stack[-1]
        if page[m.start() + 1] == "/":
            if tag == "a":
                link = False
            if top.within and top.tag == tag:
                if top.deep:
                    top.deep -= 1
                else:
                    block = top.resumed
                    stack.pop()
            elif tag == "br":
                text(" ")
            elif tag not in INLINE:
                block = None
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag == tag:
                        del stack[i:]
                        link = False
                        break
            continue
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(page, at)
            if close is None:
                return found, elements
            at = close.start()
            continue
        if tag in ("br", "wbr", "img"):
            if tag == "br" and block is not None:
                text(" ")
            continue
        if tag in INLINE:
            link = link or tag == "a"
            if top.within and top.tag == tag:
                top.deep += 1
            elif m[2] and not m[2].isspace():
                advert, hidden = _in_line(m[2])
                if advert or hidden:
                    holder = telling(-1.0, True, top.holder) if advert else top.holder
                    stack.append(Open(tag, top.number, holder, top.inside, top.hidden or hidden, True, block))
                    block = None
            continue
        block = None
        if tag in VOID:
            continue
        while len(stack) > 1 and (stack[-1].within or stack[-1].tag == "p" or stack[-1].tag == tag and tag in _CLOSES_ITSELF or stack[-1].tag in ("dt", "dd") and tag in ("dt", "dd")):
            stack.pop()
        number += 1
        top = stack[-1]
        says, sure, hidden = _said(tag, m[2], top.inside)
        stack.append(Open(tag, number, telling(says, sure, top.holder), top.inside or sure and says > 0, top.hidden or hidden))
    tail = page[end:] if at >= end else page[at:]
    cut_off = re.search(r"<[a-zA-Z/!?]", tail)  # a tag that never ends hides what follows
    text(tail[: cut_off.start()] if cut_off else tail)
    return found, elements


def bodies(page: str | None) -> tuple[list[tuple[Block, str, int]], list[Element]]:
    """Blocks with their text, character references decoded and white space folded, and the number of words."""
    found, elements = parse(page or "")
    kept = []
    for b in found:
        raw = "".join(b.parts)
        if ws := (html.unescape(raw) if "&" in raw else raw).split():
            kept.append((b, " ".join(ws), len(ws)))
    return kept, elements


def looks(b: Block, body: str, n: int, enough: float) -> tuple[float, ...]:
    """What the classifier sees of a block."""
    heading = len(b.tag) == 2 and b.tag[0] == "h" and b.tag[1].isdigit()
    rights = "©" in body or "all rights reserved" in body.lower()
    return 1.0, min(math.log1p(n), enough), min(1.0, b.links / max(1, len(body))), float(body[-1] in ".!?…\"'”»。！？"), float(heading), float(rights)


def graph(kept: list[tuple[Block, str, int]], elements: list[Element], w: Weights) -> tuple[list[float], list[tuple[int, int, float]]]:
    """Capacities (from the source if positive, to the sink if negative) and edges; blocks first, then elements."""
    n = len(kept)
    for e in elements:
        e.blocks = 0
    for b, _, _ in kept:
        elements[b.holder].blocks += 1
    for e in reversed(elements[1:]):  # an element's number is above that of the one around it
        elements[e.up].blocks += e.blocks
    own = [getattr(w, name) for name in FITTED]
    lean = [max(-w.most, min(w.most, sum(x * y for x, y in zip(own, looks(b, body, k, w.enough), strict=True)))) for b, body, k in kept]
    has_article = any(e.sure and e.says > 0 and e.blocks for e in elements)
    for i, e in enumerate(elements):
        page = i == 0 and has_article  # what stands outside the article of a page that has one
        lean.append((w.sure if e.sure or page else w.hint) * (-1.0 if page else e.says) * (e.blocks + 1))
    edges = [(n + i, n + e.up, w.within * (e.blocks + 1)) for i, e in enumerate(elements) if i and (e.up or has_article)]
    last: dict[int, int] = {}
    for i, (b, _, _) in enumerate(kept):
        if b.holder or has_article:
            edges.append((i, n + b.holder, w.hold))
        if i:
            before = kept[i - 1][0]
            edges.append((i - 1, i, w.across if before.holder != b.holder else w.same_parent if before.parent == b.parent else w.next_block))
        if (j := last.get(b.parent)) is not None and j != i - 1 and kept[j][0].holder == b.holder:
            edges.append((j, i, w.siblings))
        last[b.parent] = i
    return lean, edges


def cut(lean: list[float], edges: list[tuple[int, int, float]], eps: float = 1e-9) -> list[bool]:
    """Which nodes a minimum cut leaves with the source: blocking flows on level graphs, then who the source still reaches."""
    n = len(lean)
    source, sink = n, n + 1
    to: list[int] = []
    room: list[float] = []
    out: list[list[int]] = [[] for _ in range(n + 2)]

    def join(a: int, b: int, there: float, back: float) -> None:
        out[a].append(len(to))
        out[b].append(len(to) + 1)
        to.extend((b, a))
        room.extend((there, back))

    for i, x in enumerate(lean):
        if x > 0:
            join(source, i, x, 0.0)
        elif x < 0:
            join(i, sink, -x, 0.0)
    for a, b, x in edges:
        if a != b and x > 0:
            join(a, b, x, x)
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque((source,))
        while queue:
            u = queue.popleft()
            for e in out[u]:
                if room[e] > eps and level[to[e]] < 0:
                    level[to[e]] = level[u] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [x >= 0 for x in level[:n]]
        at, path, u = [0] * (n + 2), [], source
        while True:
            if u == sink:
                flow = min(room[e] for e in path)
                for e in path:
                    room[e] -= flow
                    room[e ^ 1] += flow
                full = next(k for k, e in enumerate(path) if room[e] <= eps)
                u = to[path[full] ^ 1]
                del path[full:]
                continue
            edges_of, k = out[u], at[u]
            while k < len(edges_of) and not (room[edges_of[k]] > eps and level[to[edges_of[k]]] == level[u] + 1):
                k += 1
            at[u] = k
            if k < len(edges_of):
                path.append(edges_of[k])
                u = to[edges_of[k]]
            elif path:
                u = to[path.pop() ^ 1]
                at[u] += 1
            else:
                break


def labelled(page: str | None, w: Weights) -> list[tuple[str, bool, bool]]:
    """(text, whether the cut calls it content, whether its own cost does) of each block of a page."""
    kept, elements = bodies(page)
    if not kept:
        return []
    lean, edges = graph(kept, elements, w)
    return [(body, side, own > 0) for (_, body, _), side, own in zip(kept, cut(lean, edges), lean, strict=False)]


def extract(page: str | None, w: Weights = Weights()) -> str:
    """The main text of a page."""
    return " ".join(body for body, content, _ in labelled(page, w) if content)


#: Pages that teach the classifier, in runs of so many consecutive ids; blocks of a page; blocks of a kind that suffice;
#: and the weight of the given weights, in blocks.
SAMPLE, RUN, PER_PAGE, SUFFICE, DRAWN = 1000, 50, 200, 50, 50.0


def taught(page: str | None, enough: float) -> list[tuple[float, ...]]:
    """What the classifier sees of blocks that surely are content (last number 1) or boilerplate (0), evenly over the page."""
    kept, elements = bodies(page)
    sure = [(b, body, n) for b, body, n in kept if elements[b.holder].sure]
    step = max(1, -(-len(sure) // PER_PAGE))
    return [(*looks(b, body, n, enough), float(elements[b.holder].says > 0)) for b, body, n in sure[::step]]


def fit(pages: DataFrame, key: str = "page_id", page: str = "html", sample: int = SAMPLE, w: Weights = Weights()) -> Weights:
    """The weights, with those of the classifier fitted on runs of ids whose beginnings a hash of the id chooses."""
    ids = pages.select(F.col(key).cast("long").alias("key")).where("key is not null")
    starts = [r.key for r in ids.orderBy(F.xxhash64("key"), "key").limit(max(1, sample // RUN)).collect()]  # a few numbers
    if not starts:
        return w
    chosen = functools.reduce(lambda a, b: a | b, (F.col(key).between(s, s + RUN - 1) for s in starts))
    out = pa.schema([("key", pa.int64()), ("seen", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return emitted(((k, list(x)) for k, h in rows(batches, "key", "html") for x in taught(h, w.enough)), out)

    some = pages.where(chosen).select(F.col(key).cast("long").alias("key"), F.col(page).alias("html")).mapInArrow(run, "key long, seen array<double>")
    table = some.orderBy("key", "seen").limit(sample * PER_PAGE).select("seen").toArrow()  # bounded, however many rows share an id
    seen = np.array(table.column(0).to_pylist(), dtype=np.float64).reshape(-1, len(FITTED) + 1)
    return fitted(seen[:, :-1], seen[:, -1], w)


def fitted(x: np.ndarray, y: np.ndarray, w: Weights, rounds: int = 20) -> Weights:
    """Logistic regression by Newton's rule, both kinds with equal weight, drawn towards the given weights."""
    good = y.sum()
    if good < SUFFICE or len(y) - good < SUFFICE:
        return w
    given = np.array([getattr(w, name) for name in FITTED])
    each = np.where(y > 0, 0.5 / good, 0.5 / (len(y) - good)) * len(y)
    own = given.copy()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ own, -30, 30)))
        slope = x.T @ (each * (p - y)) + DRAWN * (own - given)
        own = own - np.linalg.solve((x * (each * p * (1 - p))[:, None]).T @ x + DRAWN * np.eye(len(own)), slope)
    return replace(w, **dict(zip(FITTED, map(float, own), strict=True)))


def extract_pages(pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html", weights: Weights | None = None) -> DataFrame:
    """key, url, text of every page; without given weights the classifier is fitted on a sample of the pages."""
    out = pa.schema([("key", pa.int64()), ("url", pa.string()), ("text", pa.string())])
    w = fit(pages, key, page) if weights is None else weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return emitted(((k, u, extract(h, w)) for k, u, h in rows(batches, "key", "url", "html")), out, weight=lambda r: len(r[2]))

    chosen = pages.select(F.col(key).cast("long").alias("key"), F.col(url).alias("url"), F.col(page).alias("html"))
    return chosen.mapInArrow(run, "key long, url string, text string").withColumnsRenamed({"key": key, "url": url})
