"""Acts in either of two markup dialects, as section rows in reading order.

A page becomes a small tree, the tree a stream of marks (a heading, a title, a paragraph's number, a line, a table, an end),
and one fold over the marks makes sections. So a page whose articles lie in containers and one that is flat take one path.
Text outside articles and annexes, such as recitals, is left out. A document that can't be read has an error and no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
FORMULA = "[formula]"

#: The dialects' classes, and how headings are numbered.
PUBLISHED = {"sign": "oj-normal", "article": "oj-ti-art", "annex": "oj-doc-ti", "table": "oj-table"}
CONSOLIDATED = {"sign": "norm", "article": "title-article-norm", "annex": "title-annex-1", "table": "borderOj"}
DROPPED = frozenset(("oj-note", "oj-note-tag", "footnote", "footnotes", "modref", "arrow", "script", "style"))
ARTICLE_NUMBER = re.compile(r"Article\s+(\d+(?!st\b|nd\b|rd\b|th\b)[a-z]{0,2}\b)", re.I)
ANNEX_NUMBER = re.compile(r"ANNEX\s+([IVXLC]+|\d+)", re.I)
LEADING_NUMBER = re.compile(r"(\d+(?:-?[a-z]+)?)\.\s*")
SUBHEADING = re.compile(r"title-gr-seq-level-(\d+)")
PARAGRAPH_ID = re.compile(r"\d+\.\d+")
_MARKS = re.compile(r"[▼►]\s*[A-Z]+\d*|◄")
_EMPTY = re.compile(r"\s*\(\s*\)")


class MarkupError(ValueError):
    """A document that can't be read as an act."""


def clean(text: str) -> str:
    return " ".join(_EMPTY.sub("", _MARKS.sub(" ", text)).split())


class Node:
    __slots__ = ("attributes", "children", "classes", "tag")

    def __init__(self, tag: str, attributes: dict[str, str]):
        self.tag, self.attributes, self.children = tag, attributes, []
        self.classes = frozenset((attributes.get("class") or "").split())

    def walk(self) -> Iterator[Node]:
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack += [c for c in reversed(node.children) if isinstance(c, Node)]

    def text(self) -> str:
        out, stack = [], [self]
        while stack:
            x = stack.pop()
            if isinstance(x, str):
                out.append(x)
            else:
                stack += reversed(x.children)
        return "".join(out)


class _Tree(HTMLParser):
    def __init__(self, formulas: list[str] | None):
        super().__init__(convert_charrefs=True)
        self.stack = [Node("", {})]
        self.formulas, self.images = formulas, 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        node = Node(tag, {k: v or "" for k, v in attrs})
        if tag == "img" and node.attributes.get("src", "").startswith("data:"):
            known = self.formulas
            self.stack[-1].children.append(FORMULA if known is None else known[self.images] if self.images < len(known) else FORMULA)
            self.images += 1
            return
        if tag == "p" and self.stack[-1].tag == "p":
            self.stack.pop()
        self.stack[-1].children.append(node)
        if tag not in VOID:
            self.stack.append(node)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag != "img":
            self.stack.pop()

    def handle_endtag(self, tag: str) -> None:
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag == tag:
                del self.stack[i:]
                return

    def handle_data(self, data: str) -> None:
        if self.stack[-1].tag not in ("script", "style"):
            self.stack[-1].children.append(data)


def parse_tree(html: str, formulas: list[str] | None = None) -> Node:
    tree = _Tree(formulas)
    tree.feed(html)
    tree.close()
    if formulas is not None and tree.images != len(formulas):
        raise MarkupError(f"{len(formulas)} formulas for {tree.images} images")
    return tree.stack[0]


def dialect(root: Node) -> dict[str, str]:
    """The dialect whose sign stands in the page; the published one is looked for first."""
    for d in (PUBLISHED, CONSOLIDATED):
        if any(d["sign"] in n.classes for n in root.walk()):
            return d
    raise MarkupError("no known dialect")


def _rows(table: Node) -> list[list[str]]:
    rows = []
    for tr in table.walk():
        if tr.tag == "tr" and (cells := [clean(c.text()) for c in tr.walk() if c.tag in ("td", "th")]):
            rows.append(cells)
    return rows


def _equation(rows: list[list[str]]) -> str | None:
    """The formula of a table that is one row with one formula and nothing but marks around it."""
    filled = [c for c in rows[0] if c] if len(rows) == 1 else []
    formulas = [c for c in filled if c.startswith("$$") and c.endswith("$$")]
    rest = [c for c in filled if c not in formulas]
    return formulas[0] if len(formulas) == 1 and all(re.fullmatch(r"\(?\w{0,4}\)?[.,;:]?", c) for c in rest) else None


def _marks(root: Node, d: dict[str, str]) -> Iterator[tuple[str, Any]]:
    """The page as marks in reading order."""
    published = d is PUBLISHED
    todo: list[Node | tuple[str, Any]] = [root]
    annex_labels = 0
    while todo:
        n = todo.pop()
        if isinstance(n, tuple):
            yield n
            continue
        if n.classes & DROPPED or n.tag in DROPPED:
            continue
        id_ = n.attributes.get("id", "")
        inside = [c for c in reversed(n.children) if isinstance(c, Node)]
        if published and n.tag == "div" and id_.startswith(("art_", "anx_")):
            annex_labels = 0
            if id_.startswith("anx_"):
                yield "annex", ""
            todo += [("end", None), *inside]
        elif d["article"] in n.classes:
            yield "article", clean(n.text())
        elif "stitle-article-norm" in n.classes or published and "eli-title" in n.classes:
            yield "title", clean(n.text())
        elif d["annex"] in n.classes:
            annex_labels += 1
            yield ("annex" if not published else "annex_label" if annex_labels == 1 else "title"), clean(n.text())
        elif n.tag == "p" and (m := next((m for c in n.classes if (m := SUBHEADING.fullmatch(c))), None)):
            yield "subheading", (int(m[1]), clean(n.text()))
        elif n.tag == "hr" and n.classes & {"separator-annex", "separator-short"}:
            yield "end", None
        elif n.tag == "table" and d["table"] in n.classes:
            if rows := _rows(n):
                formula = _equation(rows)
                yield ("block", formula) if formula else ("table", rows)
        elif n.tag == "tr":
            yield "line", clean(" ".join(clean(c.text()) for c in n.walk() if c.tag in ("td", "th")))
        elif published and n.tag == "div" and PARAGRAPH_ID.fullmatch(id_):
            yield "paragraph", None
            todo += inside
        elif not published and "norm" in n.classes and n.tag == "div" and any(isinstance(c, Node) and "no-parag" in c.classes for c in n.children):
            number = next(c for c in n.children if isinstance(c, Node) and "no-parag" in c.classes)
            m = LEADING_NUMBER.match(clean(number.text()))
            yield "paragraph", m[1] if m else ""
            rest = [c for c in n.children if isinstance(c, Node) and c is not number]
            todo += reversed(rest)
        elif "grid-container" in n.classes:
            yield "line", clean(" ".join(clean(c.text()) for c in inside[::-1]))
        elif n.tag in ("p", "td") or not inside and clean(n.text()):
            yield "line", clean(n.text())
        else:
            todo += inside


class _Sections:
    """Section rows in the making."""

    def __init__(self):
        self.rows: list[dict[str, Any]] = []
        self.open: list[tuple[int, int]] = []  # level and row of the division and the sub-headings in it
        self.lines: list[str] = []
        self.number: str | None = None

    def add(self, kind: str, parent: int | None, **fields: Any) -> int:
        depth = 0 if parent is None else self.rows[parent]["depth"] + 1
        at = len(self.rows)
        self.rows.append({"node_id": at, "parent_id": parent, "depth": depth, "seq": at, "kind": kind, "number": None, "title": None, "text": "", "rows": [], **fields})
        return at

    def flush(self) -> None:
        if self.open and (self.lines or self.number):
            text, number = "\n".join(x for x in self.lines if x), self.number
            if number is None and self.rows[self.open[0][1]]["kind"] == "article" and (m := LEADING_NUMBER.match(text)):
                number, text = m[1], text[m.end() :]
            if text or number:
                self.add("paragraph", self.open[-1][1], number=number or None, text=text)
        self.lines, self.number = [], None

    def division(self, kind: str, number: str | None) -> None:
        self.flush()
        self.open = [(0, self.add(kind, None, number=number))]


def sections(html: str, formulas: list[str] | None = None) -> list[dict[str, Any]]:
    """The rows of an act's articles and annexes; raises if it has no article."""
    root = parse_tree(html, formulas)
    d = dialect(root)
    made = _Sections()
    for kind, value in _marks(root, d):
        fresh = bool(made.open) and not made.lines and len(made.open) == 1 and made.open[0][1] == len(made.rows) - 1
        if kind == "article":
            m = ARTICLE_NUMBER.search(value)
            made.division("article", m[1] if m else None)
        elif kind == "annex":
            m = ANNEX_NUMBER.search(value)
            made.division("annex", m[1] if m else "")
        elif kind == "annex_label" and made.open:
            m = ANNEX_NUMBER.search(value)
            made.rows[made.open[0][1]]["number"] = m[1] if m else ""
        elif kind == "end":
            made.flush()
            made.open = []
        elif not made.open:
            continue
        elif kind == "title" or kind == "subheading" and fresh and made.rows[made.open[0][1]]["kind"] == "annex" and value[0] == 1:
            if made.rows[made.open[0][1]]["title"] is None:
                made.rows[made.open[0][1]]["title"] = (value if kind == "title" else value[1]) or None
        elif kind == "subheading":
            made.flush()
            while len(made.open) > 1 and made.open[-1][0] >= value[0]:
                made.open.pop()
            made.open.append((value[0], made.add("heading", made.open[-1][1], title=value[1])))
        elif kind == "paragraph":
            made.flush()
            made.number = value
        elif kind == "table":
            made.flush()
            made.add("table", made.open[-1][1], rows=value)
        elif kind == "block":
            made.flush()
            made.add("paragraph", made.open[-1][1], text=value)
        elif value:
            made.lines.append(value)
    made.flush()
    if not any(r["kind"] == "article" for r in made.rows):
        raise MarkupError("no articles")
    return made.rows


_ROW = "doc_id long, node_id int, parent_id int, depth int, seq int, kind string, number string, title string, text string, rows array<array<string>>, error string"


def parse_documents(documents: DataFrame, key: str = "doc_id", html: str = "html") -> DataFrame:
    """Section rows of every document; one that can't be read gives a row with its error."""
    names = ["node_id", "parent_id", "depth", "seq", "kind", "number", "title", "text", "rows"]
    types = [pa.int32()] * 4 + [pa.string()] * 4 + [pa.list_(pa.list_(pa.string()))]
    out = pa.schema([("doc_id", pa.int64()), *zip(names, types, strict=True), ("error", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, page in zip(batch.column(0), batch.column(1), strict=True):
                try:
                    found = [{"doc_id": k.as_py(), **r, "error": None} for r in sections(page.as_py() or "")]
                except MarkupError as x:
                    found = [{"doc_id": k.as_py(), **dict.fromkeys(names), "error": str(x)}]
                yield pa.RecordBatch.from_pylist(found, schema=out)

    return documents.select(F.col(key).cast("long").alias("doc_id"), F.col(html).alias("html")).mapInArrow(run, _ROW)
