"""Cross-references in legal text, per text in plain Python; `references` runs it in Arrow batches.

A text is cut into tokens by one pattern, and a reader with one open list of divisions (articles or annexes, which share what
qualifies them) takes them in order: a division belongs to the act that only a link parts from its list.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

FIELDS = ("raw", "instrument", "article", "paragraph", "point", "annex")

#: How citations are written. Tokens of a text; only those that touch make a citation.
_TOKEN = re.compile(
    r"""
    (?P<act>(?i:\b(?:(?:Council|Commission|European|Parliament|Implementing|Delegated|Framework)(?:\s+(?:and|of|the))?\s+)+)?
        (?i:(?P<kind>Regulation|Directive|Decision)\s*(?:\((?:EU|EC|EEC|Euratom)\)\s*)?(?:No\s*)?(?P<first>\d{1,4})/(?P<second>\d{1,4})(?:/\w{2,7})?))
    | (?P<articles>Articles?\s+(?=\d))
    | (?P<annexes>Annexe?s?\s+(?=[IVXLC\d]))
    | (?P<bare>(?<=\b[Tt]he\ )Annex(?=\s+to\s)(?:,\s*point\s+\((?P<bare_point>[0-9a-z]+)\))?)
    | (?P<link>(?:,\s*(?:first|second|third|fourth|fifth|last)\s+subparagraph)?,?\s+(?:of|to|in)\s+(?:that\s+|the\s+)?)
    | (?P<joint>\s*(?:,|and)\s+(?=\d|[IVXLC]))
    | (?P<item>(?:(?P<number>\d+)(?!st\b|nd\b|rd\b|th\b)(?P<letters>[a-z]{0,2})\b|(?P<roman>[IVXLC]+))
        (?P<paragraph>\(\d+(?:-?[a-z]+)?\))?(?:,\s*point\s+\((?P<point>[0-9a-z]+)\))?)
    """,
    re.X,
)
KINDS = ("act", "articles", "annexes", "bare", "link", "joint", "item")
_LETTER = {"regulation": "R", "directive": "L", "decision": "D"}


@dataclass(frozen=True)
class Reference:
    raw: str
    instrument: str | None = None
    article: str | None = None
    paragraph: str | None = None
    point: str | None = None
    annex: str | None = None


def _year(x: str, this_year: int) -> int | None:
    x = "19" + x if len(x) == 2 else x
    return int(x) if len(x) == 4 and x[:2] in ("19", "20") and int(x) <= this_year else None


def instrument_id(kind: str, first: str, second: str, this_year: int) -> str | None:
    """The identifier of an act cited as kind first/second, or None if the parts make none."""
    kind, a, b = kind.lower(), _year(first, this_year), _year(second, this_year)
    year_first = b is None if a is None or b is None else kind != "regulation" or a >= 2015
    year, number = (a, second) if year_first else (b, first)
    return f"3{year}{_LETTER[kind]}{number:0>4}" if year and len(number) <= 4 else None


def _cited(article: str | None, paragraph: str | None, point: str | None, annex: str | None) -> str:
    base = f"Article {article}" + (f"({paragraph})" if paragraph else "") if article else f"Annex {annex}".rstrip()
    return base + (f", point ({point})" if point else "")


class Reader:
    """Reads tokens in order, with one open list of divisions: what it may go on with depends on the token that ended it."""

    def __init__(self, this_year: int):
        self.this_year = this_year
        self.found: list[Reference] = []  # divisions
        self.acts: list[Reference] = []  # acts that qualify no division
        self.members: list[Reference] = []
        self.kind, self.awaits = "", ""  # of the list: articles or annexes; a first item, more or an act
        self.end = self.link = 0  # where the list ends, and where what touches it last does

    def close(self) -> None:
        self.found += self.members
        self.members, self.awaits = [], ""

    def read(self, text: str) -> list[Reference]:
        at = 0
        while m := _TOKEN.search(text, at):
            touches, kind = bool(self.awaits) and m.start() == self.link, next(k for k in KINDS if m[k] is not None)
            at = m.end()
            if kind in ("articles", "annexes", "bare"):
                self.close()
                self.kind, self.awaits, self.link = kind, "first", m.end()
                if kind == "bare":
                    self.member(None, None, m["bare_point"], "", m.end())
            elif kind == "act":
                self.act(m, text, touches and self.awaits == "act")
            elif kind == "item" and touches and self.awaits in ("first", "more"):
                at = self.item(m)
            elif kind == "link" and touches and self.awaits == "after":
                self.awaits, self.link = "act", m.end()
            elif kind == "joint" and touches and self.awaits == "after" and self.kind != "bare":
                self.awaits, self.link = "more", m.end()
            elif not touches or self.awaits != "act":
                self.close()
        self.close()
        return list(dict.fromkeys(self.found + self.acts))

    def member(self, article: str | None, paragraph: str | None, point: str | None, annex: str | None, end: int) -> None:
        self.members.append(Reference(_cited(article, paragraph, point, annex), None, article, paragraph, point, annex))
        self.awaits, self.end, self.link = "after", end, end

    def item(self, m: re.Match) -> int:
        """Takes a member if it is one of this kind of list; returns where reading goes on."""
        more = self.awaits == "more"
        if self.kind == "articles" and m["number"] and not (more and len(m["number"]) > 3):
            self.member(m["number"] + m["letters"], m["paragraph"] and m["paragraph"][1:-1], m["point"], None, m.end())
        elif self.kind == "annexes" and (name := m["roman"] or m["number"]) and not (more and len(name) > (4 if m["roman"] else 2)):
            plain = not m["letters"] and not m["paragraph"]  # an annex has neither
            self.member(None, None, m["point"] if plain else None, name, m.end() if plain else m.start() + len(name))
        else:
            self.close()
            return m.end()
        return self.end

    def act(self, m: re.Match, text: str, owns: bool) -> None:
        name = instrument_id(m["kind"], m["first"], m["second"], self.this_year)
        if owns:  # an act without an identifier takes its divisions with it
            self.found += [replace(r, raw=r.raw + text[self.end : m.end()], instrument=name) for r in self.members if name]
            self.members, self.awaits = [], ""
        else:
            self.close()
            self.acts += [Reference(m["act"], name)] if name else []


def extract(text: str | None, this_year: int) -> list[Reference]:
    """The references of a text, each once: divisions in order, then acts that qualify none of them."""
    return Reader(this_year).read(text or "")


def references(text: Column, this_year: int) -> Column:
    """array<struct> of a text column's references."""
    kind = "array<struct<" + ",".join(f"{c}:string" for c in FIELDS) + ">>"

    @F.arrow_udf(kind)
    def run(texts: pa.Array) -> pa.Array:
        struct = pa.list_(pa.struct([(c, pa.string()) for c in FIELDS]))
        return pa.array(([{c: getattr(r, c) for c in FIELDS} for r in extract(t.as_py(), this_year)] for t in texts), type=struct)

    return run(text)
