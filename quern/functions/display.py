"""Answers as they are shown: citation markers, formulas, money, steps. Code and formulas are never read as citations.

One pattern cuts an answer into spans: code (fenced blocks, inline spans, formulas), citations with what stands beside them,
amounts, and the prose between. What is shown is a choice for each kind of span.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Collection, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: How fences, code, formulas, markers and amounts look, and what steps are called while they run and after.
_UNFENCED = r"(?:(?!^\ {0,3}(?:`{3,}|~{3,}))[\s\S])"
_SPAN = re.compile(
    rf"""
    (?P<fence>^\ {{0,3}}(?P<mark>(?P<tick>[`~])(?P=tick){{2,}})[^\n]*(?:\n(?:(?!\ {{0,3}}(?P=mark))[^\n]*(?:\n|\Z))*(?:\ {{0,3}}(?P=mark)[^\n]*\n?)?|\Z))
    | (?P<code>(?P<ticks>`+)(?:{_UNFENCED}*?(?P=ticks)|{_UNFENCED}*))
    | (?P<formula>\$\$(?:(?!\$\$){_UNFENCED})+\$\$|\$(?!\d)(?:(?!\$){_UNFENCED})+\$)
    | (?P<cited>\ ?(?:\[\d+\])+)(?P<stop>[.,;:]?)
    | (?P<amount>(?<!\\)\$(?=\d))
    """,
    re.M | re.X,
)
_NUMBER = re.compile(r"\d+")
_FORMULA = re.compile(r"\$\$((?:\\[\s\S]|[^\\])+?)\$\$")
STEPS = {
    "rewrite": ("Rewriting the question", "Rewrote the question"),
    "decompose": ("Splitting the question", "Split the question"),
    "retrieve": ("Searching the corpus", "Searched the corpus"),
    "assess": ("Reviewing the evidence", "Reviewed the evidence"),
    "assess_tools": ("Running tools", "Ran tools"),
    "tool_search": ("Extending the search", "Extended the search"),
    "tool_follow_reference": ("Following a reference", "Followed a reference"),
    "tool_refuse": ("Finding nothing that bears on the question", "Found nothing that bears on the question"),
    "tool_unknown": ("Asking for a tool it does not have", "Asked for a tool it does not have"),
    "synthesize": ("Writing the answer", "Wrote the answer"),
    "refuse": ("Declining to answer", "Declined to answer"),
}


@dataclass(frozen=True)
class Span:
    """A piece of an answer: kind is prose, code, cited or amount; numbers and stop are those of a citation."""

    kind: str
    text: str
    numbers: tuple[int, ...] = ()
    stop: str = ""


def spans(answer: str) -> Iterator[Span]:
    """The spans of an answer, whose texts and stops make it up again."""
    at = 0
    for m in _SPAN.finditer(answer):
        if m.start() > at:
            yield Span("prose", answer[at : m.start()])
        if m["cited"] is not None:
            yield Span("cited", m["cited"], tuple(map(int, _NUMBER.findall(m["cited"]))), m["stop"])
        else:
            yield Span("amount" if m["amount"] is not None else "code", m[0])
        at = m.end()
    if at < len(answer):
        yield Span("prose", answer[at:])


def shown(span: Span, known: Collection[int], early: bool) -> list[int] | None:
    """The markers of a citation that stay, or None to leave it as it is: several markers that are all known go; so do those
    that a stop follows, behind which they move, if `early`."""
    if not all(n in known for n in span.numbers):
        return None
    return [] if len(span.numbers) > 1 else list(span.numbers) if early and span.stop else None


def cited(answer: str, known: Collection[int]) -> dict[int, int]:
    """The number that each known marker is shown as: 1 up, by first use in prose."""
    used = dict.fromkeys(n for s in spans(answer) for n in s.numbers if n in known)
    return {n: i for i, n in enumerate(used, 1)}


def renumbered(answer: str, known: Collection[int]) -> str:
    """The answer with its markers as the reader sees them; two or more known ones in a row are left out."""
    new = cited(answer, known)
    out = []
    for s in spans(answer):
        keep = s.kind != "cited" or shown(s, known, False) is None
        text = _NUMBER.sub(lambda m: str(new.get(int(m[0]), m[0])), s.text) if s.kind == "cited" else s.text
        out.append((text if keep else "") + s.stop)
    return "".join(out)


def segments(prose: str, known: Collection[int]) -> list[tuple[str, str]]:
    """('text', words) and ('marker', number) of a piece of prose, a known marker behind the stop that follows it."""
    out: list[tuple[str, str]] = []

    def say(words: str) -> None:
        if words and out and out[-1][0] == "text":
            out[-1] = ("text", out[-1][1] + words)
        elif words:
            out.append(("text", words))

    for s in spans(prose):
        if s.kind != "cited":
            say(s.text)
            continue
        moved = shown(s, known, True)
        if moved is not None:
            say(s.stop)
            out += [("marker", str(n)) for n in moved]
            continue
        at = 0
        for m in re.finditer(r"\[(\d+)\]", s.text):
            if int(m[1]) in known:
                say(s.text[at : m.start()])
                out.append(("marker", m[1]))
                at = m.end()
        say(s.text[at:] + s.stop)
    return out


def formula_segments(text: str) -> list[tuple[str, str]]:
    """('text', ...), ('formula', latex) and ('block', latex) for formulas alone on their lines, whose line breaks go."""
    out: list[tuple[str, str]] = []
    at = 0
    for m in _FORMULA.finditer(text):
        own = text[:m.start()].endswith("\n") or m.start() == 0, text[m.end():].startswith("\n") or m.end() == len(text)
        before = text[at : m.start()]
        if all(own):
            before = before.removesuffix("\n")
        out += [("text", before)] * bool(before) + [("block" if all(own) else "formula", m[1])]
        at = m.end() + (all(own) and m.end() < len(text))
    return out + [("text", text[at:])] * (at < len(text))


def open_formula_held(answer: str) -> str:
    """Without a formula that its last line has begun and not yet ended."""
    return answer[: answer.rindex("$$")] if answer.rpartition("\n")[2].count("$$") % 2 else answer


def amounts_escaped(answer: str) -> str:
    """With the dollar signs of amounts escaped, outside code and formulas."""
    return "".join(("\\$" if s.kind == "amount" else s.text) + s.stop for s in spans(answer))


def _mapped(kind: str, function: Callable, *columns: Column) -> Column:
    @F.arrow_udf(kind)
    def run(*arrays: pa.Array) -> pa.Array:
        rows = zip(*(a.to_pylist() for a in arrays), strict=True)
        return pa.array((None if r[0] is None else function(*r) for r in rows), type=pa.string())

    return run(*columns)


def renumbered_column(answer: Column, markers: Column) -> Column:
    """Answers renumbered for the markers of their sources (array<int>)."""
    return _mapped("string", lambda a, ms: renumbered(a, set(ms or [])), answer, markers)


def amounts_escaped_column(answer: Column) -> Column:
    return _mapped("string", amounts_escaped, answer)


def step_label(step: Column, status: Column) -> Column:
    """What a step is called; one that isn't known goes by its own name."""
    names = F.create_map(*(F.lit(x) for k, v in STEPS.items() for x in (k, f"{v[0]}\n{v[1]}")))
    both = F.split(F.try_element_at(names, step), "\n")
    return F.coalesce(F.when(status == "running", both[0]).otherwise(both[1]), step)


def short_ms(ms: Column) -> Column:
    return F.when(ms < 1000, F.concat(F.floor(ms + 0.5).cast("string"), F.lit("ms"))).otherwise(F.format_string("%.1fs", ms / 1000.0))
