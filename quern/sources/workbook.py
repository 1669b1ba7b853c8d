"""Workbooks of emission reports: XLSX files read with the standard library alone."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from typing import Any
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions import text

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
HEADER_ROW = 3

#: Where the two known layouts keep their columns, and the header that tells them.
_COMMON = {"imo": 0, "ship_name": 1, "ship_type": 2, "period_label": 3}
LAYOUTS = (
    ("CO2 emissions to be reported under Directive 2003/87/EC [m tonnes]", 37, {**_COMMON, "company_imo": 8, "company_name": 9, "co2_total": 28, "co2_between_ms": 29, "co2_departed_ms": 30, "co2_arrived_ms": 31, "co2_at_berth": 32, "co2_ets": 37}),
    ("Total CO₂ emissions [m tonnes]", 24, {**_COMMON, "co2_total": 24, "co2_between_ms": 25, "co2_departed_ms": 26, "co2_arrived_ms": 27, "co2_at_berth": 28}),
)
NAMES = ("imo", "ship_name", "ship_type", "period_label", "company_imo", "company_name")
FIGURES = ("co2_total", "co2_ets", "co2_between_ms", "co2_departed_ms", "co2_arrived_ms", "co2_at_berth")


class LayoutError(ValueError):
    """A sheet whose columns aren't where they are read."""


def _column(ref: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]+", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def sheets(content: bytes) -> Iterator[tuple[str, list[dict[int, str]]]]:
    """(title, rows) of a workbook's sheets; a row maps column numbers to texts."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{_MAIN}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))]
        paths = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        for sheet in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_MAIN}sheet"):
            target = paths[sheet.get(_REL)].lstrip("/")
            rows: list[dict[int, str]] = []
            for row in ElementTree.fromstring(z.read(target if target.startswith("xl/") else f"xl/{target}")).iter(f"{_MAIN}row"):
                cells = {}
                for c in row.iter(f"{_MAIN}c"):
                    v = c.find(f"{_MAIN}v")
                    if c.get("t") == "inlineStr":
                        cells[_column(c.get("r"))] = "".join(t.text or "" for t in c.iter(f"{_MAIN}t"))
                    elif v is not None and v.text is not None:
                        cells[_column(c.get("r"))] = shared[int(v.text)] if c.get("t") == "s" else v.text
                at = int(row.get("r", len(rows) + 1))
                rows += [{} for _ in range(at - 1 - len(rows))]
                rows.append(cells)
            yield sheet.get("name"), rows


def _figure(x: str | None) -> float | None:
    try:
        return float(x) if x is not None else None
    except ValueError:
        return None


def read_rows(content: bytes) -> Iterator[dict[str, Any]]:
    """The reports of a workbook; a sheet of no known layout raises."""
    for title, rows in sheets(content):
        header = rows[HEADER_ROW - 1] if len(rows) >= HEADER_ROW else {}
        layout = next((columns for told, at, columns in LAYOUTS if header.get(at) == told), None)
        if layout is None:
            raise LayoutError(f"{title}: no known layout")
        for row in rows[HEADER_ROW:]:
            if row.get(layout["imo"]):
                got = {c: row.get(layout[c]) if c in layout else None for c in NAMES}
                yield {"sheet": "partial" if "Partial" in title else "full", **got, **{c: _figure(row.get(layout[c])) if c in layout else None for c in FIGURES}}


def read_reports(files: DataFrame) -> DataFrame:
    """Reports of workbooks (period, version, generated, content), with the keys that names are matched by."""
    columns = ["period", "version", "generated", "sheet", *NAMES, *FIGURES]
    schema = "period int, version int, generated date, sheet string, " + ", ".join(f"{c} string" for c in NAMES) + ", " + ", ".join(f"{c} double" for c in FIGURES)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for f in frame.to_dict("records"):
                yield pd.DataFrame([{**{c: f[c] for c in ("period", "version", "generated")}, **r} for r in read_rows(f["content"])], columns=columns)

    rows = files.select("period", "version", "generated", "content").mapInPandas(run, schema)
    return rows.withColumns({"ship_key": text.name_key("ship_name"), "company_key": F.when(F.col("company_name").isNotNull(), text.company_key("company_name"))})
