"""Recorded pages of outside services as a Python data source: `pages.scan(spark, kind, folder)`, one partition a page.

A folder holds a service's answers, a JSON file a page. Kinds:
- listing: an object store's list of keys. Pages follow each other by tokens; a page whose token no page gives, or that is told
  of and isn't there, is an error, as a listing with a gap would delete what it leaves out. A prefix asks only the pages
  that can hold it, since keys come in order.
- acts: answers of a discovery endpoint, about the acts of a topic or those that were cited; unknown acts have no rows.
- files: published report files with period, version and the day they were made.

What is asked for is handed to the reader with the table, so that each table has its own predicates.
"""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql.types import StructType

SCHEMAS = {
    "listing": "key string, size long, etag string",
    "acts": "celex string, seq int, in_force boolean, consolidation string, title string, basis_article string",
    "files": "period int, version int, generated date",
}
#: What an endpoint writes for truth, and the form of a listing's moments.
TRUTH, MOMENT = {"1": True, "true": True, "0": False, "false": False}, "%d-%m-%Y %H:%M:%S"


@dataclass
class Page(ds.InputPartition):
    path: str


class PageSource(ds.DataSource):
    """options: kind, path; prefix (listing), celex (acts, a JSON list), period (files)."""

    @classmethod
    def name(cls) -> str:
        return "pages"

    def schema(self) -> str:
        return SCHEMAS[self.options["kind"]]

    def reader(self, schema: StructType) -> PageReader:
        return PageReader(self.options)


class PageReader(ds.DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.kind, self.path = options["kind"], options["path"]
        self.prefix, self.period = options.get("prefix", ""), options.get("period")
        self.celex = set(json.loads(options["celex"])) if "celex" in options else None

    def _page(self, path: str) -> dict:
        store, _ = fs.FileSystem.from_uri(self.path)
        with store.open_input_stream(path) as page:
            return json.loads(page.read())

    def partitions(self) -> list[Page]:
        store, at = fs.FileSystem.from_uri(self.path)
        found = sorted(x.path for x in store.get_file_info(fs.FileSelector(at)) if x.is_file and x.extension == "json")
        if self.kind != "listing":
            return [Page(p) for p in found] or [Page("")]
        by_token = {}
        for path in found:
            page = self._page(path)
            keys = [o["key"] for o in page.get("contents", ())]
            by_token[page.get("token")] = (path, page.get("next"), keys[:1], keys[-1:])
        chain, token = [], None
        while by_token:
            if token not in by_token:
                raise ValueError(f"the page after {token!r} is missing" if chain else "the first page is missing")
            path, token, low, high = by_token.pop(token)
            if low and (high[0] >= self.prefix and low[0] <= self.prefix + "\U0010ffff"):
                chain.append(Page(path))
            if token is None:
                break
        if by_token:
            raise ValueError(f"no page tells of {sorted(map(str, by_token))}")
        if token is not None:
            raise ValueError(f"the page after {token!r} is missing")
        return chain or [Page("")]

    def read(self, partition: Page) -> Iterator[tuple]:
        if not partition.path:
            return
        page = self._page(partition.path)
        if self.kind == "listing":
            yield from ((o["key"], o.get("size"), o.get("etag")) for o in page["contents"] if o["key"].startswith(self.prefix))
        elif self.kind == "files":
            for f in page["files"]:
                if self.period is None or f["period"] == int(self.period):
                    yield f["period"], f["version"], dt.datetime.strptime(f["generationDate"], MOMENT).date()
        else:
            for seq, b in enumerate(page["results"]["bindings"]):
                value = lambda c: b.get(c, {}).get("value")  # noqa: B023, E731
                if self.celex is None or value("c") in self.celex:
                    title = value("title")
                    yield value("c"), seq, TRUTH.get(value("force")), value("cons"), title and title.replace("\xa0", " "), value("basis")


def scan(spark: SparkSession, kind: str, path: str, **asked: object) -> DataFrame:
    """The rows of a folder's pages: of keys with a prefix, of some acts (celex, a list), or of a period."""
    spark.dataSource.register(PageSource)
    told = {k: json.dumps(sorted(v)) if isinstance(v, (list, set, tuple)) else str(v) for k, v in asked.items() if v is not None}
    return spark.read.format("pages").options(kind=kind, path=path, **told).load()
