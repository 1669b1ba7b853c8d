"""Operator 13: web archives as a Python data source, `spark.read.format("warc")` and `df.write.format("warc")`.

Writing: each task writes archives of gzip members, a record each, and rolls them at `roll_bytes`; the driver's commit names
the files of the tasks that ended well in one manifest, so files of lost or repeated attempts are never read. A member's
extra field `sl` holds its packed and unpacked length.

Reading: `partitions` plans files, small ones together. `scan` pushes predicates on columns that stand in a record's header
down to the reader. With the option `pushdown`, and spark.sql.python.filterPushdown.enabled set, Spark pushes its own `where`
down by the same way; but Spark 4.1 then keeps the filters of the last plan with a loaded table, so that a table which is loaded once and
filtered twice loses rows. `scan` gives each table its own predicates and has no such fault. A task unpacks a record's header first; a record that a filter refuses is
stepped over, by the lengths of `sl` without unpacking it, and a payload is taken apart only where the schema asks for it.
Archives without a manifest, without `sl` or without compression are read as well.

Columns: record_id, record_type, date, target_uri, content_type, payload_digest, refers_to, profile, content_length (header);
headers (all of them, names in lower case); payload_length, payload. The payload is what follows the HTTP header in a
response, nothing in a revisit, and the whole block elsewhere. payload_length is the payload's, of a revisit what its HTTP
header says of the page it stands for. A schema of the caller's chooses among them.

Edge cases: a header that a record lacks is null; control characters, blanks and letters beyond ASCII of an address are written
percent-encoded; an empty table gives a manifest without files, and such a folder reads as no rows; a cut or broken record
is an error that names its file and place. Nulls, repeated rows and clashing columns: see `records`.
"""

from __future__ import annotations

import base64
import json
import pickle
import struct
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quern.llm.common import SMALL
from quern.llm.shared import new_folder, opened

HEADER = {
    "record_id": "WARC-Record-ID", "record_type": "WARC-Type", "date": "WARC-Date", "target_uri": "WARC-Target-URI", "content_type": "Content-Type",
    "payload_digest": "WARC-Payload-Digest", "refers_to": "WARC-Refers-To", "profile": "WARC-Profile", "content_length": "Content-Length",
}
SCHEMA = ", ".join(f"{c} {'long' if c == 'content_length' else 'string'}" for c in HEADER) + ", headers map<string,string>, payload_length long, payload binary"
#: Fixed values of the format.
VERSION, SAME_PAYLOAD, EPOCH = "WARC/1.1", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "1970-01-01T00:00:00Z"
MANIFEST, ROLL_BYTES, SPLIT_BYTES = "_manifest-", 64 << 20, 64 << 20
LEAST = 100
#: Copies from which a payload's group is hot; such groups are told by a broadcast, if a count finds them few.
HOT = 1_000
BATCH_BYTES, BATCH_ROWS = 4 << 20, 2_000


# records and files


def member(block: bytes, level: int = 3) -> bytes:
    """A gzip member whose extra field `sl` holds the lengths packed and unpacked."""
    packer = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = packer.compress(block) + packer.flush()
    length = 10 + 2 + 12 + len(body) + 8
    head = struct.pack("<4sLBB", b"\x1f\x8b\x08\x04", 0, 0, 255) + struct.pack("<H2sHLL", 12, b"sl", 8, length, len(block))
    return head + body + struct.pack("<LL", zlib.crc32(block), len(block) & 0xFFFFFFFF)


def record(headers: dict[str, str | None], block: bytes) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in headers.items() if v is not None)
    return f"{VERSION}\r\n{lines}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def http(length: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()


def plain_uri(uri: str | None) -> str | None:
    return None if uri is None else quote(uri, safe="!#$%&'()*+,/:;=?@[]~-._")


class Window:
    """A file, read in parts of at least a step; what lies before the place that is asked for is forgotten."""

    def __init__(self, file, step: int = 1 << 18):
        self.file, self.size, self.step = file, file.size(), step
        self.start, self.held = 0, b""

    def at(self, place: int, n: int) -> bytes:
        if place < self.start or place + n > self.start + len(self.held):
            self.file.seek(place)
            self.start, self.held = place, self.file.read(max(n, self.step))
        return self.held[place - self.start : place - self.start + n]


def _head_end(data: bytes) -> int:
    return data.find(b"\r\n\r\n")


def _parsed(head: bytes) -> dict[str, str]:
    first, *lines = head.decode("utf-8", "replace").split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("no record begins here")
    found: dict[str, str] = {}
    for line in lines:
        name, colon, value = line.partition(":")
        if colon:
            found.setdefault(name.strip().lower(), value.strip())
    return found


def read_records(file, wanted: Callable[[dict[str, str]], bool], blocks: bool) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header and block (empty unless `blocks`) of the records of a file that are wanted by their headers."""
    w, place = Window(file), 0
    while place < w.size:
        try:
            packed = w.at(place, 2) == b"\x1f\x8b"
            head, block, place = (_from_member if packed else _from_plain)(w, place, wanted, blocks)
        except (ValueError, struct.error, zlib.error) as e:
            raise ValueError(f"broken record at byte {place}: {e}") from e
        if head is not None:
            yield head, block


def _from_plain(w: Window, place: int, wanted: Callable, blocks: bool) -> tuple[dict | None, bytes, int]:
    n = 1 << 12
    while (end := _head_end(data := w.at(place, n))) < 0:
        if place + n >= w.size:
            raise ValueError("a header without end")
        n *= 4
    head = _parsed(data[:end])
    begin, length = place + end + 4, int(head["content-length"])
    if begin + length > w.size:
        raise ValueError("a block without end")
    if not wanted(head):
        return None, b"", begin + length + 4
    return head, w.at(begin, length) if blocks else b"", begin + length + 4


def _skip_length(w: Window, place: int) -> int | None:
    """The packed length of a member, if its extra field tells."""
    fixed = w.at(place, 12)
    if len(fixed) < 12 or not fixed[3] & 4:
        return None
    extra = w.at(place + 12, struct.unpack("<H", fixed[10:12])[0])
    while len(extra) >= 4:
        name, n = struct.unpack("<2sH", extra[:4])
        if name == b"sl" and n == 8:
            return struct.unpack("<L", extra[4:8])[0]
        extra = extra[4 + n :]
    return None


def _from_member(w: Window, place: int, wanted: Callable, blocks: bool) -> tuple[dict | None, bytes, int]:
    unpack, at = zlib.decompressobj(31), place
    rest, data = b"", b""

    def more(most: int) -> bytes:
        nonlocal at, rest
        if not rest:
            rest = w.at(at, 1 << 14)
            at += len(rest)
            if not rest:
                raise ValueError("a member without end")
        out = unpack.decompress(rest, most)
        rest = unpack.unconsumed_tail
        return out

    while (end := _head_end(data)) < 0:
        if unpack.eof:
            raise ValueError("a header without end")
        data += more(1 << 12)
    head = _parsed(data[:end])
    take = wanted(head)
    if not (take and blocks) and (length := _skip_length(w, place)):
        return (head if take else None), b"", place + length
    parts = [data[end + 4 :]]
    while not unpack.eof:
        part = more(1 << 20)
        if take and blocks:
            parts.append(part)
    after = at - len(unpack.unused_data)
    if not take:
        return None, b"", after
    block, length = b"".join(parts), int(head["content-length"])
    if blocks and len(block) < length:
        raise ValueError("a block without end")
    return head, block[:length] if blocks else b"", after


def payload(head: dict[str, str], block: bytes) -> tuple[int, bytes]:
    """Length and bytes of what a record carries."""
    if not head.get("content-type", "").startswith("application/http"):
        return len(block), block
    end = _head_end(block)
    first = block if end < 0 else block[:end]
    body = b"" if end < 0 else block[end + 4 :]
    if head.get("warc-type") != "revisit":
        return len(body), body
    told = [v for k, _, v in (x.partition(b":") for x in first.split(b"\r\n")) if k.strip().lower() == b"content-length"]
    return int(told[0]) if told else 0, b""


# filters


def _holds(f: ds.Filter, value) -> bool | None:
    """What a filter says of a header's value; null where SQL says null."""
    match f:
        case ds.IsNull():
            return value is None
        case ds.IsNotNull():
            return value is not None
        case ds.EqualNullSafe():
            return value == f.value
        case ds.Not():
            inner = _holds(f.child, value)
            return None if inner is None else not inner
    if value is None:
        return None
    match f:
        case ds.EqualTo():
            return value == f.value
        case ds.In():
            return value in f.value or (None if None in f.value else False)
        case ds.GreaterThan():
            return value > f.value
        case ds.GreaterThanOrEqual():
            return value >= f.value
        case ds.LessThan():
            return value < f.value
        case ds.LessThanOrEqual():
            return value <= f.value
        case ds.StringStartsWith():
            return value.startswith(f.value)
        case ds.StringEndsWith():
            return value.endswith(f.value)
        case ds.StringContains():
            return f.value in value
    raise TypeError(f"unknown filter {f!r}")


_KNOWN = (ds.IsNull, ds.IsNotNull, ds.EqualNullSafe, ds.EqualTo, ds.In, ds.GreaterThan, ds.GreaterThanOrEqual, ds.LessThan, ds.LessThanOrEqual, ds.StringStartsWith, ds.StringEndsWith, ds.StringContains)


def _column(f: ds.Filter) -> str | None:
    """The header column that a filter is about, if it can be told from headers alone."""
    while isinstance(f, ds.Not):
        f = f.child
    return f.attribute[0] if isinstance(f, _KNOWN) and len(f.attribute) == 1 and f.attribute[0] in HEADER else None


def header_value(head: dict[str, str], column: str):
    value = head.get(HEADER[column].lower())
    return int(value) if column == "content_length" and value is not None else value


# the data source


@dataclass
class Files(ds.InputPartition):
    paths: list[str]


@dataclass
class Written(ds.WriterCommitMessage):
    files: list[tuple[str, int]]


class WarcSource(ds.DataSource):
    """options: path; roll_bytes and level (writing); split_bytes, filters, pushdown (reading)."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return (PushedReader if self.options.get("pushdown") == "true" else WarcReader)(self.options, schema)

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options, schema, overwrite)


class WarcReader(ds.DataSourceReader):
    def __init__(self, options: dict[str, str], schema: StructType):
        self.path, self.split = options["path"], int(options.get("split_bytes", SPLIT_BYTES))
        self.columns = schema.names
        if unknown := set(self.columns) - {*HEADER, "headers", "payload_length", "payload"}:
            raise ValueError(f"an archive has no column {sorted(unknown)}")
        self.filters: list[tuple[str, ds.Filter]] = []
        if left := list(self.taken(pickle.loads(base64.b64decode(options.get("filters", ""))) if options.get("filters") else [])):
            raise ValueError(f"no header tells {left}")

    def taken(self, filters: list[ds.Filter]) -> Iterable[ds.Filter]:
        """Takes the filters that headers can tell and gives the others back."""
        for f in filters:
            if column := _column(f):
                self.filters.append((column, f))
            else:
                yield f

    def partitions(self) -> list[Files]:
        store, at = opened(self.path)
        found = store.get_file_info(fs.FileSelector(at, recursive=False)) if store.get_file_info(at).type == fs.FileType.Directory else [store.get_file_info(at)]
        manifests = [x for x in found if x.base_name.startswith(MANIFEST)]
        if manifests:
            files = [(f"{at}/{name}", size) for m in manifests for name, size in json.loads(store.open_input_stream(m.path).read())]
        else:
            files = [(x.path, x.size) for x in found if x.type == fs.FileType.File and not x.base_name.startswith(("_", "."))]
        tasks: list[Files] = []
        room = 0
        for name, size in sorted(files):
            if not tasks or size > room:
                tasks.append(Files([]))
                room = self.split
            tasks[-1].paths.append(name)
            room -= size
        return tasks or [Files([])]

    def wanted(self, head: dict[str, str]) -> bool:
        return all(_holds(f, header_value(head, c)) for c, f in self.filters)

    def _rows(self, partition: Files) -> Iterator[tuple[tuple, int]]:
        store, _ = opened(self.path)
        blocks = not {"payload", "payload_length"}.isdisjoint(self.columns)
        for path in partition.paths:
            with store.open_input_file(path) as file:
                try:
                    for head, block in read_records(file, self.wanted, blocks):
                        length, body = payload(head, block)
                        own = {"headers": list(head.items()), "payload_length": length, "payload": body}
                        yield tuple(own[c] if c in own else header_value(head, c) for c in self.columns), len(body) + 500
                except ValueError as e:
                    raise ValueError(f"{path}: {e}") from e

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        kinds = {"headers": pa.map_(pa.string(), pa.string()), "payload": pa.binary(), "payload_length": pa.int64(), "content_length": pa.int64()}
        schema = pa.schema([(c, kinds.get(c, pa.string())) for c in self.columns])
        held, size = [], 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)

        for row, weight in self._rows(partition):
            held.append(row)
            size += weight
            if size >= BATCH_BYTES or len(held) >= BATCH_ROWS:
                yield batch()
                held, size = [], 0
        if held:
            yield batch()


class PushedReader(WarcReader):
    def pushFilters(self, filters: list[ds.Filter]) -> Iterable[ds.Filter]:
        return self.taken(filters)


class WarcWriter(ds.DataSourceArrowWriter):
    """Rows of record_id, record_type, and of date, target_uri, payload_digest, refers_to, payload, payload_length as given."""

    def __init__(self, options: dict[str, str], schema: StructType, overwrite: bool):
        self.path, self.roll, self.level = options["path"], int(options.get("roll_bytes", ROLL_BYTES)), int(options.get("level", 3))
        self.overwrite, self.columns, self.job = overwrite, schema.names, uuid.uuid4().hex[:12]

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        store, at = opened(self.path)
        store.create_dir(at, recursive=True)
        written: list[tuple[str, int]] = []
        out, name, size = None, "", 0
        for batch in batches:
            for row in range(batch.num_rows):
                if out is None:
                    name = f"{self.job}-{uuid.uuid4().hex}.warc.gz"
                    out, size = store.open_output_stream(f"{at}/{name}", compression=None), 0
                    info = record({"WARC-Record-ID": f"<urn:uuid:{uuid.uuid4()}>", "WARC-Type": "warcinfo", "WARC-Date": EPOCH, "Content-Type": "application/warc-fields"}, b"format: WARC File Format 1.1\r\n")
                    size += out.write(member(info, self.level))
                size += out.write(member(self._record({c: batch.column(i)[row].as_py() for i, c in enumerate(self.columns)}), self.level))
                if size >= self.roll:
                    out.close()
                    written.append((name, size))
                    out = None
        if out is not None:
            out.close()
            written.append((name, size))
        return Written(written)

    def _record(self, row: dict) -> bytes:
        body = bytes(row.get("payload") or b"")
        length = row["payload_length"] if row.get("payload_length") is not None else len(body)
        revisit = row["record_type"] == "revisit"
        headers = {
            "WARC-Record-ID": row["record_id"], "WARC-Type": row["record_type"], "WARC-Date": row.get("date") or EPOCH, "WARC-Target-URI": plain_uri(row.get("target_uri")), "WARC-Payload-Digest": row.get("payload_digest"),
            "WARC-Refers-To": row.get("refers_to"), "WARC-Profile": SAME_PAYLOAD if revisit else None, "Content-Type": f"application/http; msgtype={'request' if row['record_type'] == 'request' else 'response'}",
        }
        return record(headers, http(length) if revisit else http(length) + body)

    def commit(self, messages: list[Written | None]) -> None:
        store, at = opened(self.path)
        store.create_dir(at, recursive=True)
        before = [x.path for x in store.get_file_info(fs.FileSelector(at)) if x.type == fs.FileType.File] if self.overwrite else []
        files = [f for m in messages if m for f in m.files]
        with store.open_output_stream(f"{at}/{MANIFEST}{self.job}.json") as out:
            out.write(json.dumps(files).encode())
        new = {f"{at}/{name}" for name, _ in files}
        for path in before:
            if path not in new:
                store.delete_file(path)

    def abort(self, messages: list[Written | None]) -> None:
        store, at = opened(self.path)
        for name, _ in (f for m in messages if m for f in m.files):
            store.delete_file(f"{at}/{name}")


def register(spark: SparkSession) -> SparkSession:
    """The session, which knows the format."""
    spark.dataSource.register(WarcSource)
    return spark


def scan(spark: SparkSession, path: str, schema: str = SCHEMA, where: Iterable[ds.Filter] = (), **options: object) -> DataFrame:
    """The records of archives whose headers meet every filter (of pyspark.sql.datasource, on columns of HEADER)."""
    pushed = base64.b64encode(pickle.dumps(list(where))).decode()
    return register(spark).read.format("warc").schema(schema).options(filters=pushed, **options).load(path)


# pages to records and back


def record_id(key: Column) -> Column:
    """A URN of a whole number: a free-form (version 8) UUID that holds its 64 bits; null for null."""
    digits = F.lower(F.lpad(F.hex(key), 16, "0"))
    return F.concat(F.lit("<urn:uuid:00000000-"), F.substring(digits, 1, 4), F.lit("-8000-8000-"), F.substring(digits, 5, 12), F.lit(">"))


def id_of(urn: Column) -> Column:
    """The number in such a URN; null for others."""
    digits, low = (F.regexp_extract(urn, "^<urn:uuid:00000000-([0-9a-f]{4})-8000-8000-([0-9a-f]{12})>$", i) for i in (1, 2))
    high = F.conv(digits, 16, 10).cast("long")
    return F.when(digits != "", F.shiftleft(high, 48).bitwiseOR(F.conv(low, 16, 10).cast("long")))  # the shift drops what a sign takes


def records(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", least: int = LEAST) -> DataFrame:
    """A record for each page: of pages with equal payloads of at least `least` bytes, those with the smallest key are
    responses and the others revisits of it, without a payload; smaller ones are responses.

    Keys are whole numbers. A page without a key is written under a record id of its own and is never the one that others
    revisit; pages of which none has a key are responses. Rows that share the smallest key are responses all. A null html is
    empty. Other columns are left out.

    Payloads are compared by SHA-256. Groups are summed before the shuffle; the groups of `HOT` and more copies reach pages by
    a broadcast if a count finds them few, so their copies, as revisits, cross the shuffle without their payloads and spread.
    """
    body = F.coalesce(F.col(html).cast("string").cast("binary"), F.lit(b""))
    told = pages.select(F.col(key).cast("long").alias("id"), F.col(url).cast("string").alias("target_uri"), body.alias("payload"))
    told = told.select("*", F.length("payload").cast("long").alias("payload_length"), F.sha2("payload", 256).alias("digest"))
    groups = told.where(F.col("payload_length") >= least).groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null")
    hot = groups.where(F.col("n") >= HOT).select("digest", F.col("first").alias("hot_first"))
    if hot.limit(SMALL + 1).count() <= SMALL:
        told, groups = told.join(F.broadcast(hot), "digest", "left"), groups.where(F.col("n") < HOT)
    else:
        told = told.withColumn("hot_first", F.lit(None).cast("long"))
    # rows that no other group can hold meet none: by a key of their own they spread
    alone = F.concat(F.lit("-"), F.xxhash64("id", "target_uri").cast("string"))
    told = told.withColumn("at", F.when(F.col("hot_first").isNull() & (F.col("payload_length") >= least), F.col("digest")).otherwise(alone))
    told = told.withColumn("payload", F.when(F.col("hot_first").isNull() | F.col("id").eqNullSafe(F.col("hot_first")), F.col("payload")))
    joined = told.join(groups.select(F.col("digest").alias("at"), "first"), "at", "left").withColumn("of", F.coalesce("hot_first", "first"))
    again = F.col("of").isNotNull() & ~F.col("id").eqNullSafe(F.col("of"))
    return joined.select(
        F.coalesce(record_id(F.col("id")), F.concat(F.lit("<urn:uuid:"), F.uuid(), F.lit(">"))).alias("record_id"), F.when(again, "revisit").otherwise("response").alias("record_type"), "target_uri",
        F.concat(F.lit("sha256:"), "digest").alias("payload_digest"), F.when(again, record_id(F.col("of"))).alias("refers_to"), "payload_length", F.when(~again, F.col("payload")).alias("payload"),
    )


def archive(pages: DataFrame, path: str | None = None, **columns: str) -> str:
    """Writes the records of pages to archives and tells their folder, one of its own in the shared folder if none is given."""
    spark = register(pages.sparkSession)
    path = path or new_folder(spark, "warc")
    records(pages, **columns).write.format("warc").mode("append").save(path)
    return path


def read_back(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of the page records of archives.

    Responses are measured by their payloads, unpacked; of revisits only headers and the HTTP header are read.
    """
    kind = ("record_type",)
    whole = scan(spark, path, "record_id string, record_type string, payload binary", [ds.EqualTo(kind, "response")])
    again = scan(spark, path, "record_id string, record_type string, payload_digest string, refers_to string, payload_length long", [ds.EqualTo(kind, "revisit")])
    digest = F.regexp_replace("payload_digest", "^sha256:", "")
    found = whole.select("record_id", "record_type", F.length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest"), F.lit(None).cast("string").alias("refers_to"))
    found = found.unionByName(again.select("record_id", "record_type", F.col("payload_length").alias("payload_bytes"), digest.alias("payload_digest"), "refers_to"))
    return found.select(id_of(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type", id_of(F.col("refers_to")).alias("refers_to"))
