"""Archives: round trips, what is never unpacked, filters against plain reading, foreign archives, lost attempts."""

import gzip
import hashlib
import io
import json

import pytest
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quern.llm import warc


class Memory(io.BytesIO):
    def size(self):
        return len(self.getvalue())


def plain(pages):
    """What the contract says, row by row."""
    rows = [(k, ("" if h is None else h).encode()) for k, _, h in pages]
    out = []
    for k, body in rows:
        same = [x for x, b in rows if b == body and x is not None]
        again = len(body) >= 100 and bool(same) and k != min(same)
        out.append((k, len(body), hashlib.sha256(body).hexdigest(), "revisit" if again else "response", min(same) if again else None))
    return sorted(out, key=repr)


def test_pages_come_back(spark):
    long = "<p>" + "ä漢🙂 " * 100_000
    pages = [(1, "http://a/ b\r\nX: y", "x" * 100), (7, None, "x" * 100), (-(1 << 63), "u", "y" * 100), ((1 << 63) - 1, "u", "y" * 100), (5, "u", "z" * 99), (6, "u", "z" * 99),
             (8, "u", None), (9, "u", ""), (None, "u", "x" * 100), (None, "u", "only without ids" * 10), (None, "u", "only without ids" * 10), (3, "u", long), (4, "u", long), (11, "u", "d" * 200), (11, "u", "d" * 200), (12, "u", "WARC/1.1\r\n\r\n" * 20)]
    docs = spark.createDataFrame([(*p, "extra", 1) for p in pages], "page_id long, url string, html string, payload string, id int")
    got = warc.read_back(spark, warc.archive(docs.repartition(3))).collect()
    assert sorted(map(tuple, got), key=repr) == plain(pages)


def test_hot_groups_and_empty_tables(spark):
    hot = [(i, "u", "same " * 50) for i in range(1, 3001)] + [(5000 + i, "u", f"page {i} " * 20) for i in range(20)]
    docs = spark.createDataFrame(hot, "page_id long, url string, html string")
    assert sorted(map(tuple, warc.read_back(spark, warc.archive(docs)).collect()), key=repr) == plain(hot)
    assert warc.read_back(spark, warc.archive(docs.limit(0))).count() == 0


def _members(n):
    return [warc.record({"WARC-Record-ID": f"<urn:x:{i}>", "WARC-Type": ("response", "revisit", "request", "metadata")[i % 4], "WARC-Target-URI": f"http://h/{i}", "Content-Type": "application/http; msgtype=response" if i % 4 < 2 else "text/plain"}, warc.http(i) + b"b" * i * (i % 4 == 0)) for i in range(n)]


@pytest.mark.parametrize("pack", [warc.member, gzip.compress, bytes])
def test_archives_of_others(pack):
    """Members with lengths, members without, and plain records tell the same; refused ones are stepped over."""
    data = b"".join(map(pack, _members(300)))
    every = list(warc.read_records(Memory(data), lambda h: True, True))
    assert [h["warc-record-id"] for h, _ in every] == [f"<urn:x:{i}>" for i in range(300)]
    assert all(warc.payload(h, b) == ((i, b"b" * i) if i % 4 == 0 else (i, b"")) for i, (h, b) in enumerate(every) if i % 4 < 2)
    some = list(warc.read_records(Memory(data), lambda h: h["warc-type"] == "revisit", True))
    assert some == every[1::4]
    for cut in (len(data) - 30, 40):
        with pytest.raises(ValueError):
            list(warc.read_records(Memory(data[:cut]), lambda h: True, True))


def test_refused_members_are_not_unpacked():
    """With their lengths known, bytes behind a refused header may be anything."""
    import random

    big = random.Random(1).randbytes(400_000)
    spoiled = bytearray(warc.member(warc.record({"WARC-Type": "response"}, big)))
    spoiled[200_000:300_000] = b"\xff" * 100_000
    data = bytes(spoiled) + warc.member(warc.record({"WARC-Type": "revisit"}, b""))
    assert [h["warc-type"] for h, _ in warc.read_records(Memory(data), lambda h: h["warc-type"] != "response", True)] == ["revisit"]
    with pytest.raises(ValueError):
        list(warc.read_records(Memory(data), lambda h: True, True))


KIND, URI = ("record_type",), ("target_uri",)
ASKED = {
    "record_type = 'revisit'": [ds.EqualTo(KIND, "revisit")],
    "record_type in ('response', 'warcinfo')": [ds.In(KIND, ("response", "warcinfo"))],
    "not (record_type = 'response')": [ds.Not(ds.EqualTo(KIND, "response"))],
    "target_uri like 'http://h3/%'": [ds.StringStartsWith(URI, "http://h3/")],
    "target_uri is null": [ds.IsNull(URI)],
    "refers_to is not null and target_uri like '%1'": [ds.IsNotNull(("refers_to",)), ds.StringEndsWith(URI, "1")],
    "content_length > 150": [ds.GreaterThan(("content_length",), 150)],
    "not (target_uri like '%h2%')": [ds.Not(ds.StringContains(URI, "h2"))],
    "record_type <=> null": [ds.EqualNullSafe(KIND, None)],
}


def test_filters_are_pushed_and_right(spark):
    """Against Spark's own filters over all records, also where one table is used twice."""
    pages = spark.createDataFrame([(i, f"http://h{i % 7}/{i}", f"text {i % 50} " * 30) for i in range(400)], "page_id long, url string, html string")
    path = warc.archive(pages)
    table = warc.register(spark).read.format("warc").load(path)
    for where, filters in ASKED.items():
        pushed = warc.scan(spark, path, where=filters)
        assert "Filter (" not in pushed._jdf.queryExecution().executedPlan().toString()
        assert sorted(r.record_id for r in pushed.collect()) == sorted(r.record_id for r in table.where(where).collect()), where
    revisits, rest = (warc.scan(spark, path, where=[f]) for f in (ASKED["record_type = 'revisit'"][0], ASKED["not (record_type = 'response')"][0]))
    assert revisits.union(rest).count() == 2 * revisits.count() + table.where("record_type = 'warcinfo'").count()
    headers = revisits.select(F.col("headers")["warc-profile"]).distinct().collect()
    assert [r[0] for r in headers] == [warc.SAME_PAYLOAD]
    with pytest.raises(Exception, match="no header tells"):
        warc.scan(spark, path, where=[ds.EqualTo(("payload_length",), 3)]).count()


def test_sparks_own_pushdown(spark):
    """Where a session turns it on, a table that is loaded for one query gets its filters."""
    path = warc.archive(spark.createDataFrame([(i, "u", f"text {i % 50} " * 30) for i in range(400)], "page_id long, url string, html string"))
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        found = spark.read.format("warc").option("pushdown", "true").load(path).where("record_type = 'revisit'")
        assert "Filter (" not in found._jdf.queryExecution().executedPlan().toString() and found.count() == 350
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_only_headers_are_pushed():
    reader = warc.PushedReader({"path": "/nowhere"}, StructType.fromDDL(warc.SCHEMA))
    left = list(reader.pushFilters([ds.EqualTo(("record_type",), "response"), ds.GreaterThan(("payload_length",), 3), ds.Not(ds.IsNull(("refers_to",))), ds.EqualTo(("headers", "x"), "y")]))
    assert left == [ds.GreaterThan(("payload_length",), 3), ds.EqualTo(("headers", "x"), "y")]
    assert reader.wanted({"warc-type": "response", "warc-refers-to": "<x>"}) and not reader.wanted({"warc-type": "response"})


def test_lost_attempts_are_not_read(spark, tmp_path):
    """Files that no manifest names are left; small files share a task, and rolled files make several."""
    pages = spark.createDataFrame([(i, "u", hashlib.sha512(str(i).encode()).hexdigest() * 3 + " ".join(hashlib.sha512(f"{i} {j}".encode()).hexdigest() for j in range(40))) for i in range(60)], "page_id long, url string, html string")
    path = str(tmp_path / "archive")
    warc.records(pages.repartition(2)).write.format("warc").option("roll_bytes", 20_000).mode("append").save(path)
    named = json.loads(next(tmp_path.glob("archive/_manifest-*")).read_text())
    assert len(named) > 4
    (tmp_path / "archive" / "lost.warc.gz").write_bytes(warc.member(warc.record({"WARC-Type": "response", "WARC-Record-ID": "<urn:uuid:lost>"}, b"")))
    assert warc.read_back(spark, path).count() == 60
    source = spark.read.format("warc")
    assert source.load(path).rdd.getNumPartitions() < len(named) <= source.option("split_bytes", 1).load(path).rdd.getNumPartitions()
    warc.records(pages.limit(5)).write.format("warc").mode("overwrite").save(path)
    assert warc.read_back(spark, path).count() == 5 and not (tmp_path / "archive" / "lost.warc.gz").exists()
