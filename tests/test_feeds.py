"""Recorded answers: pages as partitions, chains of listings, acts, published files, messages."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from quern.sources import feeds, pages


def put(folder, **named):
    folder.mkdir(exist_ok=True)
    for name, page in named.items():
        (folder / f"{name}.json").write_text(json.dumps(page))
    return str(folder)


def listed(*keys):
    return [{"key": k, "size": len(k), "etag": f"e{k}"} for k in keys]


def test_listing_by_pages(spark, tmp_path):
    # names of files don't tell the order, tokens do
    at = put(tmp_path / "store", z={"contents": listed("a/1", "a/2"), "next": "t1"}, b={"token": "t1", "contents": listed("a/3", "b/1"), "next": "t2"}, a={"token": "t2", "contents": listed("c/1")})
    every = pages.scan(spark, "listing", at)
    assert every.rdd.getNumPartitions() == 3
    assert sorted(r.key for r in every.collect()) == ["a/1", "a/2", "a/3", "b/1", "c/1"]
    some = pages.scan(spark, "listing", at, prefix="b/")
    assert [tuple(r) for r in some.collect()] == [("b/1", 3, "eb/1")] and some.rdd.getNumPartitions() == 1
    assert pages.scan(spark, "listing", at, prefix="zz").count() == 0
    assert every.union(some).count() == 6  # each table keeps its own predicate


@pytest.mark.parametrize("lost, told", [("z", "first page"), ("b", "'t1' is missing"), ("a", "'t2' is missing")])
def test_a_listing_with_a_gap_is_an_error(spark, tmp_path, lost, told):
    named = {"z": {"contents": listed("a"), "next": "t1"}, "b": {"token": "t1", "contents": listed("b"), "next": "t2"}, "a": {"token": "t2", "contents": listed("c")}}
    at = put(tmp_path / "store", **{k: v for k, v in named.items() if k != lost})
    with pytest.raises(Exception, match=told):
        pages.scan(spark, "listing", at).collect()


def binding(c, **more):
    return {"c": {"value": c}} | {k: {"value": v} for k, v in more.items()}


def test_acts_by_pages(spark, tmp_path):
    at = put(tmp_path / "acts", p1={"results": {"bindings": [binding("32023R1805", force="1", title="Act one", basis="A1"), binding("32003L0087", force="0", cons="02003L0087-20240101")]}}, p2={"results": {"bindings": [binding("32015R0757", force="odd")]}}, p3={"results": {"bindings": []}})
    every = pages.scan(spark, "acts", at)
    assert every.rdd.getNumPartitions() == 3
    rows = {r.celex: r for r in every.collect()}
    assert [(rows[c].in_force, rows[c].consolidation, rows[c].title, rows[c].basis_article) for c in sorted(rows)] == [(False, "02003L0087-20240101", None, None), (None, None, None, None), (True, None, "Act one", "A1")]
    assert [r.celex for r in pages.scan(spark, "acts", at, celex=["32015R0757", "39999R9999"]).collect()] == ["32015R0757"]
    same = feeds.discovery_rows(spark, at)
    assert sorted(map(tuple, same.collect()), key=repr) == sorted(map(tuple, every.collect()), key=repr)
    assert feeds.acts_of_topic(every, "32023R1805") is every
    with pytest.raises(ValueError, match="39999R9999"):
        feeds.acts_of_topic(every, "39999R9999")
    wanted = spark.createDataFrame([("32015R0757",), ("32015R0757",), ("39999R9999",)], "celex string")
    assert [r.celex for r in feeds.cited_rows(every, wanted).collect()] == ["32015R0757"]


def test_published_files(spark, tmp_path):
    files = [{"period": 2023, "version": 4, "generationDate": "31-01-2024 23:59:59"}, {"period": 2024, "version": 1, "generationDate": "01-02-2025 00:00:00"}]
    at = put(tmp_path / "pages", a={"files": files[:1]}, b={"files": files[1:]})
    want = {(2023, 4, dt.date(2024, 1, 31)), (2024, 1, dt.date(2025, 2, 1))}
    got = pages.scan(spark, "files", at)
    assert {tuple(r) for r in got.collect()} == want and got.rdd.getNumPartitions() == 2
    assert [r.version for r in pages.scan(spark, "files", at, period=2024).collect()] == [1]
    (tmp_path / "lines").mkdir()
    (tmp_path / "lines" / "files.json").write_text("\n".join(map(json.dumps, files)))
    assert {tuple(r) for r in feeds.published_files(spark, str(tmp_path / "lines")).collect()} == want


def test_messages_there_and_back(spark):
    rows = spark.createDataFrame([("text", "two\nlines"), ("done", '{"a": 1}'), ("odd", "x")], "event string, data string")
    sent = rows.select(feeds.sse_frame(F.col("event"), F.col("data")).alias("message"))
    assert sent.first().message == "event: text\ndata: two\ndata: lines\n\n"
    assert sorted((r.event, r.data) for r in feeds.sse_events(sent, ("text", "done")).collect()) == [("done", '{"a": 1}'), ("text", "two\nlines")]


def test_no_pages(spark, tmp_path):
    at = put(tmp_path / "none")
    assert pages.scan(spark, "acts", at).count() == pages.scan(spark, "listing", at).count() == 0
