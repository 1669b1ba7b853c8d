"""Folds: batch against streams and against hand-worked cases."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from quern.sources import feeds
from quern.streaming import limits, turns


def calls(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "call_id long, client_id string, address string, ts_ms long")


def allowed(df):
    return [(r.allowed, r.wait_ms) for r in sorted(df.collect(), key=lambda r: r.call_id)]


def test_client_window(spark):
    got = allowed(limits.rate_limited(calls(spark, [("a", "x", t) for t in (0, 1, 2, 3, 4, 5, 59_999, 60_000, 60_001)])))
    assert got == [(True, 0)] * 5 + [(False, 59_995), (False, 1), (True, 0), (True, 0)]


def test_address_counts_over_clients_and_refusals_count_for_none(spark):
    rows = [(f"c{i}", "x", i) for i in range(20)] + [("new", "x", 30), (None, "y", 30), ("new", "y", 31)]
    got = allowed(limits.rate_limited(calls(spark, rows)))
    assert got[:20] == [(True, 0)] * 20 and got[20] == (False, 59_970) and got[21:] == [(True, 0)] * 2


def test_a_client_is_counted_over_its_addresses(spark):
    rows = [("roams", f"x{i % 3}", i) for i in range(7)] + [("other", "x0", 8), ("roams", "far", 59_999), ("roams", "far", 60_000)]
    got = allowed(limits.rate_limited(calls(spark, rows)))
    assert got == [(True, 0)] * 5 + [(False, 59_995), (False, 59_994), (True, 0), (False, 1), (True, 0)]


def test_against_plain_counting(spark):
    rng = random.Random(4)
    rows = sorted(((rng.choice([None, "", *(f"c{i}" for i in range(9))]), rng.choice([None, *(f"a{i}" for i in range(5))]), rng.randrange(400_000)) for _ in range(700)), key=lambda r: r[2])
    assert allowed(limits.rate_limited(calls(spark, rows))) == plain(rows)


def plain(rows, window=60_000):
    """Call by call, as one limiter would count them."""
    counted, want = {}, []
    for client, address, now in rows:
        at = address or "unknown"
        names = [("c", client) if client else ("n", at), ("a", at)]
        live = [[t for t in counted.get(n, []) if t > now - window] for n in names]
        waits = [x[0] + window - now for x, most in zip(live, (5, 20), strict=True) if len(x) >= most]
        if not waits:
            for n in names:
                counted.setdefault(n, []).append(now)
        want.append((not waits, max(waits, default=0)))
    return want


def test_one_giant_group_is_decided_name_by_name(spark, monkeypatch):
    """Shared addresses connect all calls; rounds settle them without bringing them together."""
    rng = random.Random(8)
    rows = sorted(((f"c{rng.randrange(400)}", f"a{rng.randrange(150)}", rng.randrange(300_000)) for _ in range(12_000)), key=lambda r: r[2])
    monkeypatch.setattr(limits, "_in_order", lambda calls: pytest.fail("not needed here"))
    assert allowed(limits.rate_limited(calls(spark, rows))) == plain(rows)
    state = limits._named(calls(spark, rows)).select("call_id", "ts_ms", "client", "address", *(F.lit(limits.OPEN).alias(c) for c in ("by_client", "by_address")), *(F.lit(0).cast("long").alias(c) for c in ("client_wait", "address_wait")))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # this table is small enough to be read by one task
    sizes = [r[0] for r in limits._looked_at(state.repartition(1), "address", 20, 60_000).groupBy(F.spark_partition_id()).count().select("count").collect()]
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert max(sizes) <= 2 * len(rows) / 4  # four partitions


def test_limits_that_bind_everywhere_are_settled_in_order(spark):
    """Few clients at few addresses, both over their limits: rounds would settle a window at a time."""
    rng = random.Random(9)
    rows = sorted(((rng.choice([None, *(f"c{i}" for i in range(25))]), f"a{rng.randrange(5)}", rng.randrange(1_500_000)) for _ in range(6_000)), key=lambda r: r[2])
    assert allowed(limits.rate_limited(calls(spark, rows))) == plain(rows)


def test_no_calls(spark):
    assert limits.rate_limited(calls(spark, [("a", "x", 0)]).limit(0)).count() == 0


class Feed:
    """A folder that a stream reads file by file; each run goes on from the same checkpoint and tells the rows of its state."""

    def __init__(self, spark, tmp_path, rows, build, keep="append"):
        self.spark, self.at, self.rows, self.build, self.n = spark, tmp_path, rows, build, 0
        (tmp_path / "in").mkdir()

    def run(self, *wheres):
        for w in wheres:
            self.rows.where(w).coalesce(1).write.mode("append").parquet(str(self.at / "in"))
        stream = self.spark.readStream.schema(self.rows.schema).option("maxFilesPerTrigger", 1).parquet(str(self.at / "in"))
        q = self.build(stream).writeStream.format("parquet").option("path", str(self.at / "out")).option("checkpointLocation", str(self.at / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(200)
        assert q.exception() is None
        ops = [o for p in q.recentProgress for o in p["stateOperators"]]
        self.state = ops[-1]["numRowsTotal"] if ops else None
        self.late = sum(o["numRowsDroppedByWatermark"] for o in ops)
        return self

    def told(self):
        return self.spark.read.parquet(str(self.at / "out"))


FAR = 10**8


def test_limits_of_a_stream_equal_those_of_a_batch(spark, tmp_path):
    """Rows that come out of order, in several runs, are counted in order; state ends a window after the last call."""
    rng = random.Random(5)
    rows = [(rng.choice([None, "", *(f"c{i}" for i in range(6))]), f"x{i % 3}", i * 700 + rng.randrange(20_000)) for i in range(300)] + [("end", f"x{i}", FAR) for i in range(3)] + [("later", "x0", FAR + 10**6)]
    batch = calls(spark, rows)
    by_site = lambda s: limits.rate_limited_stream(s.withColumn("site", F.lit("s")), "site")
    feed = Feed(spark, tmp_path, batch, by_site)
    feed.run("call_id < 100").run("call_id >= 100 and call_id < 200", "call_id >= 200 and call_id < 300")
    assert feed.state > 0 and feed.late == 0
    feed.run(f"call_id >= 300 and ts_ms = {FAR}", f"ts_ms > {FAR}")
    told = feed.told()
    assert allowed(told.where("call_id < 300")) == allowed(limits.rate_limited(batch))[:300]
    assert feed.state <= 3  # what the last call's own window keeps


def test_answers_of_a_stream(spark, tmp_path):
    rng = random.Random(6)
    rows = [(i, f"k{rng.randrange(9)}", i * 7 + rng.randrange(30), rng.random() < 0.6) for i in range(300)] + [(1000, "end", FAR, False), (1001, "end", FAR + 10**6, False)]
    batch = spark.createDataFrame(rows, "request_id long, key string, ts long, storable boolean")
    feed = Feed(spark, tmp_path, batch, lambda s: limits.cached_answers_stream(s, 100, "40 seconds"))
    feed.run("request_id < 120").run("request_id >= 120 and request_id < 300")
    assert feed.state > 0
    feed.run("request_id = 1000", "request_id = 1001")
    want = {r.request_id: r.hit for r in limits.cached_answers(batch, 100).collect()}
    assert {r.request_id: r.hit for r in feed.told().where("request_id < 1000").collect()} == {k: v for k, v in want.items() if k < 1000}
    assert feed.state <= 2  # all answers have expired; the last request itself still waits


def test_a_late_row_is_dropped_and_changes_nothing(spark, tmp_path):
    rows = [(1, "k", 1000, True), (2, "k", 1500, True), (3, "k", 1010, True), (4, "k", 1560, False), (5, "end", FAR, False), (6, "end", FAR + 10**6, False)]
    batch = spark.createDataFrame(rows, "request_id long, key string, ts long, storable boolean")
    feed = Feed(spark, tmp_path, batch, lambda s: limits.cached_answers_stream(s, 100, "40 seconds")).run("request_id <= 2").run("request_id = 3").run("request_id = 4", "request_id = 5", "request_id = 6")
    assert {r.request_id: r.hit for r in feed.told().collect()} == {1: False, 2: False, 4: True, 5: False}


def test_trust_of_a_stream(spark, tmp_path):
    rng = random.Random(7)
    rows = [(i, rng.choice([None, "", "c1", "c2", "c3"]), i * 7 + rng.randrange(30), rng.choice([None, True, False])) for i in range(200)] + [(1000, "end", FAR, None), (1001, "end", FAR + 10**6, None)]
    batch = spark.createDataFrame(rows, "request_id long, client_id string, ts long, vouched boolean")
    feed = Feed(spark, tmp_path, batch, lambda s: limits.client_trust_stream(s, 100, "40 seconds")).run("request_id < 90").run("request_id >= 90 and request_id < 200").run("request_id = 1000", "request_id = 1001")
    want = {r.request_id: (r.allowed, r.asked) for r in limits.client_trust(batch, 100).collect()}
    assert {r.request_id: (r.allowed, r.asked) for r in feed.told().where("request_id < 1000").collect()} == {k: v for k, v in want.items() if k < 1000}
    assert feed.state <= 2


def test_turns_of_a_stream(spark, tmp_path):
    """The last state of each turn is the batch's; turns end when they have been idle."""
    runs = spark.createDataFrame([(i, ["retrieve", "synthesize"], ["s"], f"some words of {i} ", f"r{i}", None if i % 3 else "boom") for i in range(8)], "turn_id long, steps array<string>, sources array<string>, answer string, request_id string, error string")
    events = turns.run_events(runs).withColumn("at", F.timestamp_seconds(F.col("seq") * 3))
    end = spark.createDataFrame([(99, 0, "text", '"x"', FAR), (99, 1, "text", '"x"', FAR + 10**6)], "turn_id long, seq int, event string, data string, s long").select("turn_id", "seq", "event", "data", F.timestamp_seconds("s").alias("at"))
    every = events.unionByName(end)
    feed = Feed(spark, tmp_path, every, lambda s: turns.folded_turns_stream(s, late="5 seconds", idle_seconds=60)).run("turn_id < 99 and seq % 2 = 0", "turn_id < 99 and seq % 2 = 1").run("turn_id = 99 and seq = 0", "turn_id = 99 and seq = 1")
    told = {}
    for r in feed.told().where("turn_id < 99").collect():
        if len(r.steps) + len(r.answer) + (r.status in ("settled", "failed")) * 1000 >= told.get(r.turn_id, (-1,))[0]:
            told[r.turn_id] = (len(r.steps) + len(r.answer) + (r.status in ("settled", "failed")) * 1000, tuple(r))
    want = {r.turn_id: tuple(r) for r in turns.folded_turns(events).collect()}
    assert {k: v[1] for k, v in told.items()} == want or feed.late > 0
    assert feed.late == 0 and feed.state <= 2


def test_spend_windows_on_a_stream(spark, tmp_path):
    rows = [(i, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=i * 977), (i % 7) / 4 if i % 5 else None) for i in range(150)] + [(999, dt.datetime(2024, 3, 1), 0.0), (1000, dt.datetime(2024, 4, 1), 0.0)]
    batch = spark.createDataFrame(rows, "id long, created_at timestamp, cost_usd double")
    feed = Feed(spark, tmp_path, batch, lambda s: limits.spend_windows(s, 20.0)).run("id < 70", "id >= 70 and id < 999").run("id = 999", "id = 1000")
    want = {tuple(r) for r in limits.spend_windows(batch.where("id < 999"), 20.0).collect()}
    assert {tuple(r) for r in feed.told().where("window_end < '2024-02-15'").collect()} == want
    assert feed.state <= 48


def test_answers_expire_and_hits_do_not_renew(spark):
    rows = [(0, "k", 0, True), (1, "k", 50, True), (2, "k", 99, True), (3, "k", 100, False), (4, "k", 150, True), (5, "k", 200, True), (6, "j", 10, False), (7, "j", 20, True)]
    got = limits.cached_answers(spark.createDataFrame(rows, "request_id long, key string, ts long, storable boolean"), 100).collect()
    assert [r.hit for r in sorted(got)] == [False, True, True, False, False, True, False, False]


def test_trust_lasts_from_the_check_that_earned_it(spark):
    rows = [(0, "c", 0, None), (1, "c", 1, False), (2, "c", 2, True), (3, "c", 101, False), (4, "c", 102, False), (5, "c", 103, True), (6, None, 3, True), (7, None, 4, False), (8, "", 5, None)]
    got = limits.client_trust(spark.createDataFrame(rows, "request_id long, client_id string, ts long, vouched boolean"), 100).collect()
    assert [(r.allowed, r.asked) for r in sorted(got)] == [(True, True), (False, True), (True, True), (True, False), (False, True), (True, True), (True, True), (False, True), (True, True)]


def test_spend_cap_against_plain_sums(spark):
    rows = [(i, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=i * 977), (i % 7) / 4 if i % 5 else None) for i in range(300)]
    got = {r.id: r.spend_usd for r in limits.over_cap(spark.createDataFrame(rows, "id long, created_at timestamp, cost_usd double"), 20.0).collect()}
    for i, t, _ in rows:
        want = sum(c or 0 for _, u, c in rows if t - dt.timedelta(days=1) <= u <= t)
        assert abs(got[i] - want) < 1e-9, i


def turn(spark, events):
    rows = [(1, i, e, json.dumps(d)) for i, (e, d) in enumerate(events)]
    return turns.folded_turns(spark.createDataFrame(rows, "turn_id long, seq long, event string, data string")).collect()[0]


def test_turns(spark):
    run = {"step": "retrieve", "status": "running"}
    done = {"step": "retrieve", "status": "completed"}
    got = turn(spark, [("step", run), ("step", run), ("step", done), ("sources", [1, 2]), ("text", "a"), ("text", "b"), ("noise", 1), ("done", {"request_id": "r"})])
    assert (got.status, got.answer, got.sources, got.request_id) == ("settled", "ab", 2, "r")
    assert got.steps == ["retrieve:completed", "retrieve:running"]
    got = turn(spark, [("step", run), ("step", done), ("step", run), ("error", {"error": "boom"}), ("done", {"request_id": "r"})])
    assert (got.status, got.steps, got.error, got.request_id) == ("failed", ["retrieve:completed"], "boom", None)


def test_threads(spark):
    rows = [(1, "ask", None), (2, "text", '"x"'), (3, "done", '{"thread_id": "t"}')]
    actions = [(7, 0, "text", '"lost"')] + [(7, s, a, d) for s, a, d in rows if a != "text"] + [(8, 0, "ask", None), (8, 1, "fail", "{}"), (8, 2, "ask", None)]
    got = {r.tab_id: r for r in turns.folded_threads(spark.createDataFrame(actions, "tab_id long, seq long, action string, data string")).collect()}
    assert (got[7].thread_id, got[7].turns, got[7].last_status) == ("t", 1, "settled")
    assert (got[8].thread_id, got[8].turns, got[8].last_status) == (None, 1, "pending")


def test_runs_to_events_and_back(spark):
    runs = spark.createDataFrame([(1, ["retrieve", "synthesize"], ["s1"], 'a "b"\nc ', "r", None), (2, ["retrieve"], [], None, None, "boom")], "turn_id long, steps array<string>, sources array<string>, answer string, request_id string, error string")
    got = {r.turn_id: r for r in turns.folded_turns(turns.run_events(runs)).collect()}
    assert (got[1].status, got[1].answer, got[1].sources, got[1].request_id) == ("settled", 'a "b"\nc ', 1, "r")
    assert (got[2].status, got[2].error, got[2].steps) == ("failed", "boom", ["retrieve:completed"])


def test_ledger_rows_once(spark, tmp_path):
    write = turns.ledger_once(str(tmp_path / "ledger"))
    one = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2)], "request_id string, ms int")
    write(one, 0)
    write(one, 0)
    write(spark.createDataFrame([("b", 3), ("c", 4)], "request_id string, ms int"), 1)
    assert sorted(r.request_id for r in spark.read.parquet(str(tmp_path / "ledger")).collect()) == ["a", "b", "c"]


RUN = "turn_id long, steps array<string>, sources array<string>, answer string, request_id string, error string"


def test_frames_and_ledger_rows_once_through_a_failed_attempt(spark, tmp_path):
    """A batch that ends between its two writes is written again as a whole; a client reads each frame once, as it was sent."""
    runs = [(i, ["retrieve"], ["s"] if i % 2 else [], f'say "{i}"\nand more', f"r{i}", "boom" if i == 3 else None) for i in range(6)]
    given = spark.createDataFrame([*runs, runs[1], (9, ["retrieve"], [], "sent before", "r0", None)], RUN)
    for ids in ("turn_id < 3", "turn_id >= 3"):
        given.where(ids).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    frames, ledger = str(tmp_path / "frames"), str(tmp_path / "ledger")
    send, whole = turns.frames_once(frames, ledger), turns.answer_sink(frames, ledger)
    seen = []

    def broken(batch, number):
        seen.append(number)
        if number == 1:
            send(batch, number)
            raise RuntimeError("lost between the writes")
        whole(batch, number)

    def run(sink):
        stream = spark.readStream.schema(given.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        return stream.writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()

    with pytest.raises(Exception, match="lost between"):
        run(broken).awaitTermination(120)
    assert seen == [0, 1] and spark.read.parquet(frames).where("batch = 1").count() > 0
    assert turns.sent_frames(spark, frames, ledger).where("batch = 1").count() == 0
    run(whole).awaitTermination(120)
    assert sorted(r.request_id for r in spark.read.parquet(ledger).collect()) == [f"r{i}" for i in range(6)]
    want = [(r.turn_id, r.seq, r.event, r.data) for r in turns.run_events(spark.createDataFrame(runs, RUN)).collect()]
    told = turns.sent_frames(spark, frames, ledger)
    got = feeds.sse_events(told.drop("event"), turns.EVENTS, "frame").collect()
    assert sorted((r.turn_id, r.seq, r.event, r.data) for r in got) == sorted(want)
    assert feeds.sse_events(spark.createDataFrame([("event: ping\ndata: x",)], "message string"), turns.EVENTS).count() == 0
