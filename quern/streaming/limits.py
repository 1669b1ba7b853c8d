"""Rate limits, spend caps and answers that are kept for a while, as folds over ordered events."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.streaming.folds import Fold, Step, fold, ordered_stream
from quern.streaming.groups import connected, shared

#: The window and the calls that a client and an address may make in it; how long answers and trust are kept.
WINDOW_MS, PER_CLIENT, PER_ADDRESS = 60_000, 5, 20
ANSWER_SECONDS, TRUST_SECONDS = 7 * 86_400, 86_400

_LIMITED = "call_id long, allowed boolean, wait_ms long"


class Slots:
    """The calls that count just now, by name, in order of time; calls are added in that order."""

    def __init__(self, window: int = WINDOW_MS, per_client: int = PER_CLIENT, per_address: int = PER_ADDRESS):
        self.window, self.per_client, self.per_address = window, per_client, per_address
        self.of: dict[str, deque[int]] = {}
        self.order: deque[tuple[int, str]] = deque()

    def add(self, name: str, at: int) -> None:
        self.of.setdefault(name, deque()).append(at)
        self.order.append((at, name))

    def expire(self, now: int) -> None:
        """Calls as old as the window go; each goes once."""
        while self.order and self.order[0][0] <= now - self.window:
            _, name = self.order.popleft()
            self.of[name].popleft()
            if not self.of[name]:
                del self.of[name]

    def take(self, client: str, address: str, now: int) -> int:
        """Milliseconds to wait, 0 if the call may go ahead and is now counted.

        Both the client's and the address's calls are looked at before either is counted, so a refused call counts for
        neither, and the longer wait is told.
        """
        self.expire(now)
        full = [live[0] + self.window - now for name, most in ((client, self.per_client), (address, self.per_address)) if len(live := self.of.get(name, ())) >= most]
        if full:
            return max(full)
        self.add(client, now)
        self.add(address, now)
        return 0


def _step(slots: Slots, row: dict) -> tuple[Slots, list[dict]]:
    wait = slots.take(row["client"], row["address"], int(row["ts_ms"]))
    return slots, [{"call_id": row["call_id"], "allowed": wait == 0, "wait_ms": wait}]


def _named(calls: DataFrame) -> DataFrame:
    """The calls with the names that they count for; one without a client counts as its address, under a name that no client can have."""
    address = F.concat(F.lit("address:"), F.coalesce("address", F.lit("unknown")))
    client = F.concat(F.lit("client:"), F.when(F.col("client_id") != "", F.col("client_id")))
    return calls.withColumn("address", address).withColumn("client", F.coalesce(client, F.concat(F.lit("anonymous:"), "address")))


#: What is known of a call at one of its names: refused, has room, or not yet known.
NO, ROOM, OPEN = 0, 1, 2
#: Calls that are still open are worked through again while a round leaves at most this share of them open.
WORTH = 0.8
_CALL = "call_id long, ts_ms long, client string, address string, by_client int, by_address int, client_wait long, address_wait long"


def _looked_at(calls: DataFrame, name: str, most: int, window: int) -> DataFrame:
    """The calls with what their own name (client or address) says of each, as far as the other name's word is known.

    A pass over a name's calls in order of time, with the calls of one window in hand: those that certainly count, and those
    that may. A name is full when enough certainly count, and has room when too few even may.
    """
    own, other = f"by_{name}", "by_address" if name == "client" else "by_client"
    columns = calls.columns

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: str | None = None
        sure: deque[int] = deque()
        may: deque[int] = deque()
        for frame in frames:
            words, waits = [], []
            for key, at, elsewhere in zip(frame[name].tolist(), frame["ts_ms"].tolist(), frame[other].tolist(), strict=True):
                if key != held:
                    held = key
                    sure.clear()
                    may.clear()
                for live in (sure, may):
                    while live and live[0] <= at - window:
                        live.popleft()
                # no more than `most` ever count, so where so many certainly do, those are all
                word = NO if len(sure) >= most else ROOM if len(sure) + len(may) < most else OPEN
                words.append(word)
                waits.append(sure[0] + window - at if word == NO else 0)
                if word != NO and elsewhere != NO:
                    (sure if word == elsewhere == ROOM else may).append(at)
            yield frame.assign(**{own: words, f"{name}_wait": waits})[columns]

    return calls.repartition(name).sortWithinPartitions(name, "ts_ms", "call_id").mapInPandas(run, _CALL)


def _open() -> Column:
    refused = (F.col("by_client") == NO) | (F.col("by_address") == NO)
    return ~refused & ((F.col("by_client") == OPEN) | (F.col("by_address") == OPEN))


def _in_order(calls: DataFrame) -> DataFrame:
    """The calls, the open ones settled by the groups of names that open calls connect; what is known stays and counts."""
    left = calls.where(_open())
    groups = connected(left.select(F.col("client").alias("a"), F.col("address").alias("b"))).select(F.col("node").alias("name"), "group")
    known = calls.where((F.col("by_client") == ROOM) & (F.col("by_address") == ROOM))
    counting = known.select("call_id", "ts_ms", F.explode(F.array("client", "address")).alias("name")).join(groups, "name")
    asked = left.join(groups.withColumnRenamed("name", "address"), "address").select("call_id", "ts_ms", "client", "address", "group")
    rows = asked.unionByName(counting.select("call_id", "ts_ms", F.lit(None).cast("string").alias("client"), F.col("name").alias("address"), "group"))

    def step(slots: Slots, row: dict) -> tuple[Slots, list[dict]]:
        if row["client"] is None:
            slots.expire(int(row["ts_ms"]))
            slots.add(row["address"], int(row["ts_ms"]))
            return slots, []
        slots, made = _step(slots, row)
        return slots, [{"call_id": m["call_id"], "granted": m["allowed"]} for m in made]

    settled = fold(rows, "group", ["ts_ms", "call_id"], Slots, step, None, "call_id long, granted boolean", ["call_id", "granted"])
    word = F.when(F.col("granted"), ROOM).when(~F.col("granted"), NO)
    return calls.join(settled, "call_id", "left").withColumns({c: F.coalesce(word, F.col(c)) for c in ("by_client", "by_address")}).drop("granted")


def rate_limited(calls: DataFrame) -> DataFrame:
    """call_id, allowed, wait_ms of calls (call_id, client_id, address, ts_ms); call_ids are distinct.

    A client is counted over all addresses, and an address over all clients, so whether a call is allowed hangs on the calls
    before it at both of its names, and on those before them. All names decide at once, in rounds: clients say what is certain
    by what addresses have said so far, then addresses by what clients have, until no call is open. So calls that addresses
    and clients connect need not come together; one name's calls do, as a stream that is passed once with a window in hand
    (a name with many calls a window is over its limit, and each call hangs on the one before).

    Where both limits bind everywhere, a round settles few calls. When one leaves more than `WORTH` of the open ones open, those
    alone are settled in order, by the groups that they connect.
    """
    state = _named(calls).select("call_id", "ts_ms", "client", "address", *(F.lit(OPEN).alias(c) for c in ("by_client", "by_address")), *(F.lit(0).cast("long").alias(c) for c in ("client_wait", "address_wait")))
    shared(calls.sparkSession)
    before = None
    while True:
        # a refused call counts for no name: it need not come along
        state = _looked_at(_looked_at(state, "client", PER_CLIENT, WINDOW_MS), "address", PER_ADDRESS, WINDOW_MS).checkpoint()
        left = state.where(_open()).count()
        if not left:
            break
        if before is not None and left > WORTH * before:
            state = _in_order(state)
            break
        before = left
    # once all is known, another pass tells each name's wait
    told = _looked_at(_looked_at(state, "client", PER_CLIENT, WINDOW_MS), "address", PER_ADDRESS, WINDOW_MS)
    wait = F.greatest("client_wait", "address_wait")
    return told.select("call_id", (wait == 0).alias("allowed"), wait.alias("wait_ms"))


def rate_limited_stream(calls: DataFrame, by: str = "address", late: str = "1 minute") -> DataFrame:
    """The same over a stream, whose states are kept by a column `by`, for a window after the last call.

    A stream can't know which addresses a client will use: it is exact where the values of `by` share neither clients nor
    addresses, as sites or regions do; by address, a client that roams is counted at each of its addresses.
    """

    def unpack(entries: list[tuple]) -> Slots:
        slots = Slots()
        for name, at in sorted(entries, key=lambda e: e[1]):
            slots.add(name, at)
        return slots

    kept = Fold(Slots, _step, "name string, at long", lambda s: [(n, t) for t, n in s.order], unpack, lambda s: s.order[-1][0] + s.window if s.order else None)
    named = _named(calls)
    rows = named.select(F.col(by).alias("kept_by"), "call_id", "ts_ms", "client", "address")
    return ordered_stream(rows, "kept_by", ["call_id"], F.timestamp_millis("ts_ms"), kept, _LIMITED, ["call_id", "allowed", "wait_ms"], late)


def _until(seconds: int = 0) -> dict:
    """How a stream keeps a moment, in seconds: as one entry, for `seconds` from then on."""
    return {"entries": "at long", "pack": lambda s: [] if s is None else [(s,)], "unpack": lambda e: e[0][0] if e else None, "until": lambda s: None if s is None else (s + seconds) * 1000}


def _kept(seconds: int) -> Step:
    def step(kept: int | None, row: dict) -> tuple[int | None, list[dict]]:
        ts = int(row["ts"])
        hit = kept is not None and ts < kept + seconds
        return (ts if row["storable"] and not hit else kept), [{"request_id": row["request_id"], "hit": hit}]

    return step


def cached_answers(requests: DataFrame, seconds: int = ANSWER_SECONDS) -> DataFrame:
    """request_id, hit of requests (request_id, key, ts, storable): whether an answer stored in the last seconds is there.

    A storable request that misses stores its answer from then on; one that hits doesn't renew it.
    """
    return fold(requests, "key", ["ts", "request_id"], lambda: None, _kept(seconds), None, "request_id long, hit boolean", ["request_id", "hit"])


def cached_answers_stream(requests: DataFrame, seconds: int = ANSWER_SECONDS, late: str = "1 minute") -> DataFrame:
    """The same over a stream; an answer's state goes when it is `seconds` old."""
    rows = requests.select("key", "request_id", "ts", "storable")
    return ordered_stream(rows, "key", ["request_id"], F.timestamp_seconds("ts"), Fold(lambda: None, _kept(seconds), **_until(seconds)), "request_id long, hit boolean", ["request_id", "hit"], late)


_TRUST = "request_id long, allowed boolean, asked boolean"


def _trust(seconds: int) -> Step:
    def step(until: int | None, row: dict) -> tuple[int | None, list[dict]]:
        ts, verdict = int(row["ts"]), row["vouched"]
        trusted = until is not None and ts < until
        if not trusted and verdict and row["client_id"]:
            until = ts + seconds
        # a check that can't be made (no verdict) lets the request through, but earns no trust
        return until, [{"request_id": row["request_id"], "allowed": trusted or verdict is None or bool(verdict), "asked": not trusted}]

    return step


def _clients(requests: DataFrame) -> DataFrame:
    """With the key of a request's trust: its client, or itself without one."""
    return requests.withColumn("trust_key", F.coalesce(F.concat(F.lit("client:"), F.when(F.col("client_id") != "", F.col("client_id"))), F.concat(F.lit("request:"), F.col("request_id").cast("string"))))


def client_trust(requests: DataFrame, seconds: int = TRUST_SECONDS) -> DataFrame:
    """request_id, allowed, asked of requests (request_id, client_id, ts, vouched): a client that passed a check in the last
    seconds isn't asked again; vouched is what a check says of the request's token, null if it couldn't be made."""
    return fold(_clients(requests), "trust_key", ["ts", "request_id"], lambda: None, _trust(seconds), None, _TRUST, ["request_id", "allowed", "asked"])


def client_trust_stream(requests: DataFrame, seconds: int = TRUST_SECONDS, late: str = "1 minute") -> DataFrame:
    """The same over a stream; a client's state goes when its trust ends."""
    rows = _clients(requests).select("trust_key", "request_id", "client_id", "ts", "vouched")
    return ordered_stream(rows, "trust_key", ["request_id"], F.timestamp_seconds("ts"), Fold(lambda: None, _trust(seconds), **_until()), _TRUST, ["request_id", "allowed", "asked"], late)


def spend_windows(ledger: DataFrame, cap: float, late: str = "1 hour") -> DataFrame:
    """window_end, spend_usd, over: the spend of each day that ends on an hour. The same expression in batch and on a stream,
    where a day is told once nothing can come into it any more (`late` after its end)."""
    day = F.window("created_at", "24 hours", "1 hour")
    spent = ledger.withWatermark("created_at", late).groupBy(day.alias("day")).agg(F.sum(F.coalesce("cost_usd", F.lit(0.0))).alias("spend_usd"))
    return spent.select(F.col("day.end").alias("window_end"), "spend_usd", (F.col("spend_usd") >= cap).alias("over"))


def over_cap(ledger: DataFrame, cap: float, seconds: int = 86_400) -> DataFrame:
    """Requests with the spend of all requests in the day before them, and whether it has reached the cap.

    A sum over everything in time order would be one task's work; costs are summed by second and by hour first. A second adds
    the whole hours within the day, its own hour's part up to it and the oldest hour's part from it on; both parts are running
    sums over an hour's seconds, of which there are at most 3,600 however many requests come.
    """
    second = F.col("created_at").cast("timestamp").cast("long")
    rows = ledger.select("id", second.alias("t"), F.coalesce("cost_usd", F.lit(0.0)).alias("cost"))
    spent = rows.groupBy("t").agg(F.sum("cost").alias("cost")).withColumn("hour", F.floor(F.col("t") / 3600))
    span = seconds // 3600
    hours = spent.groupBy("hour").agg(F.sum("cost").alias("cost"))
    within = F.explode(F.sequence(F.col("hour") + 1, F.col("hour") + span - 1))
    whole = hours.select(within.alias("hour"), "cost").groupBy("hour").agg(F.sum("cost").alias("whole"))
    come = spent.select("hour", "t", F.col("cost").alias("come"), F.lit(0.0).alias("gone"), F.lit(True).alias("own"))
    left = spent.where("t is not null").select((F.col("hour") + span).alias("hour"), (F.col("t") + seconds).alias("t"), F.lit(0.0).alias("come"), F.col("cost").alias("gone"), F.lit(False).alias("own"))
    by_hour = W.partitionBy("hour").orderBy("t")
    sums = come.unionByName(left).select("hour", "t", "own", F.sum("come").over(by_hour.rangeBetween(W.unboundedPreceding, 0)).alias("newest"), F.sum("gone").over(by_hour.rangeBetween(0, W.unboundedFollowing)).alias("oldest"))
    total = F.col("newest") + F.coalesce("whole", F.lit(0.0)) + F.col("oldest")
    told = sums.where("own").join(whole, "hour", "left").select("t", total.alias("spend_usd"))
    return rows.join(told.withColumnRenamed("t", "at"), F.col("t").eqNullSafe(F.col("at")), "left").select("id", "spend_usd", (F.col("spend_usd") >= cap).alias("over"))
