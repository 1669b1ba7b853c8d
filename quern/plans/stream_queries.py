"""Batch twins of the streaming operators, over events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import display
from quern.operators import tools
from quern.plans.tables import LEDGER, ledger, table
from quern.streaming import limits, turns


def rate_limited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls by users from addresses that several share; an order-dependent fold, so held by hand-worked cases."""
    e = table(spark, sf_dir, "events")
    calls = e.select(F.col("event_id").alias("call_id"), F.when(F.col("event_id") % 9 != 0, F.col("user_id").cast("string")).alias("client_id"), F.concat(F.lit("a"), (F.col("user_id") % 8).cast("string")).alias("address"), (F.unix_millis(F.col("ts").cast("timestamp")) / 200).cast("long").alias("ts_ms"))
    return limits.rate_limited(calls)


def cached_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    asked = e.select(F.col("event_id").alias("request_id"), (F.col("user_id") % 50).cast("string").alias("key"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("ts"), (F.col("event_id") % 3 != 0).alias("storable"))
    return limits.cached_answers(asked)


def spend_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return limits.over_cap(ledger(spark, sf_dir), 2000.0).select("id", F.round("spend_usd", 3).alias("spend_usd"))


SPEND_CAP = f"""WITH {LEDGER} SELECT id, round(coalesce(sum(cost_usd) OVER (ORDER BY CAST(floor(epoch(created_at)) AS BIGINT) RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW), 0), 3) AS spend_usd FROM ledger"""


def spend_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return limits.spend_windows(ledger(spark, sf_dir), 2000.0).select("window_end", F.round("spend_usd", 3).alias("spend_usd"))


SPEND_WINDOWS = f"""WITH {LEDGER}, w AS (SELECT coalesce(cost_usd, 0) AS cost, unnest(range(0, 24)) AS i, time_bucket(INTERVAL 1 HOUR, created_at, TIMESTAMP '1970-01-01') AS hour FROM ledger)
    SELECT hour + INTERVAL 1 HOUR * (i + 1) AS window_end, round(sum(cost), 3) AS spend_usd FROM w GROUP BY 1"""


def trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests of clients that are vouched for, or not, or can't be; trust lasts a day from the check that earned it."""
    asked = table(spark, sf_dir, "events").selectExpr("event_id AS request_id", "CASE WHEN event_id % 9 <> 0 THEN string(user_id) END AS client_id", "unix_seconds(cast(ts AS timestamp)) AS ts", "CASE WHEN event_id % 5 = 0 THEN CAST(NULL AS boolean) ELSE event_id % 5 < 3 END AS vouched")
    return limits.client_trust(asked)


def turns_of_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs to events and back to turns."""
    c = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    k = F.col("conv_id") * 1000 + F.col("turn")
    runs = c.select(k.alias("turn_id"), F.array(F.lit("retrieve"), F.lit("synthesize")).alias("steps"), F.array(F.lit("s")).alias("sources"), F.col("text").alias("answer"), k.cast("string").alias("request_id"), F.when(k % 7 == 0, "boom").alias("error"))
    return turns.folded_turns(turns.run_events(runs)).select("turn_id", "status", F.md5("answer").alias("answer"), F.array_join("steps", ",").alias("steps"), "sources", "request_id", "error")


TURNS_OF_RUNS = """SELECT conv_id * 1000 + turn AS turn_id, CASE WHEN (conv_id * 1000 + turn) % 7 = 0 THEN 'failed' ELSE 'settled' END AS status, md5(text) AS answer, 'retrieve:completed,synthesize:completed' AS steps, 1 AS sources,
    CASE WHEN (conv_id * 1000 + turn) % 7 <> 0 THEN CAST(conv_id * 1000 + turn AS VARCHAR) END AS request_id, CASE WHEN (conv_id * 1000 + turn) % 7 = 0 THEN 'boom' END AS error FROM conversations WHERE role = 'assistant'"""


def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beyond the reference: tumbling windows of six hours, the same expression on a stream with a watermark."""
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.window("ts", "6 hours").alias("w"), "event_type").agg(F.count("*").alias("events"), F.round(F.sum("value"), 4).alias("value")).select(F.col("w.start").alias("window_start"), "event_type", "events", "value")


EVENT_WINDOWS = "SELECT time_bucket(INTERVAL 6 HOURS, ts, TIMESTAMP '1970-01-01') AS window_start, event_type, count(*) AS events, round(sum(value), 4) AS value FROM events GROUP BY ALL"


def step_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    step = F.element_at(F.array(*map(F.lit, ("retrieve", "assess", "odd"))), (F.col("event_id") % 3 + 1).cast("int"))
    return e.select("event_id", display.step_label(step, F.when(F.col("event_id") % 2 == 0, "running").otherwise("completed")).alias("label"), display.short_ms((F.col("event_id") * 7 % 5000).cast("double")).alias("took"))


STEP_LABELS = """SELECT event_id, CASE event_id % 3 WHEN 0 THEN CASE WHEN event_id % 2 = 0 THEN 'Searching the corpus' ELSE 'Searched the corpus' END WHEN 1 THEN CASE WHEN event_id % 2 = 0 THEN 'Reviewing the evidence' ELSE 'Reviewed the evidence' END ELSE 'odd' END AS label,
    CASE WHEN event_id * 7 % 5000 < 1000 THEN CAST(event_id * 7 % 5000 AS VARCHAR) || 'ms' ELSE CAST(t // 10 AS VARCHAR) || '.' || CAST(t % 10 AS VARCHAR) || 's' END AS took FROM (SELECT event_id, CAST(floor((event_id * 7 % 5000) / 100 + 0.5) AS BIGINT) AS t FROM events)"""


def hash_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deterministic vectors of the benchmark's items, number by number; tests hold the hash places, which SQL lacks."""
    b = table(spark, sf_dir, "benchmark")
    return tools.embedded(b).select("item_id", F.posexplode("embedding").alias("place", "x")).select("item_id", "place", F.round(F.col("x").cast("double"), 5).alias("x"))


QUERIES = {"rate_limited": rate_limited, "cached_answers": cached_answers, "spend_cap": spend_cap, "spend_windows": spend_windows, "client_trust": trust, "turns_of_runs": turns_of_runs, "event_windows": event_windows, "step_labels": step_labels, "hash_embeddings": hash_embeddings}
ORACLES = {"spend_cap": SPEND_CAP, "spend_windows": SPEND_WINDOWS, "turns_of_runs": TURNS_OF_RUNS, "event_windows": EVENT_WINDOWS, "step_labels": STEP_LABELS}
