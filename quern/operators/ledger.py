"""The ledger of handled requests: summaries, steps, top questions, histories, spend. Times are arguments, never the clock."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.functions import text

#: How requests end, and which ends are answers.
OUTCOMES = ("done", "cached", "refused", "error", "aborted")
ANSWERED = ("done", "cached")
RANGES = (7, 30, 90)


def range_start(as_of: dt.datetime, days: int) -> dt.datetime:
    """Midnight UTC at the start of the last `days` days, today included."""
    day = as_of.replace(hour=0, minute=0, second=0, microsecond=0)
    return day - dt.timedelta(days=days - 1)


def since(ledger: DataFrame, as_of: dt.datetime, days: int) -> DataFrame:
    return ledger.where(F.col("created_at") >= F.lit(range_start(as_of, days)))


def outcome_counts(ledger: DataFrame, as_of: dt.datetime, days: int) -> DataFrame:
    """outcome, requests: every outcome once, those that didn't occur with zero."""
    spark: SparkSession = ledger.sparkSession
    every = spark.createDataFrame([(o,) for o in OUTCOMES], "outcome string")
    counts = since(ledger, as_of, days).groupBy("outcome").agg(F.count("*").alias("n"))
    return every.join(counts, "outcome", "left").select("outcome", F.coalesce("n", F.lit(0)).alias("requests"))


def summary(ledger: DataFrame, as_of: dt.datetime, days: int) -> DataFrame:
    """One row: cost and latency of the range (means and percentiles of done requests only), and of all time.

    Milliseconds are rounded half to even; what wasn't measured is null, sums of costs are zero.
    """
    done = F.col("outcome") == "done"
    within = F.col("created_at") >= F.lit(range_start(as_of, days))
    ms = F.when(done & within, F.col("total_ms"))
    # one pass serves the range and all time
    return ledger.agg(
        F.avg(F.when(done & within, F.col("cost_usd"))).alias("mean_usd"),
        F.coalesce(F.sum(F.when(within, F.col("cost_usd"))), F.lit(0.0)).alias("range_usd"),
        F.coalesce(F.sum("cost_usd"), F.lit(0.0)).alias("total_usd"),
        F.bround(F.avg(ms), 0).cast("long").alias("mean_ms"),
        F.bround(F.percentile(ms, 0.5), 0).cast("long").alias("p50_ms"),
        F.bround(F.percentile(ms, 0.95), 0).cast("long").alias("p95_ms"),
        F.min("created_at").alias("kept_since"),
    )


def step_metrics(steps: DataFrame, ledger: DataFrame, as_of: dt.datetime, days: int) -> DataFrame:
    """step, runs, mean_ms, mean_cost_usd of the range's requests; steps without a price don't count in the mean cost."""
    requests = since(ledger, as_of, days).select(F.col("id").alias("request"))
    return steps.join(requests, steps["chat_request_id"] == F.col("request")).groupBy("step").agg(F.count("*").alias("runs"), F.bround(F.avg("ms"), 0).cast("long").alias("mean_ms"), F.avg("cost_usd").alias("mean_cost_usd"))


def first_questions(ledger: DataFrame) -> DataFrame:
    """Requests that no earlier request (of any time) precedes in their thread; those without a thread are all first.

    The thread's least id is joined back instead of an inequality anti-join, which would pair a thread's requests.
    """
    first = ledger.where("thread_id is not null").groupBy("thread_id").agg(F.min("id").alias("id"))
    return ledger.where("thread_id is null").unionByName(ledger.join(first, ["thread_id", "id"], "left_semi").select(*ledger.columns))


def top_questions(ledger: DataFrame, as_of: dt.datetime, days: int, limit: int, key: Column | None = None) -> DataFrame:
    """question (as asked last), asked, cached, last_asked of first questions, folded by their normal form."""
    key = text.normalised_question("question") if key is None else key
    folded = since(first_questions(ledger), as_of, days).groupBy(key.alias("key"))
    found = folded.agg(F.max_by("question", F.struct("created_at", "id")).alias("question"), F.count("*").alias("asked"), F.count_if(F.col("outcome") == "cached").alias("cached"), F.max("created_at").alias("last_asked"))
    return found.orderBy(F.desc("asked"), F.desc("last_asked"), "key").limit(limit).select("question", "asked", "cached", "last_asked")


def thread_history(ledger: DataFrame, most: int) -> DataFrame:
    """thread_id, place, question, answer: each thread's newest `most` answered turns, oldest first, without markers."""
    newest = W.partitionBy("thread_id").orderBy(F.desc("created_at"), F.desc("id"))
    turns = ledger.where(F.col("outcome").isin(*ANSWERED) & F.col("answer").isNotNull() & F.col("thread_id").isNotNull())
    kept = turns.withColumn("back", F.row_number().over(newest)).where(F.col("back") <= most)
    place = F.row_number().over(W.partitionBy("thread_id").orderBy(F.desc("back")))
    return kept.select("thread_id", place.alias("place"), "question", text.without_markers("answer").alias("answer"))


def spend_since(ledger: DataFrame, start: dt.datetime) -> DataFrame:
    return ledger.where(F.col("created_at") >= F.lit(start)).agg(F.coalesce(F.sum("cost_usd"), F.lit(0.0)).alias("spend_usd"))


def rolling_spend(ledger: DataFrame, key: str, seconds: int = 86_400) -> DataFrame:
    """Every request with the spend of its key over the seconds up to it, ends included."""
    span = W.partitionBy(key).orderBy(F.col("created_at").cast("timestamp").cast("long")).rangeBetween(-seconds, 0)
    return ledger.withColumn("spend_usd", F.coalesce(F.sum("cost_usd").over(span), F.lit(0.0)))


def usage(calls: DataFrame, *by: str) -> DataFrame:
    """Tokens over calls that reported any, cost over priced ones; null where none did."""
    sums = [F.sum(c).alias(c) for c in ("input_tokens", "output_tokens", "cost_usd")]
    return calls.groupBy(*by).agg(*sums)


def priced(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """cost_usd of calls by their model's price for a million tokens; null for models without one."""
    each = calls.join(prices, "model", "left")
    return each.withColumn("cost_usd", (F.col("input_tokens") * F.col("input_usd") + F.col("output_tokens") * F.col("output_usd")) / 1e6).drop("input_usd", "output_usd")


#: The nodes of the answering graph and its edges; conditional ones are chosen by a node's outcome.
NODES = ("__start__", "rewrite", "decompose", "retrieve", "assess", "assess_tools", "synthesize", "refuse", "__end__")
EDGES = (
    ("__start__", "rewrite", True), ("__start__", "decompose", True), ("__start__", "retrieve", True),
    ("rewrite", "decompose", True), ("rewrite", "retrieve", True), ("decompose", "retrieve", False),
    ("retrieve", "assess", True), ("retrieve", "synthesize", True), ("retrieve", "refuse", True),
    ("assess", "assess_tools", True), ("assess", "synthesize", True), ("assess", "refuse", True),
    ("assess_tools", "assess", True), ("assess_tools", "synthesize", True), ("assess_tools", "refuse", True),
    ("synthesize", "__end__", False), ("refuse", "__end__", False),
)


def graph_edges(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(EDGES), "source string, target string, conditional boolean")
