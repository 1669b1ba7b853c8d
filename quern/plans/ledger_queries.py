"""The request ledger."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import text
from quern.operators import ledger as ops
from quern.plans.tables import LEDGER, ledger, table

AS_OF = dt.datetime(2024, 1, 20)
DAYS = 30
_SINCE = f"TIMESTAMP '{ops.range_start(AS_OF, DAYS):%Y-%m-%d %H:%M:%S}'"


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.outcome_counts(ledger(spark, sf_dir), AS_OF, DAYS)


OUTCOMES = f"""WITH {LEDGER} SELECT o.outcome, count(l.id) AS requests FROM (VALUES ('done'), ('cached'), ('refused'), ('error'), ('aborted')) o(outcome)
    LEFT JOIN ledger l ON l.outcome = o.outcome AND l.created_at >= {_SINCE} GROUP BY o.outcome"""


def summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.summary(ledger(spark, sf_dir), AS_OF, DAYS).withColumns({c: F.round(c, 4) for c in ("mean_usd", "range_usd", "total_usd")})


SUMMARY = f"""WITH {LEDGER} SELECT round(avg(cost_usd) FILTER (w AND outcome = 'done'), 4) AS mean_usd, round(coalesce(sum(cost_usd) FILTER (w), 0), 4) AS range_usd, round(coalesce(sum(cost_usd), 0), 4) AS total_usd,
    CAST(round_even(avg(total_ms) FILTER (w AND outcome = 'done'), 0) AS BIGINT) AS mean_ms, CAST(round_even(quantile_cont(total_ms, 0.5) FILTER (w AND outcome = 'done'), 0) AS BIGINT) AS p50_ms,
    CAST(round_even(quantile_cont(total_ms, 0.95) FILTER (w AND outcome = 'done'), 0) AS BIGINT) AS p95_ms, min(created_at) AS kept_since FROM (SELECT *, created_at >= {_SINCE} AS w FROM ledger)"""


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    led = ledger(spark, sf_dir)
    each = led.select(F.col("id").alias("chat_request_id"), "step", F.col("total_ms").alias("ms"), "cost_usd")
    return ops.step_metrics(each, led, AS_OF, DAYS).withColumn("mean_cost_usd", F.round("mean_cost_usd", 4))


STEPS = f"""WITH {LEDGER} SELECT s.step, count(*) AS runs, CAST(round_even(avg(s.total_ms), 0) AS BIGINT) AS mean_ms, round(avg(s.cost_usd), 4) AS mean_cost_usd
    FROM ledger s JOIN ledger r ON s.id = r.id WHERE r.created_at >= {_SINCE} GROUP BY s.step"""


def top_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.top_questions(ledger(spark, sf_dir), AS_OF, DAYS, 20)


TOP_QUESTIONS = f"""WITH {LEDGER}, f AS (SELECT *, rtrim(lower(question), '?!. ') AS key FROM ledger l WHERE created_at >= {_SINCE}
      AND NOT EXISTS (SELECT 1 FROM ledger e WHERE e.thread_id = l.thread_id AND e.id < l.id))
    SELECT arg_max(question, (created_at, id)) AS question, count(*) AS asked, count(*) FILTER (outcome = 'cached') AS cached, max(created_at) AS last_asked
    FROM f GROUP BY key ORDER BY asked DESC, last_asked DESC, key LIMIT 20"""


def asked_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Opening user turns of conversations, folded by their normal form."""
    c = table(spark, sf_dir, "conversations").where("role = 'user'")
    opening = c.groupBy("conv_id").agg(F.min_by("text", "turn").alias("question"))
    return opening.groupBy(text.normalised_question("question").alias("key")).agg(F.count("*").alias("asked"), F.min("conv_id").alias("first_conv"))


ASKED_FIRST = r"""SELECT regexp_replace(trim(regexp_replace(lower(question), '\s+', ' ', 'g')), '[\s?!.]+$', '') AS key, count(*) AS asked, min(conv_id) AS first_conv
    FROM (SELECT conv_id, arg_min(text, turn) AS question FROM conversations WHERE role = 'user' GROUP BY conv_id) GROUP BY key"""


def thread_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.thread_history(ledger(spark, sf_dir), 3)


THREAD_HISTORY = rf"""WITH {LEDGER}, a AS (SELECT *, row_number() OVER (PARTITION BY thread_id ORDER BY created_at DESC, id DESC) AS back FROM ledger
      WHERE outcome IN ('done', 'cached') AND answer IS NOT NULL AND thread_id IS NOT NULL)
    SELECT thread_id, CAST(row_number() OVER (PARTITION BY thread_id ORDER BY back DESC) AS INTEGER) AS place, question, regexp_replace(answer, '\s*\[\d+\]', '', 'g') AS answer FROM a WHERE back <= 3"""


def rolling_spend(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ops.rolling_spend(ledger(spark, sf_dir).where("thread_id is not null"), "thread_id")
    return found.select("id", F.round("spend_usd", 4).alias("spend_usd"))


ROLLING_SPEND = f"""WITH {LEDGER} SELECT id, round(coalesce(sum(cost_usd) OVER (PARTITION BY thread_id ORDER BY CAST(floor(epoch(created_at)) AS BIGINT) RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW), 0), 4) AS spend_usd
    FROM ledger WHERE thread_id IS NOT NULL"""


def spend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.spend_since(ledger(spark, sf_dir), dt.datetime(2024, 1, 5)).select(F.round("spend_usd", 4).alias("spend_usd"))


SPEND = f"WITH {LEDGER} SELECT round(coalesce(sum(cost_usd), 0), 4) AS spend_usd FROM ledger WHERE created_at >= TIMESTAMP '2024-01-05'"


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = ledger(spark, sf_dir).select("step", F.when(F.col("id") % 2 == 0, F.col("total_ms")).alias("input_tokens"), F.lit(None).cast("long").alias("output_tokens"), "cost_usd")
    return ops.usage(calls, "step").withColumn("cost_usd", F.round("cost_usd", 4))


USAGE = f"WITH {LEDGER} SELECT step, CAST(sum(total_ms) FILTER (id % 2 = 0) AS BIGINT) AS input_tokens, CAST(NULL AS BIGINT) AS output_tokens, round(sum(cost_usd), 4) AS cost_usd FROM ledger GROUP BY step"


def graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.graph_edges(spark)


GRAPH = "SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}', {str(c).lower()})" for a, b, c in ops.EDGES) + ") t(source, target, conditional)"

QUERIES = {"outcome_counts": outcomes, "ledger_summary": summary, "step_metrics": steps, "top_questions": top_questions, "asked_first": asked_first, "thread_history": thread_history, "rolling_spend": rolling_spend, "spend_since": spend, "usage_by_step": usage, "graph_edges": graph}
ORACLES = {"outcome_counts": OUTCOMES, "ledger_summary": SUMMARY, "step_metrics": STEPS, "top_questions": TOP_QUESTIONS, "asked_first": ASKED_FIRST, "thread_history": THREAD_HISTORY, "rolling_spend": ROLLING_SPEND, "spend_since": SPEND, "usage_by_step": USAGE, "graph_edges": GRAPH}
