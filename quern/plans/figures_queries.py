"""Figures and names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import text
from quern.operators import figures
from quern.plans.tables import REPORTS, reports, table

PERIOD = 1995
_SUMS = ", ".join(f"coalesce(sum({c}), 0) AS {c}" for c in figures.FIGURES)
_SHOWN = ", ".join(f"round({c}, 2) AS {c}" for c in figures.FIGURES)
_LABELS = {
    "company": ("coalesce(company_imo, company_key)", "max(company_name) || coalesce(' (IMO company number ' || max(company_imo) || ')', '')"),
    "ship": ("imo", "max(ship_name) || ' (IMO ' || key || ', ' || max(ship_type) || coalesce(', ' || max(company_name), '') || ')'"),
    "report_type": ("sheet", "key || ' ERs'"),
}


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 2) for c in figures.FIGURES})


def _grouped(by: str, **asked: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _rounded(figures.grouped(reports(spark, sf_dir), figures.Question(PERIOD, by, **asked)))

    return run


def _grouped_sql(by: str, where: str = "true") -> str:
    key, label = _LABELS[by]
    order = "key" if by == "report_type" else "raw_ets DESC NULLS LAST, raw_total DESC NULLS FIRST, key"
    limit = "" if by == "report_type" else f"LIMIT {figures.LISTED}"
    return f"""WITH {REPORTS}, matched AS (SELECT *, {key} AS key FROM reports WHERE period = {PERIOD} AND {where}),
        grouped AS (SELECT key, {label} AS label, count(*) AS reports, {_SUMS}, sum(co2_ets) AS raw_ets, sum(co2_total) AS raw_total FROM matched WHERE key IS NOT NULL GROUP BY key)
        SELECT key, label, reports, {_SHOWN}, count(*) OVER () AS group_count FROM grouped ORDER BY {order} {limit}"""


def overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = figures.overall(reports(spark, sf_dir), figures.Question(PERIOD))
    return _rounded(found).withColumn("median_ets_ratio", F.round("median_ets_ratio", 6))


_SCOPE = "(coalesce(co2_between_ms, 0.0::DOUBLE) + 0.5::DOUBLE * coalesce(co2_departed_ms, 0.0::DOUBLE) + 0.5::DOUBLE * coalesce(co2_arrived_ms, 0.0::DOUBLE) + coalesce(co2_at_berth, 0.0::DOUBLE))"
OVERALL = f"""WITH {REPORTS}, m AS (SELECT *, {_SCOPE} AS scope FROM reports WHERE period = {PERIOD}),
    o AS (SELECT count(*) AS reports, {_SUMS}, count(*) FILTER (co2_ets > 0 AND scope <> 0) AS reports_with_ets,
          round(quantile_cont(co2_ets / scope, 0.5) FILTER (co2_ets > 0 AND scope <> 0), 6) AS median_ets_ratio,
          count(*) FILTER (co2_ets > 0 AND scope <> 0 AND abs(co2_ets - scope) <= 0.01::DOUBLE * co2_ets) AS matching_ets_ratio FROM m)
    SELECT reports, {_SHOWN}, reports_with_ets, median_ets_ratio, matching_ets_ratio FROM o"""


def figures_by_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = reports(spark, sf_dir)
    by = r.groupBy("period").agg(F.count("*").alias("reports"), F.round(F.sum(figures.scoped_total()), 2).alias("scoped"))
    return by.select("period", "reports", "scoped", figures.phase_in(F.col("period") + 30).alias("phase_in"))


FIGURES_BY_PERIOD = f"""WITH {REPORTS} SELECT period, count(*) AS reports, round(sum({_SCOPE}), 2) AS scoped,
    CASE WHEN period + 30 < 2024 THEN NULL WHEN period + 30 = 2024 THEN 0.4::DOUBLE WHEN period + 30 = 2025 THEN 0.7::DOUBLE ELSE 1.0::DOUBLE END AS phase_in FROM reports GROUP BY period"""


def name_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    endings = F.element_at(F.array(*map(F.lit, (" A/S", " Co., Ltd.", " GmbH", " S.p.A", ""))), (F.col("s_suppkey") % 5 + 1).cast("int"))
    named = s.select("s_suppkey", F.concat("s_name", endings).alias("name"))
    return named.select("s_suppkey", text.name_key("name").alias("name_key"), text.company_key("name").alias("company_key"), F.size(text.word_runs("name")).alias("runs"))


_ENDINGS = ", ".join(f"'{e}'" for e in text.CORPORATE_ENDINGS)
NAME_KEYS = f"""WITH n AS (SELECT s_suppkey, regexp_extract_all(lower(s_name || [' A/S', ' Co., Ltd.', ' GmbH', ' S.p.A', ''][s_suppkey % 5 + 1]), '[a-z0-9]+') AS w FROM supplier),
    k AS (SELECT *, CASE WHEN len(w) > 3 AND array_to_string(w[-3:], '') IN ({_ENDINGS}) THEN 3 WHEN len(w) > 2 AND array_to_string(w[-2:], '') IN ({_ENDINGS}) THEN 2
          WHEN len(w) > 1 AND w[-1] IN ({_ENDINGS}) THEN 1 ELSE 0 END AS cut FROM n)
    SELECT s_suppkey, array_to_string(w, ' ') AS name_key, array_to_string(w[:len(w) - cut], ' ') AS company_key,
           CAST((SELECT count(DISTINCT array_to_string(w[i:i + n - 1], ' ')) FROM range(1, len(w) + 1) a(i), range(1, 6) b(n) WHERE i + n - 1 <= len(w)) AS INTEGER) AS runs FROM k"""


def whole_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", text.name_key("p_name").alias("key"), F.element_at(text.name_words("p_name"), 1).alias("w"))
    return p.where(text.holds_whole_words("key", F.lit("red"))).select("p_partkey", "key").unionByName(p.where(text.holds_whole_words("key", F.lit(""))).select("p_partkey", "key"))


WHOLE_WORDS = """SELECT p_partkey, array_to_string(regexp_extract_all(lower(p_name), '[a-z0-9]+'), ' ') AS key FROM part
    WHERE contains(' ' || array_to_string(regexp_extract_all(lower(p_name), '[a-z0-9]+'), ' ') || ' ', ' red ')"""


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "nation").select(F.lit("company").alias("kind"), text.name_key("n_name").alias("key"), F.col("n_name").alias("name"), F.lpad(F.col("n_nationkey").cast("string"), 7, "0").alias("number"))
    q = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("question_id"), F.concat(F.lit("what did "), "c_mktsegment", F.lit(" emit in "), F.lpad(F.col("c_nationkey").cast("string"), 7, "0"), F.lit("?")).alias("question"))
    common = spark.createDataFrame([("what",), ("did",), ("in",)], "word string")
    return figures.find_entities(q, names, common)


ENTITIES = """SELECT c_custkey AS question_id, 'company' AS kind, n_name AS name, 1 AS place FROM customer JOIN nation ON c_nationkey = n_nationkey"""

QUERIES = {
    "figures_by_company": _grouped("company"),
    "figures_by_ship": _grouped("ship"),
    "figures_by_report_type": _grouped("report_type"),
    "figures_of_a_company": _grouped("ship", company="3"),
    "figures_overall": overall,
    "figures_by_period": figures_by_period,
    "name_keys": name_keys,
    "whole_words": whole_words,
    "entities": entities,
}
ORACLES = {
    "figures_by_company": _grouped_sql("company"),
    "figures_by_ship": _grouped_sql("ship"),
    "figures_by_report_type": _grouped_sql("report_type"),
    "figures_of_a_company": _grouped_sql("ship", "coalesce(company_imo = '3' OR contains(' ' || company_key || ' ', ' 3 '), false)"),
    "figures_overall": OVERALL,
    "figures_by_period": FIGURES_BY_PERIOD,
    "name_keys": NAME_KEYS,
    "whole_words": WHOLE_WORDS,
    "entities": ENTITIES,
}
