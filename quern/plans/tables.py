"""The bindings of operators' inputs to the driver's tables, as DataFrames and as DuckDB common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import text
from quern.shipping import ensure


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ensure(spark).read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A table whose texts are long work: dealt out if it has fewer parts than the cluster has cores (a file of a single row
    group can't be read in parts)."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Emission reports: a line item is a report of a ship (part) by a company (supplier)."""
    li, su, pa = (table(spark, sf_dir, t) for t in ("lineitem", "supplier", "part"))
    price = F.col("l_extendedprice")
    company = F.concat("s_name", F.lit(" Co. Ltd"))
    return (
        li.join(su.select("s_suppkey", "s_name"), F.col("l_suppkey") == F.col("s_suppkey"))
        .join(pa.select("p_partkey", "p_name", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
        .select(
            F.year("l_shipdate").alias("period"), F.when(F.col("l_returnflag") == "A", "partial").otherwise("full").alias("sheet"), F.lit(1).alias("version"), F.lit("2024-01-01").cast("date").alias("generated"),
            F.lpad(F.col("l_partkey").cast("string"), 7, "0").alias("imo"), F.col("p_name").alias("ship_name"), F.col("p_type").alias("ship_type"), text.name_key("p_name").alias("ship_key"),
            F.when(F.col("s_suppkey") % 5 != 0, F.col("s_suppkey").cast("string")).alias("company_imo"), company.alias("company_name"), F.when(F.col("s_suppkey") % 7 != 0, text.company_key(company)).alias("company_key"),
            F.when(F.col("l_linenumber") != 6, price).alias("co2_total"), F.when(F.col("l_linenumber") != 3, price * F.col("l_discount")).alias("co2_ets"), (price * F.col("l_tax")).alias("co2_between_ms"),
            F.when(F.col("l_linenumber") != 2, price * F.col("l_discount")).alias("co2_departed_ms"), F.lit(None).cast("double").alias("co2_arrived_ms"), F.col("l_quantity").alias("co2_at_berth"),
        )
    )


REPORTS = """reports AS (
    SELECT CAST(year(l_shipdate) AS INTEGER) AS period, CASE WHEN l_returnflag = 'A' THEN 'partial' ELSE 'full' END AS sheet, lpad(CAST(l_partkey AS VARCHAR), 7, '0') AS imo,
           p_name AS ship_name, p_type AS ship_type, array_to_string(regexp_extract_all(lower(p_name), '[a-z0-9]+'), ' ') AS ship_key,
           CASE WHEN s_suppkey % 5 <> 0 THEN CAST(s_suppkey AS VARCHAR) END AS company_imo, s_name || ' Co. Ltd' AS company_name,
           CASE WHEN s_suppkey % 7 <> 0 THEN array_to_string(regexp_extract_all(lower(s_name), '[a-z0-9]+'), ' ') END AS company_key,
           CASE WHEN l_linenumber <> 6 THEN l_extendedprice END AS co2_total, CASE WHEN l_linenumber <> 3 THEN l_extendedprice * l_discount END AS co2_ets, l_extendedprice * l_tax AS co2_between_ms,
           CASE WHEN l_linenumber <> 2 THEN l_extendedprice * l_discount END AS co2_departed_ms, CAST(NULL AS DOUBLE) AS co2_arrived_ms, l_quantity AS co2_at_berth
    FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey)"""


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests: an event is a request of its user's thread; every eleventh has no thread."""
    e = table(spark, sf_dir, "events")
    n = F.col("event_id") % 5
    return e.select(
        F.col("event_id").alias("id"), F.concat(F.lit("What is "), "event_type", F.lit(" "), (F.col("event_id") % 40).cast("string"), F.lit("?")).alias("question"),
        F.when(F.col("event_id") % 11 != 0, F.col("user_id")).alias("thread_id"), F.when(F.col("event_id") % 4 != 0, F.concat(F.lit("See [1] and "), "event_type", F.lit(" [2]."))).alias("answer"),
        F.when(n == 0, "done").when(n == 1, "cached").when(n == 2, "refused").when(n == 3, "error").otherwise("done").alias("outcome"),
        F.floor(F.col("value") * 10).cast("long").alias("total_ms"), F.when(F.col("event_id") % 3 != 0, F.col("value")).alias("cost_usd"), F.col("ts").alias("created_at"), F.col("event_type").alias("step"),
    )


LEDGER = """ledger AS (
    SELECT event_id AS id, 'What is ' || event_type || ' ' || CAST(event_id % 40 AS VARCHAR) || '?' AS question, CASE WHEN event_id % 11 <> 0 THEN user_id END AS thread_id,
           CASE WHEN event_id % 4 <> 0 THEN 'See [1] and ' || event_type || ' [2].' END AS answer,
           CASE event_id % 5 WHEN 0 THEN 'done' WHEN 1 THEN 'cached' WHEN 2 THEN 'refused' WHEN 3 THEN 'error' ELSE 'done' END AS outcome,
           CAST(floor(value * 10) AS BIGINT) AS total_ms, CASE WHEN event_id % 3 <> 0 THEN value END AS cost_usd, ts AS created_at, event_type AS step
    FROM events)"""


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks: the lines of the documents; every third line's paragraph has no number, and articles are runs of four lines."""
    d = table(spark, sf_dir, "documents")
    cut = d.select("doc_id", "lang", "source", F.posexplode(F.split("text", "\n")).alias("position", "text")).where("text <> ''")
    article = F.when(F.col("doc_id") % 3 != 0, (F.floor(F.col("position") / 4) + 1).cast("int").cast("string"))
    return cut.select(
        (F.col("doc_id") * 100000 + F.col("position")).alias("id"), F.col("doc_id").cast("string").alias("celex"), F.col("lang").alias("topic"), article.alias("article"),
        F.when(F.col("position") % 3 != 0, (F.col("position") % 12).cast("string")).alias("paragraph"), F.lit(None).cast("string").alias("annex"), F.lit(1).alias("part"), F.lit(1).alias("parts"),
        F.array((F.col("position") % 7).cast("string")).alias("points"), "position", "text", F.sha2("text", 256).alias("content_hash"),
    )


LINES = r"""lines AS (
    SELECT doc_id * 100000 + position AS id, CAST(doc_id AS VARCHAR) AS celex, lang AS topic, CASE WHEN doc_id % 3 <> 0 THEN CAST(position // 4 + 1 AS VARCHAR) END AS article,
           CASE WHEN position % 3 <> 0 THEN CAST(position % 12 AS VARCHAR) END AS paragraph, CAST(NULL AS VARCHAR) AS annex, 1 AS part, 1 AS parts,
           [CAST(position % 7 AS VARCHAR)] AS points, position, text, sha256(text) AS content_hash
    FROM (SELECT doc_id, lang, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS position, unnest(string_split(text, chr(10))) AS text FROM documents) WHERE text <> '')"""
