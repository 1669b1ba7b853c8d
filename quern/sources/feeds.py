"""Recorded answers of outside services: discovery queries, listings of files, event streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import text

_VALUE = "struct<value:string>"
_BINDINGS = f"results struct<bindings:array<struct<c:{_VALUE},force:{_VALUE},cons:{_VALUE},title:{_VALUE},basis:{_VALUE}>>>"


def discovery_rows(spark: SparkSession, path: str) -> DataFrame:
    """celex, seq, in_force, consolidation, title, basis_article from recorded SPARQL answers."""
    raw = spark.read.schema(_BINDINGS).option("multiLine", "true").json(path)
    b = raw.select(F.posexplode("results.bindings").alias("seq", "b"))
    force = F.when(F.col("b.force.value").isin("1", "true"), True).when(F.col("b.force.value").isin("0", "false"), False)
    return b.select(F.col("b.c.value").alias("celex"), "seq", force.alias("in_force"), F.col("b.cons.value").alias("consolidation"), text.plain_blanks(F.col("b.title.value")).alias("title"), F.col("b.basis.value").alias("basis_article"))


def acts_of_topic(rows: DataFrame, base: str) -> DataFrame:
    """The rows of a topic's answer, which must hold the act that the topic starts from."""
    if rows.where(F.col("celex") == base).isEmpty():
        raise ValueError(f"the answer doesn't hold {base}")
    return rows


def cited_rows(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows of the wanted acts; unknown ones have none."""
    return rows.join(wanted.select("celex").distinct(), "celex", "left_semi")


def published_files(spark: SparkSession, path: str) -> DataFrame:
    """period, version, generated of a listing, whose dates read like 31-01-2024 10:20:30."""
    raw = spark.read.schema("period int, version int, generationDate string").json(path)
    return raw.select("period", "version", F.to_date(F.to_timestamp("generationDate", "dd-MM-yyyy HH:mm:ss")).alias("generated"))


def sse_events(lines: DataFrame, known: tuple[str, ...], raw: str = "message") -> DataFrame:
    """event, data of server-sent messages (`event: x` and `data: y` lines); unknown events go."""
    event = F.regexp_extract(raw, r"(?m)^event: ?(.*)$", 1)
    data = F.array_join(F.regexp_extract_all(raw, F.lit(r"(?m)^data: ?(.*)$"), F.lit(1)), "\n")
    return lines.select("*", event.alias("event"), data.alias("data")).where(F.col("event").isin(*known))


def sse_frame(event: Column, data: Column) -> Column:
    """A message as it is sent."""
    return F.concat(F.lit("event: "), event, F.lit("\ndata: "), F.regexp_replace(data, "\n", "\ndata: "), F.lit("\n\n"))
