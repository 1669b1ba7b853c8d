"""Looking into physical plans."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame


def physical(df: DataFrame) -> str:
    """The physical plan as text, schemas of scans in full."""
    conf, name = df.sparkSession.conf, "spark.sql.maxMetadataStringLength"
    before = conf.get(name)
    conf.set(name, "100000")
    try:
        return df._jdf.queryExecution().executedPlan().toString()
    finally:
        conf.set(name, before)


def scanned_columns(df: DataFrame) -> set[str]:
    """Columns that file scans read."""
    return {c.split(":")[0] for schema in re.findall(r"ReadSchema: struct<([^\n]*)>", physical(df)) for c in re.split(r",(?![^<]*>)", schema) if c}


def pushed_filters(df: DataFrame) -> str:
    return " ".join(re.findall(r"PushedFilters: \[([^\]]*)\]", physical(df)))


def python_nodes(df: DataFrame) -> list[str]:
    return re.findall(r"(\w*(?:Python|Pandas|Arrow)\w*)", physical(df))


def exchanges(df: DataFrame) -> int:
    return len(re.findall(r"(?<!Broadcast)(?<!Reused)Exchange (?:hash|range|single|round|SinglePartition)", physical(df)))
