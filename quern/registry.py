"""Every registered query of the engine with its DuckDB twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quern.plans import corpus_queries, evals_queries, figures_queries, ledger_queries, search_queries, stream_queries, text_queries, upkeep_queries

_FAMILIES = (figures_queries, ledger_queries, text_queries, search_queries, corpus_queries, evals_queries, stream_queries, upkeep_queries)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: q for f in _FAMILIES for k, q in f.QUERIES.items()}
ORACLES: dict[str, str] = {k: q for f in _FAMILIES for k, q in f.ORACLES.items()}
FLAGSHIP = "figures_by_company"
