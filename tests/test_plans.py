"""What the plans of the main queries must and mustn't do."""

from quern.operators import search
from quern.plans import checks
from quern.plans.tables import table
from quern.registry import QUERIES

AT = "/root/testdata/sf0.001"


def test_figures_read_few_columns_and_stay_in_the_jvm(spark):
    df = QUERIES["figures_by_company"](spark, AT)
    assert "l_shipdate" in checks.scanned_columns(df) and "l_linestatus" not in checks.scanned_columns(df)
    assert not checks.python_nodes(df)
    assert checks.physical(df).count("l_shipdate:") == 1  # groups and their count come from one scan


def test_scans_push_filters(spark):
    df = table(spark, AT, "documents").where("lang = 'fr'").select("doc_id")
    assert "EqualTo(lang,fr)" in checks.pushed_filters(df) and checks.scanned_columns(df) == {"doc_id", "lang"}


def test_top_k_is_limited_before_the_shuffle(spark):
    assert "WindowGroupLimit" in checks.physical(QUERIES["bm25_topk"](spark, AT))


def test_no_python_in_native_families(spark):
    for name in ("bm25_topk", "ledger_summary", "top_questions", "thread_history", "reconcile", "standing_documents", "eval_metrics", "expand_sections", "identifiers"):
        assert not checks.python_nodes(QUERIES[name](spark, AT)), name


def test_only_one_row_sides_are_crossed(spark):
    for name in ("figures_by_company", "bm25_topk", "hybrid_topk"):
        plan = checks.physical(QUERIES[name](spark, AT))
        assert "CartesianProduct" not in plan, name


def test_only_asked_postings_shuffle(spark):
    """The corpus's tokens meet the queries' lexemes before any exchange; few lexemes are broadcast."""
    docs = table(spark, AT, "documents").withColumnRenamed("doc_id", "id")
    queries = table(spark, AT, "benchmark").selectExpr("item_id AS query_id", "text AS query")
    plan = checks.physical(search.postings(docs, asked=search.lexemes(queries)))
    above, _, below = plan.partition("Generate explode")
    exchanges = [i for i, x in enumerate(above.splitlines()) if "Exchange hashpartitioning(id" in x]
    joins = [i for i, x in enumerate(above.splitlines()) if "BroadcastHashJoin" in x and "LeftSemi" in x]
    assert exchanges and joins and max(exchanges) < min(joins)
    assert below.count("Scan parquet") == 2 or below.count("FileScan parquet") == 2  # documents and, for the broadcast side, the queries
