"""Keeping a corpus current, on documents and their lines and a later copy of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators import corpus
from quern.plans.tables import LINES, lines, table


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    ls = lines(spark, sf_dir)
    return ls.withColumn("metadata_hash", F.sha2(F.concat_ws("|", "topic", "position"), 256))


def _versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Stored chunks, and those of a later run: some lines gone, some new, some with other or no metadata before."""
    base = _chunks(spark, sf_dir)
    k = F.col("id")
    stored = base.where(k % 5 != 0).withColumn("metadata_hash", F.when(k % 6 != 0, F.col("metadata_hash")))
    incoming = base.where(k % 7 != 0).withColumn("metadata_hash", F.when(k % 9 == 0, F.lit("x")).otherwise(F.col("metadata_hash")))
    return corpus.occurrences(stored), corpus.occurrences(incoming)


_V = f"""{LINES}, base AS (SELECT *, sha256(topic || '|' || CAST(position AS VARCHAR)) AS mh FROM lines),
    st AS (SELECT id, celex, content_hash, CASE WHEN id % 6 <> 0 THEN mh END AS mh, row_number() OVER (PARTITION BY celex, content_hash ORDER BY position) - 1 AS occurrence FROM base WHERE id % 5 <> 0),
    inc AS (SELECT celex, content_hash, CASE WHEN id % 9 = 0 THEN 'x' ELSE mh END AS mh, row_number() OVER (PARTITION BY celex, content_hash ORDER BY position) - 1 AS occurrence FROM base WHERE id % 7 <> 0),
    act AS (SELECT coalesce(st.celex, inc.celex) AS celex, CASE WHEN st.celex IS NULL THEN 'add' WHEN inc.celex IS NULL THEN 'delete' WHEN st.mh IS NOT DISTINCT FROM inc.mh THEN 'keep' ELSE 'update' END AS action
        FROM st FULL JOIN inc ON st.celex = inc.celex AND st.content_hash = inc.content_hash AND st.occurrence = inc.occurrence)"""


def reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored, incoming = _versions(spark, sf_dir)
    # the guarded form raises where a document would be emptied; here such documents are left out
    both = incoming.select("celex").distinct()
    return corpus.reconcile_counts(stored.join(both, "celex", "left_semi"), incoming)


RECONCILE = f"""WITH {_V} SELECT celex, count(*) FILTER (action = 'add') AS added, count(*) FILTER (action = 'delete') AS deleted, count(*) FILTER (action = 'keep') AS kept, count(*) FILTER (action = 'update') AS updated
    FROM act WHERE celex IN (SELECT celex FROM inc) GROUP BY celex"""


def occurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.occurrences(lines(spark, sf_dir)).groupBy("occurrence").agg(F.count("*").alias("chunks"), F.count_distinct("celex").alias("documents"))


OCCURRENCE = f"""WITH {LINES}, o AS (SELECT celex, CAST(row_number() OVER (PARTITION BY celex, content_hash ORDER BY position) - 1 AS INTEGER) AS occurrence FROM lines)
    SELECT occurrence, count(*) AS chunks, count(DISTINCT celex) AS documents FROM o GROUP BY occurrence"""


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    return o.select((k % 12 + 1).alias("run_id"), F.concat(F.lit("3"), (k % 300).cast("string")).alias("celex"), F.concat(F.lit("t"), (k % 3).cast("string")).alias("topic"), k.cast("string").alias("resolved_celex"), F.sha2(k.cast("string"), 256).alias("sha256"))


def _runs(spark: SparkSession) -> DataFrame:
    return spark.range(1, 13).select("id", F.when(F.col("id") % 4 == 0, "failed").otherwise("success").alias("status"))


def _unique(raw: DataFrame) -> DataFrame:
    """One row for an act and run, as the store has them."""
    return raw.groupBy("run_id", "celex", "topic").agg(F.max("resolved_celex").alias("resolved_celex"), F.max("sha256").alias("sha256"))


def standing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.standing_documents(_unique(_raw(spark, sf_dir)), _runs(spark)).select("celex", "topic", "run_id", "resolved_celex")


_RAW = """raw AS (SELECT o_orderkey % 12 + 1 AS run_id, '3' || CAST(o_orderkey % 300 AS VARCHAR) AS celex, 't' || CAST(o_orderkey % 3 AS VARCHAR) AS topic, max(CAST(o_orderkey AS VARCHAR)) AS resolved_celex, max(sha256(CAST(o_orderkey AS VARCHAR))) AS sha256 FROM orders GROUP BY 1, 2, 3),
    latest AS (SELECT topic, max(run_id) AS latest FROM raw WHERE run_id % 4 <> 0 GROUP BY topic)"""
STANDING = f"""WITH {_RAW} SELECT DISTINCT ON (celex) celex, topic, run_id, resolved_celex FROM raw LEFT JOIN latest USING (topic) WHERE run_id >= coalesce(latest, 0) ORDER BY celex, run_id DESC"""


def fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.fingerprint(corpus.standing_documents(_unique(_raw(spark, sf_dir)), _runs(spark)))


FINGERPRINT = f"""WITH {_RAW}, s AS (SELECT DISTINCT ON (celex) celex, resolved_celex, sha256 FROM raw LEFT JOIN latest USING (topic) WHERE run_id >= coalesce(latest, 0) ORDER BY celex, run_id DESC)
    SELECT left(sha256('[' || string_agg('["' || celex || '", "' || resolved_celex || '", "' || sha256 || '"]', ', ' ORDER BY '["' || celex || '", "' || resolved_celex || '", "' || sha256 || '"]') || ']'), 7) AS fingerprint FROM s"""


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus's hash by a tree of leaves, over every raw row."""
    raw = _raw(spark, sf_dir)
    return corpus.tree_hash(raw.select(F.concat_ws(" ", "celex", "resolved_celex", "sha256").alias("line")).unionByName(raw.select(F.col("celex").alias("line"))), digits=2)


TREE = """WITH l AS (SELECT '3' || CAST(o_orderkey % 300 AS VARCHAR) || ' ' || CAST(o_orderkey AS VARCHAR) || ' ' || sha256(CAST(o_orderkey AS VARCHAR)) AS line FROM orders UNION ALL SELECT '3' || CAST(o_orderkey % 300 AS VARCHAR) FROM orders),
    h AS (SELECT sha256(line) AS h, count(*) AS n FROM l GROUP BY 1),
    a AS (SELECT left(h, 2) AS key, sha256(string_agg(h || ':' || n, '' ORDER BY h || ':' || n)) AS digest, sum(n)::BIGINT AS n FROM h GROUP BY 1),
    b AS (SELECT left(key, 1) AS key, sha256(string_agg(key || ':' || digest, '' ORDER BY key)) AS digest, sum(n)::BIGINT AS n FROM a GROUP BY left(key, 1))
    SELECT sha256(string_agg(key || ':' || digest, '' ORDER BY key)) AS sha256, sum(n)::BIGINT AS n FROM b"""


def _acts(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    k = F.col("l_orderkey")
    celex = F.concat(F.lit("3"), (F.lit(1990) + k % 30).cast("string"), F.element_at(F.array(*map(F.lit, "RLDX")), (k % 4 + 1).cast("int")), F.lpad((k % 50).cast("string"), 4, "0"))
    act = k % 300  # of an act's rows
    stem = F.when((F.col("l_linenumber") % 2 == 0) & (act % 5 != 0), F.concat(F.lit("0"), F.substring(celex, 2, 20))).otherwise(F.lit("02000R0001"))
    return li.select(
        celex.alias("celex"), (k * 10 + F.col("l_linenumber")).alias("seq"), F.when(k % 7 != 0, F.lit(True)).alias("in_force"), F.concat(F.lit("Act "), k.cast("string")).alias("title"),
        F.when(F.col("l_linenumber") < 4, F.concat(stem, F.lit("-"), F.col("l_linenumber").cast("string"))).alias("consolidation"), F.concat(F.lit("A0"), (act % 8).cast("string"), F.lit("P1")).alias("basis_article"),
    )


def selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = corpus.select_documents(_acts(spark, sf_dir), "t", base="32006R0016", kept="A0[2-5]", excluded="A03")
    return found.select("topic", "celex", F.array_join("candidates", ",").alias("candidates"), "title")


SELECTED = r"""WITH r AS (SELECT '3' || CAST(1990 + l_orderkey % 30 AS VARCHAR) || ['R', 'L', 'D', 'X'][l_orderkey % 4 + 1] || lpad(CAST(l_orderkey % 50 AS VARCHAR), 4, '0') AS celex, l_orderkey * 10 + l_linenumber AS seq, CASE WHEN l_orderkey % 7 <> 0 THEN true END AS in_force,
      'Act ' || CAST(l_orderkey AS VARCHAR) AS title, l_linenumber AS n, l_orderkey % 300 AS act FROM lineitem),
    c AS (SELECT *, CASE WHEN n < 4 THEN CASE WHEN n % 2 = 0 AND act % 5 <> 0 THEN '0' || celex[2:] ELSE '02000R0001' END || '-' || CAST(n AS VARCHAR) END AS cons, 'A0' || CAST(act % 8 AS VARCHAR) || 'P1' AS basis FROM r WHERE regexp_full_match(celex, '3[0-9]{4}[RLD][0-9]{4}')),
    a AS (SELECT celex, arg_min(title, seq) AS title, bool_and(true) FILTER (in_force) AS any_force, (SELECT in_force FROM c x WHERE x.celex = c.celex ORDER BY seq LIMIT 1) AS in_force, list_distinct(list(cons) FILTER (cons IS NOT NULL)) AS cons, list(basis) AS basis FROM c GROUP BY celex),
    f AS (SELECT *, list_filter(coalesce(cons, []), lambda x: starts_with(x, '0' || celex[2:] || '-')) AS own FROM a WHERE in_force)
    SELECT 't' AS topic, celex, array_to_string(list_reverse_sort(own), ',') AS candidates, title FROM f WHERE NOT (len(coalesce(cons, [])) > 0 AND len(own) = 0)
      AND (celex = '32006R0016' OR len(list_filter(basis, lambda b: regexp_matches(b, '^(?:A0[2-5])'))) > 0) AND len(list_filter(basis, lambda b: regexp_matches(b, '^(?:A03)'))) = 0"""


def dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = _raw(spark, sf_dir)
    return corpus.dropped(raw.where("run_id = 12"), raw.where("run_id < 3"))


DROPPED = f"WITH {_RAW} SELECT DISTINCT celex FROM raw WHERE run_id < 3 AND celex NOT IN (SELECT celex FROM raw WHERE run_id = 12)"


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = _unique(_raw(spark, sf_dir))
    last = raw.where("run_id = 12").groupBy("celex").agg(F.max("resolved_celex").alias("resolved_celex"))
    before = raw.where("run_id < 3").groupBy("celex").agg(F.max(F.when(F.col("run_id") == 1, F.lit("same")).otherwise(F.col("resolved_celex"))).alias("resolved_celex"))
    return corpus.document_changes(last.withColumn("resolved_celex", F.when(F.col("celex") > "32", "same").otherwise(F.col("resolved_celex"))), before).groupBy("change").agg(F.count("*").alias("documents"))


CHANGES = f"""WITH {_RAW}, l AS (SELECT celex, CASE WHEN celex > '32' THEN 'same' ELSE max(resolved_celex) END AS r FROM raw WHERE run_id = 12 GROUP BY celex), b AS (SELECT celex, max(CASE WHEN run_id = 1 THEN 'same' ELSE resolved_celex END) AS r FROM raw WHERE run_id < 3 GROUP BY celex)
    SELECT CASE WHEN b.celex IS NULL THEN 'new' WHEN b.r = l.r THEN 'reused' ELSE 'updated' END AS change, count(*) AS documents FROM l LEFT JOIN b USING (celex) GROUP BY 1"""


def batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    ls = lines(spark, sf_dir).withColumn("embedding", F.when(F.col("position") % 3 == 0, F.array(F.lit(1.0))))
    return corpus.embed_batches(ls, 4).groupBy("celex", "batch").agg(F.count("*").alias("chunks"))


BATCHES = f"""WITH {LINES} SELECT celex, batch, count(*) AS chunks FROM (SELECT celex, CAST((row_number() OVER (PARTITION BY celex ORDER BY position, id) - 1) // 4 AS INTEGER) AS batch FROM lines WHERE position % 3 <> 0) GROUP BY ALL"""


def stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.corpus_stats(table(spark, sf_dir, "documents")).withColumn("avg_chunk_chars", F.round("avg_chunk_chars", 4))


STATS = "SELECT count(*) AS chunk_count, round(avg(length(text)), 4) AS avg_chunk_chars FROM documents"


def pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    keep = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("celex"))
    return corpus.pruned(lines(spark, sf_dir), keep).groupBy("celex").agg(F.count("*").alias("chunks"))


PRUNED = f"WITH {LINES} SELECT celex, count(*) AS chunks FROM lines WHERE celex IN (SELECT CAST(doc_id AS VARCHAR) FROM labels) GROUP BY celex"


def report(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    result = F.element_at(F.array(*map(F.lit, ("new", "updated", "reused", "failed"))), (F.col("user_id") % 4 + 1).cast("int"))
    return corpus.stage_report(e.select(F.col("event_type").alias("stage"), result.alias("result")))


REPORT = """WITH e AS (SELECT event_type AS stage, ['new', 'updated', 'reused', 'failed'][user_id % 4 + 1] AS r FROM events)
    SELECT stage, count(*) AS total, count(*) FILTER (r = 'new') AS "new", count(*) FILTER (r = 'updated') AS updated, count(*) FILTER (r = 'reused') AS reused, count(*) FILTER (r = 'failed') AS failed FROM e GROUP BY stage"""

QUERIES = {"reconcile": reconcile, "occurrences": occurrence, "standing_documents": standing, "corpus_fingerprint": fingerprint, "corpus_tree": tree, "select_documents": selected, "dropped_acts": dropped, "document_changes": changes, "embed_batches": batches, "corpus_stats": stats, "pruned": pruned, "stage_report": report}
ORACLES = {"reconcile": RECONCILE, "occurrences": OCCURRENCE, "standing_documents": STANDING, "corpus_fingerprint": FINGERPRINT, "corpus_tree": TREE, "select_documents": SELECTED, "dropped_acts": DROPPED, "document_changes": CHANGES, "embed_batches": BATCHES, "corpus_stats": STATS, "pruned": PRUNED, "stage_report": REPORT}
