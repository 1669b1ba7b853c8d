"""Operators around runs: what they select, hold, follow, store and keep, on small relations made of the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import identifiers, text
from quern.operators import context, corpus, evals, ledger
from quern.plans.tables import LINES, lines, table
from quern.sources import store


def _made(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return table(spark, sf_dir, name).selectExpr(*columns)


def _stamps(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Cases with a target each in the first article of a document; a third of the documents have no articles."""
    target = "array(named_struct('celex', string(doc_id), 'article', if(doc_id % 12 = 5, '99', '1'), 'paragraph', string(null), 'point', string(null), 'annex', string(null), 'content_hashes', cast(array() AS array<string>))) AS targets"
    return _made(spark, sf_dir, "documents", "string(doc_id) AS case_id", "doc_id", target), lines(spark, sf_dir)


def drifted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stamped cases, some of whose stamps are then changed or taken off, beside those that can't be stamped."""
    cases, chunks = _stamps(spark, sf_dir)
    known = evals.drift(cases, chunks).where("drift <> 'unresolved'").select("case_id")
    stamped = evals.stamped(cases.join(known, "case_id", "left_semi"), chunks)
    hashes = F.when(F.col("doc_id") % 12 == 1, F.array(F.lit("x"))).when(F.col("doc_id") % 12 == 4, F.array().cast("array<string>")).otherwise(F.col("targets")[0]["content_hashes"])
    changed = stamped.withColumn("targets", F.array(F.col("targets")[0].withField("content_hashes", hashes)))
    both = changed.unionByName(cases.join(known, "case_id", "left_anti"))
    return evals.drift(both, chunks).select("case_id", "drift", F.array_join("current", ",").alias("current"))


DRIFTED = f"""WITH {LINES}, h AS (SELECT celex, string_agg(left(content_hash, 12), ',' ORDER BY paragraph IS NOT NULL, TRY_CAST(paragraph AS INTEGER) NULLS LAST, part, id) AS now FROM lines WHERE article = '1' GROUP BY celex)
    SELECT CAST(doc_id AS VARCHAR) AS case_id, CASE WHEN now IS NULL THEN 'unresolved' WHEN doc_id % 12 = 1 THEN 'stale' WHEN doc_id % 12 = 4 THEN 'unstamped' ELSE 'clean' END AS drift, now AS current
    FROM documents LEFT JOIN h ON celex = CAST(doc_id AS VARCHAR) AND doc_id % 12 <> 5"""


def _review(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    calls = _made(
        spark, sf_dir, "lineitem", "l_orderkey * 10 + l_linenumber AS call_id", "l_orderkey % 300 AS context_id", "l_orderkey * 10 + l_linenumber AS place",
        "CASE WHEN l_linenumber = 1 OR l_orderkey % 300 % 7 = 0 THEN 'refuse' WHEN l_linenumber % 2 = 0 THEN 'follow_reference' ELSE 'search' END AS name", "concat('c', l_partkey % 3) AS celex",
        "CASE WHEN l_linenumber % 4 <> 3 THEN concat('', l_linenumber % 3, 'A') END AS article", "CASE WHEN l_partkey % 4 <> 0 THEN '1' END AS paragraph", "CASE WHEN l_suppkey % 3 = 0 THEN 'B' END AS point",
    )
    sources = _made(
        spark, sf_dir, "orders", "o_orderkey % 300 AS context_id", "concat('c', o_custkey % 3) AS celex", "concat('', o_custkey % 4, 'a') AS article", "CASE WHEN o_custkey % 2 = 0 THEN '1' END AS paragraph",
        "int(o_orderkey % 2 + 1) AS part", "2 AS parts", "CASE WHEN o_custkey % 5 = 0 THEN array('a', 'b') ELSE array('c') END AS points",
    )
    return calls, sources


_REVIEW = """c AS (SELECT l_orderkey * 10 + l_linenumber AS call_id, l_orderkey % 300 AS context_id, CASE WHEN l_linenumber = 1 OR l_orderkey % 300 % 7 = 0 THEN 'refuse' WHEN l_linenumber % 2 = 0 THEN 'follow_reference' ELSE 'search' END AS name,
      'c' || CAST(l_partkey % 3 AS VARCHAR) AS celex, CASE WHEN l_linenumber % 4 <> 3 THEN CAST(l_linenumber % 3 AS VARCHAR) || 'a' END AS art, CASE WHEN l_partkey % 4 <> 0 THEN '1' END AS par, CASE WHEN l_suppkey % 3 = 0 THEN 'b' END AS point FROM lineitem),
    s AS (SELECT o_orderkey % 300 AS context_id, 'c' || CAST(o_custkey % 3 AS VARCHAR) AS celex, CAST(o_custkey % 4 AS VARCHAR) || 'a' AS art, CASE WHEN o_custkey % 2 = 0 THEN '1' END AS par, o_orderkey % 2 + 1 AS part, CASE WHEN o_custkey % 5 = 0 THEN ['a', 'b'] ELSE ['c'] END AS points FROM orders),
    j AS (SELECT c.call_id, c.point, s.part, s.points, c.par IS NOT DISTINCT FROM s.par AS same FROM c JOIN s USING (context_id, celex, art) WHERE c.name = 'follow_reference'),
    shown AS (SELECT DISTINCT call_id FROM j WHERE point IS NOT NULL AND list_contains(points, point) UNION SELECT call_id FROM j WHERE point IS NULL AND same GROUP BY call_id HAVING count(DISTINCT part) = 2)"""


def shown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.already_shown(*_review(spark, sf_dir))


def planned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.planned_calls(*_review(spark, sf_dir)).select("context_id", "call_id")


PLANNED = f"""WITH {_REVIEW}, f AS (SELECT * FROM c WHERE name <> 'refuse')
    SELECT context_id, min(call_id) AS call_id FROM c WHERE name = 'refuse' AND context_id NOT IN (SELECT context_id FROM f) GROUP BY context_id
    UNION ALL SELECT context_id, call_id FROM (SELECT context_id, call_id, row_number() OVER (PARTITION BY context_id ORDER BY call_id) AS n FROM f WHERE call_id NOT IN (SELECT call_id FROM shown)) WHERE n <= 4"""


def hopped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cited acts that aren't held; citations without a division, and those of merely cited documents, don't count."""
    chunks = _made(spark, sf_dir, "lineitem", "CASE WHEN l_linenumber = 5 THEN 'cited' ELSE 't' END AS topic", "array(named_struct('instrument', CASE WHEN l_linenumber <> 6 THEN concat('3', l_partkey % 400) END, 'article', CASE WHEN l_linenumber % 2 = 0 THEN '1' END, 'annex', CASE WHEN l_linenumber = 3 THEN '' END)) AS references")
    return corpus.hop(chunks, _made(spark, sf_dir, "orders", "concat('3', o_custkey % 90) AS celex"))


HOPPED = """SELECT DISTINCT '3' || CAST(l_partkey % 400 AS VARCHAR) AS celex FROM lineitem WHERE l_linenumber NOT IN (5, 6) AND (l_linenumber % 2 = 0 OR l_linenumber = 3) AND '3' || CAST(l_partkey % 400 AS VARCHAR) NOT IN (SELECT '3' || CAST(o_custkey % 90 AS VARCHAR) FROM orders)"""


def first_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _made(spark, sf_dir, "orders", "concat('3', o_orderkey % 300) AS celex", "concat('t', o_custkey % 5) AS topic", "o_custkey % 5 AS topic_order").distinct()
    return corpus.first_topics(found).select("celex", "topic")


FIRST_TOPICS = "SELECT '3' || CAST(o_orderkey % 300 AS VARCHAR) AS celex, 't' || CAST(min(o_custkey % 5) AS VARCHAR) AS topic FROM orders GROUP BY 1"


def reused(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _made(spark, sf_dir, "orders", "string(o_orderkey) AS celex", "array(string(o_custkey % 3)) AS candidates")
    before = _made(spark, sf_dir, "orders", "string(o_orderkey) AS celex", "array(string(o_custkey % 2)) AS candidates", "concat('v', o_orderkey) AS resolved_celex", "sha2(string(o_orderkey), 256) AS sha256", "o_orderkey % 4 <> 0 AS verified").where("celex % 5 <> 0")
    return corpus.reusable(found, before).select("celex", "resolved_celex", "sha256")


REUSED = "SELECT CAST(o_orderkey AS VARCHAR) AS celex, 'v' || CAST(o_orderkey AS VARCHAR) AS resolved_celex, sha256(CAST(o_orderkey AS VARCHAR)) AS sha256 FROM orders WHERE o_custkey % 3 = o_custkey % 2 AND o_orderkey % 4 <> 0 AND o_orderkey % 5 <> 0"


def run_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.run_status(_made(spark, sf_dir, "events", "user_id AS run_id", "CASE WHEN event_id % 40 = 0 THEN 'failed' ELSE 'new' END AS result", "CASE WHEN event_type IN ('click', 'view') THEN 'cited' ELSE event_type END AS topic"))


RUN_STATUSES = "SELECT user_id AS run_id, CASE WHEN count(*) FILTER (event_id % 40 = 0 AND event_type NOT IN ('click', 'view')) > 0 THEN 'failed' ELSE 'success' END AS status FROM events GROUP BY user_id"


def paged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page of unembedded lines after a cursor; a page's size is the feature."""
    chunks = lines(spark, sf_dir).withColumn("embedding", F.when(F.col("position") % 3 == 0, F.array(F.lit(1.0))))
    return corpus.after_cursor(corpus.unembedded(chunks), "12", 1_200_004, 25).select("celex", "id")


PAGED = f"WITH {LINES} SELECT celex, id FROM lines WHERE position % 3 <> 0 AND (celex > '12' OR (celex = '12' AND id > 1200004)) ORDER BY celex, id LIMIT 25"


def reconcile_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of all stored chunks, those of documents that the incoming side leaves without any too."""
    base = lines(spark, sf_dir).selectExpr("id", "celex", "content_hash", "position", "concat('m', position % 3) AS metadata_hash")
    stored, incoming = corpus.occurrences(base.where("id % 5 <> 0")), corpus.occurrences(base.where("id % 7 <> 0 and celex % 6 <> 0").withColumn("metadata_hash", F.when(F.col("position") % 4 != 0, F.col("metadata_hash"))))
    return corpus.reconcile(stored, incoming).groupBy("celex", "action").agg(F.count("*").alias("chunks"), F.count("id").alias("with_id"))


RECONCILE_ACTIONS = f"""WITH {LINES}, st AS (SELECT id, celex, content_hash, 'm' || CAST(position % 3 AS VARCHAR) AS m, row_number() OVER (PARTITION BY celex, content_hash ORDER BY position) AS o FROM lines WHERE id % 5 <> 0),
    inc AS (SELECT celex, content_hash, CASE WHEN position % 4 <> 0 THEN 'm' || CAST(position % 3 AS VARCHAR) END AS m, row_number() OVER (PARTITION BY celex, content_hash ORDER BY position) AS o FROM lines WHERE id % 7 <> 0 AND CAST(celex AS BIGINT) % 6 <> 0)
    SELECT coalesce(st.celex, inc.celex) AS celex, CASE WHEN st.celex IS NULL THEN 'add' WHEN inc.celex IS NULL THEN 'delete' WHEN st.m IS NOT DISTINCT FROM inc.m THEN 'keep' ELSE 'update' END AS action, count(*) AS chunks, count(st.id) AS with_id
    FROM st FULL JOIN inc ON st.celex = inc.celex AND st.content_hash = inc.content_hash AND st.o = inc.o GROUP BY ALL"""


def tuned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings of a sweep (one a customer) in the order in which they are preferred."""
    entries = _made(spark, sf_dir, "customer", "string(c_custkey) AS name", "CASE WHEN c_custkey % 7 <> 0 THEN (c_custkey % 10) / 10D END AS recall", "CASE WHEN c_custkey % 5 <> 0 THEN (c_custkey % 4) * 0.5D END AS cost_usd", "double(c_custkey % 3) AS context_chars")
    return evals.tuning_order(entries).select("name", "rank")


TUNED = """SELECT CAST(c_custkey AS VARCHAR) AS name, CAST(row_number() OVER (ORDER BY coalesce(CASE WHEN c_custkey % 7 <> 0 THEN (c_custkey % 10) / 10::DOUBLE END, -1) DESC, CASE WHEN c_custkey % 5 <> 0 THEN (c_custkey % 4) * 0.5::DOUBLE END NULLS LAST, c_custkey % 3, CAST(c_custkey AS VARCHAR)) AS INTEGER) AS rank FROM customer"""


def chosen_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = _made(spark, sf_dir, "labels", "concat('case-', doc_id) AS case_id", "CASE WHEN toxic = 0 THEN 'in_corpus' ELSE 'out_of_corpus' END AS kind", "CASE doc_id % 3 WHEN 0 THEN array('hop') WHEN 1 THEN array('hop', 'long') ELSE array('short') END AS traits")
    return evals.selected(cases, "1", ["long", "short"], "in_corpus").select("case_id")


CHOSEN_CASES = "SELECT 'case-' || CAST(doc_id AS VARCHAR) AS case_id FROM labels WHERE toxic = 0 AND doc_id % 3 <> 0 AND contains(CAST(doc_id AS VARCHAR), '1')"


def kept_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests of first questions with the answers that earlier ones left, by key."""
    asked = _made(spark, sf_dir, "events", "event_id", "concat('q', user_id % 60) AS q", "event_id % 4 <> 0 AS first", "CASE WHEN event_id % 3 = 0 THEN 'done' ELSE 'error' END AS outcome", "CASE WHEN event_id % 5 = 0 THEN '' ELSE concat('a', user_id % 60) END AS answer", "CASE WHEN event_id % 11 <> 0 THEN 'v1' END AS corpus")
    keyed = asked.withColumn("key", context.answer_key(F.lit("b1"), F.lit("0123456789abcdef"), F.col("corpus"), F.lit("f"), F.col("q")))
    return context.cache_lookup(keyed, context.storable(keyed).distinct()).select("event_id", "key", "kept_answer")


KEPT_ANSWERS = """WITH e AS (SELECT event_id, event_id % 4 <> 0 AS first, event_id % 3 = 0 AS done, CASE WHEN event_id % 5 = 0 THEN '' ELSE 'a' || CAST(user_id % 60 AS VARCHAR) END AS answer, CASE WHEN event_id % 11 <> 0 THEN 'b1:0123456789ab:v1:f:' || sha256('q' || CAST(user_id % 60 AS VARCHAR)) END AS key FROM events),
    s AS (SELECT DISTINCT key, answer FROM e WHERE first AND done AND answer <> '' AND key IS NOT NULL) SELECT event_id, e.key, CASE WHEN first THEN s.answer END AS kept_answer FROM e LEFT JOIN s ON e.key = s.key"""


def opened_tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tools whose terms a question names, else those whose card is near it."""
    questions = _made(spark, sf_dir, "nation", "n_nationkey AS question_id", "concat('Ships of ', n_name, '?') AS question", "array(1F, float(n_nationkey)) AS question_embedding")
    cards = spark.createDataFrame([("figures", ["france", "united kingdom"], [1.0, 0.0]), ("routes", ["china"], [0.0, 1.0])], "tool string, terms array<string>, embedding array<float>")
    return context.tool_gate(questions, cards)


OPENED_TOOLS = """WITH t AS (SELECT * FROM (VALUES ('figures', ['france', 'united kingdom'], 1.0::DOUBLE, 0.0::DOUBLE), ('routes', ['china'], 0.0::DOUBLE, 1.0::DOUBLE)) v(tool, terms, x, y)),
    m AS (SELECT n_nationkey AS question_id, tool, len(list_filter(terms, lambda w: contains(' ' || array_to_string(regexp_extract_all(lower('Ships of ' || n_name || '?'), '[a-z0-9]+'), ' ') || ' ', ' ' || w || ' '))) > 0 AS named, (x + n_nationkey * y) / sqrt(1 + n_nationkey * n_nationkey) >= 0.51 AS near FROM nation, t),
    b AS (SELECT *, bool_or(named) OVER (PARTITION BY question_id) AS any_named FROM m) SELECT question_id, tool FROM b WHERE CASE WHEN any_named THEN named ELSE near END"""


def addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The divisions that blocks cite, each once and in order."""
    one = "named_struct('instrument', CASE WHEN l_partkey % {n} = 0 THEN 'act' END, 'article', CASE WHEN l_linenumber <> {n} THEN string(l_suppkey % 2) END, 'paragraph', string(null), 'point', string(null), 'annex', CASE WHEN l_linenumber = 3 THEN '' END)"
    blocks = _made(spark, sf_dir, "lineitem", "l_orderkey * 10 + l_linenumber AS block_id", "'own' AS celex", f"array({one.format(n=2)}, {one.format(n=3)}, {one.format(n=2)}) AS references")
    said = F.transform("addresses", lambda a: F.concat_ws("/", a["celex"], F.coalesce(a["article"], F.lit("-")), F.coalesce(a["annex"], F.lit("-"))))
    return context.cited_addresses(blocks).select("block_id", F.array_join(said, ";").alias("addresses"))


ADDRESSES = """WITH r AS (SELECT l_orderkey * 10 + l_linenumber AS block_id, l_linenumber AS k, CASE WHEN l_partkey % 2 = 0 THEN 'act' ELSE 'own' END AS c2, CASE WHEN l_partkey % 3 = 0 THEN 'act' ELSE 'own' END AS c3, CAST(l_suppkey % 2 AS VARCHAR) AS a, CASE WHEN l_linenumber = 3 THEN '' ELSE '-' END AS x FROM lineitem),
    p AS (SELECT block_id, CASE WHEN k <> 2 THEN c2 || '/' || a || '/' || x END AS f, CASE WHEN k <> 3 THEN c3 || '/' || a || '/' || x ELSE c3 || '/-/' || x END AS g FROM r)
    SELECT block_id, CASE WHEN f IS NULL THEN g WHEN f = g THEN f ELSE f || ';' || g END AS addresses FROM p"""


def marked_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.source_events(_made(spark, sf_dir, "lineitem", "l_orderkey AS context_id", "8 - l_linenumber AS place")).select("context_id", "place", "marker")


MARKED_SOURCES = "SELECT l_orderkey AS context_id, 8 - l_linenumber AS place, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY 8 - l_linenumber) AS INTEGER) AS marker FROM lineitem"


def refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = _made(spark, sf_dir, "events", "event_id", "CASE WHEN event_id % 3 = 0 THEN array('retrieve', 'assess', 'refuse') ELSE array('retrieve', 'refuse') END AS steps", "map('a', event_type, 'b', CASE WHEN event_id % 2 = 0 THEN '' ELSE string(event_id) END) AS args")
    return runs.select("event_id", context.refusal_reason().alias("reason"), text.described_arguments("args").alias("arguments"), text.failure_reason(F.lit("E"), F.map_values("args")[1], 5).alias("failure"), text.mentions(F.map_values("args")[0], ["click", "sign up"]).alias("mentions"))


REFUSALS = """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'insufficient_context' ELSE 'nothing_retrieved' END AS reason, event_type || CASE WHEN event_id % 2 = 0 THEN '' ELSE ' · ' || CAST(event_id AS VARCHAR) END AS arguments,
    left('E: ' || CASE WHEN event_id % 2 = 0 THEN '' ELSE CAST(event_id AS VARCHAR) END, 5) AS failure, event_type = 'click' AS mentions FROM events"""


def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = _made(spark, sf_dir, "lineitem", "l_orderkey * 10 + l_linenumber AS id", "CASE WHEN l_linenumber < 5 THEN string(l_partkey % 9) END AS article", "CASE WHEN l_linenumber % 2 = 0 THEN '2' END AS paragraph", "CASE WHEN l_linenumber % 3 = 0 THEN 'e' END AS point", "CASE l_linenumber WHEN 5 THEN 'I' WHEN 6 THEN '' END AS annex", "concat('32009R0', lpad(l_partkey % 200, 3, '0')) AS celex", "concat('Commission Regulation (EU) No ', l_partkey % 200, '/2009 of 3 May') AS title")
    return made.select("id", identifiers.citation(F.col("article"), F.col("paragraph"), F.col("point"), F.col("annex")).alias("citation"), identifiers.act_name(F.col("celex"), F.when(F.col("id") % 2 == 0, F.col("title"))).alias("act"))


CITATIONS = """WITH b AS (SELECT l_orderkey * 10 + l_linenumber AS id, CASE WHEN l_linenumber < 5 THEN 'Article ' || CAST(l_partkey % 9 AS VARCHAR) || CASE WHEN l_linenumber % 2 = 0 THEN '(2)' ELSE '' END WHEN l_linenumber = 5 THEN 'Annex I' WHEN l_linenumber = 6 THEN 'Annex' ELSE '' END AS base, l_linenumber AS n, l_partkey % 200 AS k FROM lineitem)
    SELECT id, base || CASE WHEN base <> '' AND n % 3 = 0 THEN ', point (e)' ELSE '' END AS citation, CASE WHEN id % 2 = 0 THEN 'Regulation (EU) No ' || CAST(k AS VARCHAR) || '/2009' ELSE '32009R0' || lpad(CAST(k AS VARCHAR), 3, '0') END AS act FROM b"""


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = _made(spark, sf_dir, "lineitem", "l_orderkey * 10 + l_linenumber AS id", "concat('m', l_linenumber) AS model", "l_partkey AS input_tokens", "l_suppkey AS output_tokens")
    known = spark.createDataFrame([("m1", 2.0, 4.0), ("m2", 1.0, 8.0)], "model string, input_usd double, output_usd double")
    return ledger.priced(calls, known).select("id", F.round("cost_usd", 9).alias("cost_usd"))


PRICES = "SELECT l_orderkey * 10 + l_linenumber AS id, round(CASE l_linenumber WHEN 1 THEN (l_partkey * 2.0::DOUBLE + l_suppkey * 4.0::DOUBLE) / 1e6 WHEN 2 THEN (l_partkey * 1.0::DOUBLE + l_suppkey * 8.0::DOUBLE) / 1e6 END, 9) AS cost_usd FROM lineitem"


def stored_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addressed pages, their bytes checked against recorded hashes, some of which are wrong."""
    pages = _made(spark, sf_dir, "pages", "concat('3', page_id) AS celex", "concat('0', page_id) AS resolved_celex", "html").where("trim(html) <> ''")
    kept = store.addressed(pages).withColumns({"content": F.col("stored").cast("binary"), "recorded": F.when(F.col("size_bytes") % 3 == 0, F.lit("gone")).otherwise(F.col("sha256"))})
    same, other = store.verified(kept.drop("sha256").withColumnRenamed("recorded", "sha256"))
    return same.withColumn("same", F.lit(True)).unionByName(other.withColumn("same", F.lit(False))).select("celex", "key", "size_bytes", "same")


STORED_DOCUMENTS = r"""WITH s AS (SELECT page_id, regexp_replace(html, '(?is)<script\b[^>]*>.*?</script\s*>', '', 'g') AS t FROM pages WHERE trim(html) <> '')
    SELECT '3' || CAST(page_id AS VARCHAR) AS celex, '3' || CAST(page_id AS VARCHAR) || '/0' || CAST(page_id AS VARCHAR) || '/' || sha256(t) || '.html' AS key, CAST(strlen(t) AS BIGINT) AS size_bytes, strlen(t) % 3 <> 0 AS same FROM s"""


def serving(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _made(spark, sf_dir, "orders", "concat('3', o_orderkey) AS celex", "array(concat('v', o_custkey % 50), concat('v', o_custkey % 30)) AS candidates")
    held = _made(spark, sf_dir, "supplier", "concat('v', s_suppkey % 40) AS version").where("version <> 'v3'").unionByName(table(spark, sf_dir, "orders").where("o_orderkey % 2 = 0").selectExpr("concat('3', o_orderkey) AS version"))
    return store.serving_versions(docs, held)


SERVING = """WITH h AS (SELECT DISTINCT 'v' || CAST(s_suppkey % 40 AS VARCHAR) AS v FROM supplier WHERE s_suppkey % 40 <> 3), d AS (SELECT '3' || CAST(o_orderkey AS VARCHAR) AS celex, 'v' || CAST(o_custkey % 50 AS VARCHAR) AS a, 'v' || CAST(o_custkey % 30 AS VARCHAR) AS b FROM orders)
    SELECT celex, CASE WHEN a IN (SELECT v FROM h) THEN a WHEN b IN (SELECT v FROM h) THEN b WHEN CAST(celex AS BIGINT) % 2 = 0 THEN celex END AS version FROM d"""


def plain_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = _made(spark, sf_dir, "part", "p_partkey", "CASE p_partkey % 7 WHEN 0 THEN concat(p_name, '/', p_partkey) WHEN 1 THEN concat('/', p_name) WHEN 2 THEN concat(p_name, '/../x') WHEN 3 THEN concat(p_name, '//x') WHEN 4 THEN '' WHEN 5 THEN concat('./', p_name) ELSE p_name END AS key")
    return keys.select("p_partkey", store.valid_key(F.col("key")).alias("plain"))


PLAIN_KEYS = "SELECT p_partkey, p_partkey % 7 IN (0, 6) AS plain FROM part"


def to_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    published = _made(spark, sf_dir, "orders", "int(o_orderkey) AS period", "int(o_custkey % 3) AS version")
    return store.files_to_load(published, _made(spark, sf_dir, "orders", "int(o_orderkey) AS period", "int(o_custkey % 2) AS version").where("period % 4 <> 0"))


TO_LOAD = "SELECT CAST(o_orderkey AS INTEGER) AS period, CAST(o_custkey % 3 AS INTEGER) AS version FROM orders WHERE o_orderkey % 4 = 0 OR o_custkey % 3 <> o_custkey % 2"


def patched(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _made(spark, sf_dir, "customer", "c_custkey AS id", "concat('n', c_custkey) AS name", "c_nationkey AS nation")
    changes = _made(spark, sf_dir, "customer", "c_custkey AS id", "CASE WHEN c_custkey % 3 = 0 THEN array('name') WHEN c_custkey % 3 = 1 THEN array('nation', 'name') ELSE cast(array() AS array<string>) END AS set_fields", "CASE WHEN c_custkey % 2 = 0 THEN 'new' END AS name", "0 AS nation").where("id % 4 <> 0")
    return store.updated(rows, changes, "id")


PATCHED = """SELECT c_custkey AS id, CASE WHEN c_custkey % 4 <> 0 AND c_custkey % 3 < 2 THEN CASE WHEN c_custkey % 2 = 0 THEN 'new' END ELSE 'n' || CAST(c_custkey AS VARCHAR) END AS name,
    CASE WHEN c_custkey % 4 <> 0 AND c_custkey % 3 = 1 THEN 0 ELSE c_nationkey END AS nation FROM customer"""


def votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last vote on each request; a null one takes it back."""
    held = _made(spark, sf_dir, "orders", "o_orderkey AS request_id", "CASE WHEN o_orderkey % 5 = 0 THEN 'up' END AS vote", "CASE WHEN o_orderkey % 5 = 0 THEN timestamp '2024-01-01 00:00:00' END AS voted_at")
    cast_ = _made(spark, sf_dir, "lineitem", "l_orderkey AS request_id", "CASE l_linenumber % 3 WHEN 0 THEN 'down' WHEN 1 THEN 'up' END AS vote", "timestamp_seconds(l_linenumber) AS voted_at")
    return store.voted(held, cast_).select("request_id", "vote", F.unix_seconds("voted_at").alias("voted_at"))


VOTES = """WITH l AS (SELECT l_orderkey AS k, max(l_linenumber) AS n FROM lineitem GROUP BY 1)
    SELECT o_orderkey AS request_id, CASE WHEN k IS NOT NULL THEN CASE n % 3 WHEN 0 THEN 'down' WHEN 1 THEN 'up' END WHEN o_orderkey % 5 = 0 THEN 'up' END AS vote, CASE WHEN k IS NOT NULL THEN CASE WHEN n % 3 < 2 THEN CAST(n AS BIGINT) END WHEN o_orderkey % 5 = 0 THEN 1704067200 END AS voted_at FROM orders LEFT JOIN l ON k = o_orderkey"""


def step_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    states = _made(spark, sf_dir, "orders", "o_orderkey AS id", "CASE WHEN o_orderkey % 3 <> 0 THEN 'a' ELSE '' END AS answer", "transform(sequence(1, int(o_custkey % 3 + 1)), i -> named_struct('step', concat('s', i), 'ms', i * 10)) AS steps")
    requests, steps = store.split_requests(states)
    return steps.join(requests.withColumnRenamed("id", "chat_request_id"), "chat_request_id").select("chat_request_id", "position", "step", "ms", "answer")


STEP_ROWS = "SELECT o_orderkey AS chat_request_id, CAST(i - 1 AS INTEGER) AS position, 's' || CAST(i AS VARCHAR) AS step, CAST(i * 10 AS INTEGER) AS ms, CASE WHEN o_orderkey % 3 <> 0 THEN 'a' END AS answer FROM (SELECT o_orderkey, unnest(range(1, o_custkey % 3 + 2)) AS i FROM orders)"

_PAIRS = {
    "stamp_drift": (drifted, DRIFTED), "already_shown": (shown, f"WITH {_REVIEW} SELECT call_id FROM shown"), "planned_calls": (planned, PLANNED), "cited_hop": (hopped, HOPPED), "first_topics": (first_topics, FIRST_TOPICS),
    "reusable_documents": (reused, REUSED), "run_status": (run_statuses, RUN_STATUSES), "unembedded_page": (paged, PAGED), "reconcile_actions": (reconcile_actions, RECONCILE_ACTIONS), "tuning_order": (tuned, TUNED), "selected_cases": (chosen_cases, CHOSEN_CASES),
    "kept_answers": (kept_answers, KEPT_ANSWERS), "opened_tools": (opened_tools, OPENED_TOOLS), "cited_addresses": (addresses, ADDRESSES), "source_markers": (marked_sources, MARKED_SOURCES), "refusals": (refusals, REFUSALS), "citations": (citations, CITATIONS), "priced_calls": (prices, PRICES),
    "stored_documents": (stored_documents, STORED_DOCUMENTS), "serving_versions": (serving, SERVING), "plain_keys": (plain_keys, PLAIN_KEYS), "files_to_load": (to_load, TO_LOAD), "updated_rows": (patched, PATCHED), "votes": (votes, VOTES), "request_steps": (step_rows, STEP_ROWS),
}
QUERIES = {name: query for name, (query, _) in _PAIRS.items()}
ORACLES = {name: sql for name, (_, sql) in _PAIRS.items()}
