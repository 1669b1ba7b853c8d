"""Search, and what surrounds it. Queries are the benchmark's items; chunks are documents or their lines."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators import context, search, text_index, vector_index
from quern.plans.tables import LINES, lines, spread, table
from quern.streaming.groups import shared


def _queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def _bm25s(spark: SparkSession, sf_dir: str, *legs: tuple[int, str | None]) -> list[DataFrame]:
    """The text legs with so many hits among the documents of a language, or of all, from the same postings."""
    docs = table(spark, sf_dir, "documents").withColumnRenamed("doc_id", "id")
    queries = _queries(spark, sf_dir)
    posted = search.postings(search.dealt(docs), asked=search.lexemes(queries), body="text")
    shared(spark)
    terms, stats = search.query_terms(queries, posted).checkpoint(), search.corpus_stats(docs)  # terms: the queries' words
    return [search.bm25_leg(posted, terms, None if lang is None else docs.where(F.col("lang") == lang), stats, most) for most, lang in legs]


def _bm25(spark: SparkSession, sf_dir: str, most: int = 10, lang: str | None = None) -> DataFrame:
    return _bm25s(spark, sf_dir, (most, lang))[0]


_BM25 = """q AS (SELECT item_id AS query_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS lexeme FROM benchmark),
    p AS (SELECT doc_id AS id, lexeme, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS lexeme FROM documents) GROUP BY ALL),
    df AS (SELECT lexeme, count(*) AS df FROM p GROUP BY lexeme), s AS (SELECT count(*) AS n, avg(length(text)) AS mean FROM documents),
    scored AS (SELECT query_id, p.id, sum(ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE) + 1) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * length(d.text) / mean))) AS score
        FROM q JOIN p USING (lexeme) JOIN df USING (lexeme) JOIN documents d ON d.doc_id = p.id, s WHERE {where} GROUP BY ALL),
    text_leg AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS INTEGER) AS text_rank FROM scored QUALIFY text_rank <= {most})"""


def bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bm25(spark, sf_dir).select("query_id", "id", "text_rank", F.round("score", 4).alias("score"))


def bm25_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bm25(spark, sf_dir, 5, "fr").select("query_id", "id", "text_rank", F.round("score", 4).alias("score"))


def _vector(spark: SparkSession, sf_dir: str, most: int) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    q = e.where("id % 100 = 0").select((F.col("id") / 100).cast("long").alias("query_id"), F.col("embedding").alias("query_embedding"))
    return search.vector_leg(search.few(q), e, most)


_VECTOR = """v AS (SELECT q.vec_id // 100 AS query_id, c.vec_id AS id, list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]) AS cos FROM embeddings q, embeddings c WHERE q.vec_id % 100 = 0),
    vector_leg AS (SELECT query_id, id, cos, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(cos, 9) DESC, id) AS INTEGER) AS vector_rank FROM v QUALIFY vector_rank <= {most})"""


def vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vector(spark, sf_dir, 10).select("query_id", "id", "vector_rank", F.round("cosine_similarity", 5).alias("cosine_similarity"))


def vector_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifty hits of each query through the index: how many, the nearest, and whether it finds 95 in 100 of what the exact leg finds;
    and the same among every third vector only."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", (F.col("vec_id") % 3).alias("third"))
    index = vector_index.build(e, _folder(spark), keep=("third",))
    q = e.where("id % 100 = 0").select((F.col("id") / 100).cast("long").alias("query_id"), F.col("embedding").alias("query_embedding"))
    legs = []
    for name, where in (("all", "true"), ("third", "third = 0")):
        near = vector_index.index_hits(q, index, 50, where).checkpoint()
        both = near.join(search.vector_leg(q, e.where(where), 50).select("query_id", "id", F.lit(1).alias("exact")), ["query_id", "id"], "full_outer")
        recall = both.agg((F.count_if(F.expr("vector_rank is not null and exact is not null")) >= 0.95 * F.count("exact")).alias("recall_ok"))
        hits = near.groupBy("query_id").agg(F.count("*").alias("hits"), F.max(F.when(F.col("vector_rank") == 1, F.col("id"))).alias("nearest"))
        legs.append(hits.crossJoin(F.broadcast(recall)).select(F.lit(name).alias("leg"), "query_id", "hits", "nearest", "recall_ok"))  # one row
    return legs[0].unionByName(legs[1])


VECTOR_INDEXED = " UNION ALL ".join(
    f"""SELECT '{name}' AS leg, query_id, least(count(*), 50) AS hits, arg_min(id, (-round(cos, 9), id)) AS nearest, true AS recall_ok FROM (
        SELECT q.vec_id // 100 AS query_id, c.vec_id AS id, list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]) AS cos FROM embeddings q, embeddings c WHERE q.vec_id % 100 = 0 AND {where}) GROUP BY query_id"""
    for name, where in (("all", "true"), ("third", "c.vec_id % 3 = 0"))
)


def _folder(spark: SparkSession) -> str:
    shared(spark)
    return f"{spark.sparkContext.getCheckpointDir() or spark.conf.get('spark.checkpoint.dir')}/indexes/{uuid.uuid4().hex}"


def bm25_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same ten as bm25_topk from a kept index that began with other texts: a third of the documents was stored in an older form,
    a fifth wasn't there, and some that were have gone since."""
    now = spread(table(spark, sf_dir, "documents")).select(F.col("doc_id").alias("id"), "text")
    odd, gone = F.col("id") % 3 == 0, 1 << 40
    stored = now.where("id % 5 <> 1").select("id", F.when(odd, F.concat("text", F.lit(" as it was before"))).otherwise(F.col("text")).alias("text"))
    stored = stored.unionByName(now.where("id % 7 = 2").select((F.col("id") + gone).alias("id"), "text"))
    index = text_index.build(stored, _folder(spark))
    actions = now.where("id % 5 = 1").select("id", F.lit("add").alias("action")).unionByName(now.where(odd & (F.col("id") % 5 != 1)).select("id", F.lit("update").alias("action")))
    text_index.changed(index, actions.unionByName(stored.where(F.col("id") >= gone).select("id", F.lit("delete").alias("action"))), stored, now)
    return text_index.text_hits(_queries(spark, sf_dir), index, 10).select("query_id", "id", "text_rank", F.round("score", 4).alias("score"))


def hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = search.fused(_vector(spark, sf_dir, 50), _bm25(spark, sf_dir, 50), 10)
    return both.select("query_id", "id", "rank", "vector_rank", "text_rank", F.round("rrf_score", 8).alias("rrf_score"))


def gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = search.fused(_vector(spark, sf_dir, 50), _bm25(spark, sf_dir, 50), 10).withColumn("reranker_relevance", F.when(F.col("id") % 2 == 0, F.col("rrf_score") * 20))
    return search.gate(hits, _queries(spark, sf_dir))


_FUSED = f"""{_BM25.format(where="true", most=50)}, {_VECTOR.format(most=50)},
    f AS (SELECT query_id, id, vector_rank, text_rank, cos, coalesce(1.0::DOUBLE / (60 + vector_rank), 0) + coalesce(1.0::DOUBLE / (60 + text_rank), 0) AS rrf FROM vector_leg FULL JOIN text_leg USING (query_id, id)),
    top AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(rrf, 12) DESC, id) AS INTEGER) AS rank FROM f QUALIFY rank <= 10)"""


def words_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "benchmark").select(F.explode(F.split("text", " ")).alias("word")).distinct()
    posted = search.postings(spread(table(spark, sf_dir, "documents")).withColumnRenamed("doc_id", "id"), asked=search.lexemes(words, text="word"))
    return search.words_in_corpus(words, posted, ["the", "of"])


WORDS_FOUND = """WITH p AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS lexeme FROM documents), w AS (SELECT DISTINCT unnest(string_split(text, ' ')) AS word FROM benchmark),
    l AS (SELECT word, len(list_distinct(regexp_extract_all(lower(word), '[a-z0-9]+'))) AS n, unnest(list_distinct(regexp_extract_all(lower(word), '[a-z0-9]+'))) AS lexeme FROM w WHERE lower(word) NOT IN ('the', 'of'))
    SELECT word FROM w WHERE lower(word) IN ('the', 'of') UNION SELECT DISTINCT word FROM (SELECT word, doc_id, n, count(*) AS k FROM l JOIN p USING (lexeme) GROUP BY ALL) WHERE k = n"""


def cover_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents")).withColumnRenamed("doc_id", "id")
    # the items' bare words: no quotes, minus or `or`, which SQL's sweep doesn't read; tests have those
    words = F.array_join(F.filter(search.plain_lexemes(F.col("query")), lambda w: w != "or"), " ")
    return search.cover_density_leg(_queries(spark, sf_dir).withColumn("query", words), docs, 10).select("query_id", "id", F.round("score", 6).alias("score"), "text_rank")


#: Each place where a query's words end in a document, with where the span that holds all of them begins: the words' last places before it.
COVER_DENSITY = """WITH RECURSIVE t AS (SELECT item_id AS query_id, unnest(list_filter(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')), lambda x: x <> 'or')) AS lexeme FROM benchmark),
    wanted AS (SELECT query_id, count(*) AS wanted FROM t GROUP BY query_id),
    d AS (SELECT doc_id AS id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents),
    s AS (SELECT id, unnest(range(len(w))) AS place, unnest(w) AS lexeme FROM d),
    e AS (SELECT query_id, id, place, lexeme, row_number() OVER (PARTITION BY query_id, id ORDER BY place) AS i, wanted FROM s JOIN t USING (lexeme) JOIN wanted USING (query_id)
        QUALIFY count(DISTINCT lexeme) OVER (PARTITION BY query_id, id) = wanted),
    sweep AS (SELECT query_id, id, i, place, wanted, map([lexeme], [place]) AS last FROM e WHERE i = 1
        UNION ALL SELECT e.query_id, e.id, e.i, e.place, e.wanted, map_concat(sweep.last, map([e.lexeme], [e.place])) FROM sweep JOIN e ON e.query_id = sweep.query_id AND e.id = sweep.id AND e.i = sweep.i + 1),
    spans AS (SELECT query_id, id, i, place, list_min(map_values(last)) AS begin FROM sweep WHERE cardinality(last) = wanted),
    covers AS (SELECT query_id, id, begin, min(i) AS i, min(place) AS place FROM spans GROUP BY ALL),
    scored AS (SELECT c.query_id, c.id, sum(0.2::DOUBLE / (1 + (c.place - c.begin) - (c.i - e.i))) AS score FROM covers c JOIN e ON e.query_id = c.query_id AND e.id = c.id AND e.place = c.begin GROUP BY ALL)
    SELECT query_id, id, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS INTEGER) AS text_rank FROM scored QUALIFY text_rank <= 10"""


def expanded(spark: SparkSession, sf_dir: str) -> DataFrame:
    ls = lines(spark, sf_dir)
    hits = ls.where("position = 2").select((F.floor(F.col("id") / 100000) % 50).alias("query_id"), "id").withColumn("rank", F.floor(F.col("id") / 100000))
    return context.expand_sections(hits, ls, 6)


EXPANDED = f"""WITH {LINES}, hits AS (SELECT (id // 100000) % 50 AS query_id, id, id // 100000 AS rank FROM lines WHERE position = 2),
    k AS (SELECT *, CASE WHEN article IS NOT NULL THEN 'a' || celex || '/' || article ELSE 'i' || CAST(id AS VARCHAR) END AS section FROM lines),
    s AS (SELECT query_id, section, min(rank) AS section_rank, list(position) AS spots FROM hits JOIN k USING (id) GROUP BY ALL),
    n AS (SELECT k.*, query_id, section_rank, list_min(list_transform(spots, lambda x: abs(k.position - x))) AS distance FROM k JOIN s USING (section)),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id, section_rank, distance = 0 ORDER BY distance, position, part, id) AS round FROM n),
    t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance <> 0, round, section_rank, id) AS c FROM r QUALIFY c <= 6)
    SELECT query_id, id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY section_rank, position, part, id) AS INTEGER) AS place FROM t"""


def _targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    k = F.col("doc_id")
    none = F.lit(None).cast("string")
    return d.select(k.alias("target_id"), k.cast("string").alias("celex"), F.when(k % 5 != 0, F.lit("1")).alias("article"), F.when(k % 3 == 0, F.lit("2")).alias("paragraph"), F.when(k % 4 == 0, F.lit("3")).alias("point"), none.alias("annex"))


def followed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.follow_references(_targets(spark, sf_dir), lines(spark, sf_dir))


FOLLOWED = f"""WITH {LINES}, t AS (SELECT doc_id AS target_id, CAST(doc_id AS VARCHAR) AS c, CASE WHEN doc_id % 3 = 0 THEN '2' END AS par, CASE WHEN doc_id % 4 = 0 THEN '3' END AS pt FROM documents WHERE doc_id % 5 <> 0)
    SELECT target_id, id, CAST(row_number() OVER (PARTITION BY target_id ORDER BY paragraph IS NOT NULL, TRY_CAST(regexp_extract(paragraph, '^[0-9]+', 0) AS INTEGER) NULLS LAST, regexp_extract(paragraph, '^[0-9]*(.*)$', 1) NULLS LAST, part, id) AS INTEGER) AS place
    FROM t JOIN lines ON celex = c AND lower(article) = '1' AND (par IS NULL OR paragraph = par OR (paragraph IS NULL AND list_contains(points, par))) AND (pt IS NULL OR list_contains(points, pt))"""


def interleaved(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = _bm25(spark, sf_dir).select((F.floor(F.col("query_id") / 4)).alias("question_id"), (F.col("query_id") % 4).alias("query_index"), F.col("text_rank").alias("rank"), "id")
    return context.interleaved(hits)


INTERLEAVED = f"""WITH {_BM25.format(where="true", most=10)}, h AS (SELECT query_id // 4 AS question_id, id, min((text_rank, query_id % 4)) AS spot FROM text_leg GROUP BY ALL)
    SELECT question_id, id, CAST(row_number() OVER (PARTITION BY question_id ORDER BY spot) AS INTEGER) AS place FROM h"""


def merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits, english = _bm25s(spark, sf_dir, (4, None), (5, "en"))
    present = hits.select(F.col("query_id").alias("context_id"), F.col("id").alias("key"), F.col("text_rank").alias("place"))
    other = english.select(F.col("query_id").alias("context_id"), F.col("id").alias("key"), F.col("text_rank").alias("place"))
    return context.merged_context(present, other, 6)


MERGED = f"""WITH {_BM25.format(where="true", most=4)}, en AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS r FROM scored JOIN documents ON doc_id = id WHERE lang = 'en' QUALIFY r <= 5),
    b AS (SELECT query_id, id, 0 AS o, text_rank AS place FROM text_leg UNION ALL SELECT query_id, id, 1, r FROM en), u AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY query_id, id ORDER BY o, place) = 1),
    n AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY o, place) AS INTEGER) AS now FROM u)
    SELECT query_id AS context_id, id AS key, now AS place FROM n WHERE o = 0 OR now <= 6"""


def weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 over citations, titles and texts; what a document is cited as is its source and language."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", F.concat_ws(" ", "source", "lang").alias("citation"), F.substring("text", 1, 40).alias("title"))
    queries = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.concat("text", F.lit(" en web")).alias("query"))
    posted = search.postings(search.dealt(docs), fields={"citation": search.CITATION_WEIGHT, "title": 1, "text": 1}, asked=search.lexemes(queries), body="text")
    return search.bm25_leg(posted, search.query_terms(queries, posted), None, search.corpus_stats(docs), 10).select("query_id", "id", "text_rank", F.round("score", 4).alias("score"))


_WEIGHTED = _BM25.replace("lower(text), '[a-z0-9]+'))) AS lexeme FROM benchmark", "lower(text || ' en web'), '[a-z0-9]+'))) AS lexeme FROM benchmark").replace(
    "p AS (SELECT doc_id AS id, lexeme, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS lexeme FROM documents) GROUP BY ALL)",
    """w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS lexeme, 1 AS w FROM documents UNION ALL SELECT doc_id, unnest(regexp_extract_all(lower(substr(text, 1, 40)), '[a-z0-9]+')), 1 FROM documents
        UNION ALL SELECT doc_id, unnest(regexp_extract_all(lower(concat_ws(' ', source, lang)), '[a-z0-9]+')), 4 FROM documents),
    p AS (SELECT doc_id AS id, lexeme, sum(w) AS tf FROM w GROUP BY ALL)""",
)


def retrieved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The retrieve node over questions of four queries each: what their contexts hold, and the tools of those without one."""
    docs = table(spark, sf_dir, "documents")
    k = F.col("doc_id")
    vectors_ = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    chunks = docs.join(vectors_, "doc_id", "full_outer").select(
        k.alias("id"), "text", "embedding", F.coalesce("lang", F.lit("")).alias("celex"), F.when(k % 3 == 0, F.floor(k / 10).cast("string")).alias("article"), k.cast("int").alias("position"), F.lit(1).alias("part"), F.lit(1).alias("parts")
    )
    queries = _queries(spark, sf_dir).join(vectors_.where("doc_id % 100 = 0").select((k / 100).cast("long").alias("query_id"), F.col("embedding").alias("query_embedding")), "query_id", "left")
    queries = queries.withColumns({"question_id": F.floor(F.col("query_id") / 4), "query_index": F.col("query_id") % 4})
    questions = queries.where("query_index = 0").select("question_id", F.col("query").alias("question"), F.col("query_embedding").alias("question_embedding"))
    cards = spark.createDataFrame([("figures", ["zzz"], None), ("other", [], None)], "tool string, terms array<string>, embedding array<float>")
    node = context.retrieve(queries, chunks, questions, cards, limit=10, context_chunks=8, stats=search.corpus_stats(docs))
    return node.sources.select("question_id", "id", "place")


RETRIEVED = f"""WITH {_FUSED}, gated AS (SELECT query_id, coalesce(max(cos) >= 0.4, true) AS ok FROM top GROUP BY query_id),
    cleared AS (SELECT query_id // 4 AS question_id, id, min((rank, query_id % 4)) AS spot FROM top JOIN gated USING (query_id) WHERE ok AND query_id IN (SELECT item_id FROM benchmark) GROUP BY ALL),
    hits AS (SELECT question_id, id, row_number() OVER (PARTITION BY question_id ORDER BY spot) AS rank FROM cleared),
    ids AS (SELECT coalesce(doc_id, vec_id) AS id, coalesce(lang, '') AS celex FROM documents FULL JOIN embeddings ON doc_id = vec_id),
    k AS (SELECT *, CASE WHEN id % 3 = 0 THEN 'a' || celex || '/' || CAST(id // 10 AS VARCHAR) ELSE 'i' || CAST(id AS VARCHAR) END AS section FROM ids),
    sec AS (SELECT question_id, section, min(rank) AS section_rank, list(id) AS spots FROM hits JOIN k USING (id) GROUP BY ALL),
    near AS (SELECT k.*, question_id, section_rank, list_min(list_transform(spots, lambda x: abs(k.id - x))) AS distance FROM k JOIN sec USING (section)),
    rounds AS (SELECT *, row_number() OVER (PARTITION BY question_id, section_rank, distance = 0 ORDER BY distance, id) AS round FROM near),
    kept AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY distance <> 0, round, section_rank, id) AS o FROM rounds QUALIFY o <= 8)
    SELECT question_id, id, CAST(row_number() OVER (PARTITION BY question_id ORDER BY section_rank, id) AS INTEGER) AS place FROM kept"""


def routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    k = F.col("event_id")
    step = F.element_at(F.array(*map(F.lit, ("retrieve", "assess", "tool_search", "synthesize", "rewrite"))), (k % 5 + 1).cast("int"))
    state = e.select(
        "event_id", F.when(k % 9 != 0, step).alias("last_step"), (k % 3).alias("sources"), (F.floor(k / 3) % 2).alias("matched_tools"), (F.floor(k / 2) % 2).alias("pending_calls"), (k % 7 == 0).alias("refused"), (k % 2).alias("assess_rounds"), (k % 4).alias("history"),
        F.when(k % 13 == 0, "boom").alias("error"), (k % 6 == 0).alias("cached"), F.when(k % 2 == 0, F.array(F.lit("retrieve"), F.lit("synthesize"))).when(k % 3 == 0, F.array(F.lit("refuse"))).otherwise(F.array(F.lit("retrieve"))).alias("steps"),
    )
    return state.select("event_id", context.context_settled().alias("settled"), context.next_node().alias("next_node"), context.outcome().alias("outcome"))


ROUTED = """WITH s AS (SELECT event_id AS k, CASE WHEN event_id % 9 <> 0 THEN ['retrieve', 'assess', 'tool_search', 'synthesize', 'rewrite'][event_id % 5 + 1] END AS step, event_id % 3 AS sources, (event_id // 3) % 2 AS tools, (event_id // 2) % 2 AS pending,
      event_id % 7 = 0 AS refused, event_id % 2 AS rounds, event_id % 4 AS history FROM events),
    t AS (SELECT *, CASE WHEN step = 'retrieve' THEN sources = 0 AND tools = 0 WHEN step = 'assess' THEN pending = 0 WHEN step = 'tool_search' THEN refused OR rounds >= 1 ELSE false END AS settled FROM s)
    SELECT k AS event_id, settled, CASE WHEN step IS NULL THEN CASE WHEN history > 0 THEN 'rewrite' ELSE 'retrieve' END WHEN step = 'rewrite' THEN 'retrieve'
        WHEN step = 'assess' THEN CASE WHEN NOT settled THEN 'assess_tools' WHEN sources > 0 THEN 'synthesize' ELSE 'refuse' END WHEN step = 'synthesize' THEN NULL
        WHEN refused OR (sources = 0 AND settled) THEN 'refuse' WHEN settled THEN 'synthesize' ELSE 'assess' END AS next_node,
      CASE WHEN k % 13 = 0 THEN 'error' WHEN k % 6 = 0 THEN 'cached' WHEN k % 2 <> 0 AND k % 3 = 0 THEN 'refused' WHEN k % 2 = 0 THEN 'done' ELSE 'aborted' END AS outcome FROM t"""

QUERIES = {"bm25_topk": bm25, "bm25_filtered": bm25_filtered, "vector_topk": vector, "vector_indexed": vector_indexed, "bm25_indexed": bm25_indexed, "hybrid_topk": hybrid, "gate": gate, "words_in_corpus": words_found, "cover_density": cover_density, "expand_sections": expanded, "follow_references": followed, "interleaved": interleaved, "merged_context": merged, "routing": routed, "bm25_weighted": weighted, "retrieve_node": retrieved}
ORACLES = {
    "bm25_topk": f"WITH {_BM25.format(where='true', most=10)} SELECT query_id, id, text_rank, round(score, 4) AS score FROM text_leg",
    "cover_density": COVER_DENSITY,
    "bm25_indexed": f"WITH {_BM25.format(where='true', most=10)} SELECT query_id, id, text_rank, round(score, 4) AS score FROM text_leg",
    "bm25_filtered": f"""WITH {_BM25.format(where="d.lang = 'fr'", most=5)} SELECT query_id, id, text_rank, round(score, 4) AS score FROM text_leg""",
    "vector_topk": f"WITH {_VECTOR.format(most=10)} SELECT query_id, id, vector_rank, round(cos, 5) AS cosine_similarity FROM vector_leg",
    "vector_indexed": VECTOR_INDEXED,
    "hybrid_topk": f"WITH {_FUSED} SELECT query_id, id, rank, vector_rank, text_rank, round(rrf, 8) AS rrf_score FROM top",
    "gate": f"""WITH {_FUSED}, b AS (SELECT query_id, max(cos) AS c, max(CASE WHEN id % 2 = 0 THEN rrf * 20 END) AS r FROM top GROUP BY query_id)
        SELECT item_id AS query_id, CASE WHEN b.query_id IS NULL THEN false ELSE coalesce(c >= 0.4, true) AND coalesce(r >= 0.6, true) END AS passes FROM benchmark LEFT JOIN b ON b.query_id = item_id""",
    "words_in_corpus": WORDS_FOUND, "expand_sections": EXPANDED, "follow_references": FOLLOWED, "interleaved": INTERLEAVED, "merged_context": MERGED, "routing": ROUTED, "retrieve_node": RETRIEVED,
    "bm25_weighted": f"WITH {_WEIGHTED.format(where='true', most=10)} SELECT query_id, id, text_rank, round(score, 4) AS score FROM text_leg",
}
