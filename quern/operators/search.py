"""Search: BM25 and vector legs, reciprocal rank fusion, rerank, gate. Every stage carries query_id, so many queries run at once.

Top-k is a row number with a bound within the query, which Spark plans as a group limit before the shuffle; filters come
before it in both legs. Every order ends with the id.
"""

from __future__ import annotations

import logging
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.operators import cover, vector_index
from quern.streaming.groups import shared

logger = logging.getLogger(__name__)

#: Fixed values of scoring: saturation and length norm of BM25, weight of a word in a citation, fusion constant, pool sizes.
K1, B, CITATION_WEIGHT, RRF_K, POOL, RERANK_POOL, RESULTS = 1.2, 0.75, 4, 60, 50, 30, 10
MIN_COSINE, MIN_RELEVANCE = 0.4, 0.6


def plain_lexemes(x: Column) -> Column:
    """The plain analyser: lower-case runs of letters a-z and digits."""
    return F.regexp_extract_all(F.lower(x), F.lit("[a-z0-9]+"), F.lit(0))


#: Rows of a side that may be broadcast, after a count; parts of all chunks, one of which is looked at first.
FEW, SLICES = 100_000, 64


def few(df: DataFrame) -> DataFrame:
    """The rows, marked to be broadcast if a count finds them few; else a join shuffles them."""
    return F.broadcast(df) if df.limit(FEW + 1).count() <= FEW else df


def lexemes(queries: DataFrame, analyse: Callable[[Column], Column] = plain_lexemes, text: str = "query") -> DataFrame:
    """lexeme: what any of the queries asks for."""
    return queries.select(F.explode(analyse(F.col(text))).alias("lexeme")).distinct()


def dealt(chunks: DataFrame, key: str = "id") -> DataFrame:
    """Chunks dealt by id, so that their words are counted, and their hits added up, where they are: texts cost less to shuffle
    than their postings, row by row, or than hits."""
    return chunks.repartition(key)


def postings(chunks: DataFrame, analyse: Callable[[Column], Column] = plain_lexemes, key: str = "id", fields: dict[str, int] | None = None, most_positions: int | None = None, asked: DataFrame | None = None, body: str | None = None) -> DataFrame:
    """id, lexeme, tf: how often a chunk holds a lexeme, by the weight of the field (text alone; or, as citations are searched,
    {"citation": CITATION_WEIGHT, "title": 1, "text": 1}) it stands in. With `body` also chars, that column's length.

    With `asked` (column lexeme) only those are posted: the others go before anything is shuffled.
    """
    every = []
    for c, w in (fields or {"text": 1}).items():  # a word counts w times
        found = analyse(F.coalesce(F.col(c), F.lit("")))
        every.append(found if w == 1 else F.flatten(F.array_repeat(found, w)))
    own = [F.col(key).alias("id"), *([F.length(body).alias("chars")] if body else [])]
    words = chunks.select(*own, F.explode(F.concat(*every) if len(every) > 1 else every[0]).alias("lexeme"))
    if asked is not None:
        words = words.join(few(asked), "lexeme", "left_semi")
    tf = F.count("*") if most_positions is None else F.least(F.count("*"), F.lit(most_positions))
    return words.groupBy("id", *(["chars"] if body else []), "lexeme").agg(tf.alias("tf"))


def query_terms(queries: DataFrame, posted: DataFrame, analyse: Callable[[Column], Column] = plain_lexemes, key: str = "query_id", text: str = "query") -> DataFrame:
    """query_id, lexeme, df: the distinct lexemes of each query with their documents in the whole corpus, zero if none."""
    terms = queries.select(F.col(key).alias("query_id"), F.explode(F.array_distinct(analyse(F.col(text)))).alias("lexeme"))
    df = posted.groupBy("lexeme").agg(F.count("*").alias("df"))
    return terms.join(df, "lexeme", "left").select("query_id", "lexeme", F.coalesce("df", F.lit(0)).alias("df"))


def corpus_stats(chunks: DataFrame, body: str = "text") -> DataFrame:
    """chunk_count, avg_chunk_chars: one row, as a run is stamped with it."""
    return chunks.agg(F.count("*").alias("chunk_count"), F.avg(F.length(body)).alias("avg_chunk_chars"))


def ranked(scored: DataFrame, score: Column, most: int, name: str) -> DataFrame:
    """The best `most` rows of each query with their rank, the score falling and then the id."""
    order = W.partitionBy("query_id").orderBy(score.desc_nulls_last(), F.col("id").asc())
    return scored.withColumn(name, F.row_number().over(order)).where(F.col(name) <= most)


def bm25_leg(posted: DataFrame, terms: DataFrame, chunks: DataFrame | None, stats: DataFrame, most: int = POOL, key: str = "id", body: str = "text") -> DataFrame:
    """query_id, id, score, text_rank: chunks with any of the terms. `chunks` is filtered already; df and stats are the whole corpus's.
    Where the postings have chars, no chunks means all of them.

    Postings are dealt by chunk before they meet the queries, so that a chunk's hits, many times its postings, are added up and
    ranked where they arise. One of `SLICES` of all chunks is ranked first: what scores less than a query's last there isn't
    sorted with the others.
    """
    shared(posted.sparkSession)
    idf = F.log((F.col("chunk_count") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    weighed = terms.crossJoin(F.broadcast(stats)).select("query_id", "lexeme", idf.alias("idf"), "avg_chunk_chars").checkpoint()  # stats: one row
    asking = weighed.groupBy("lexeme", "idf", "avg_chunk_chars").agg(F.collect_list("query_id").alias("asking"))
    asking = F.broadcast(asking) if weighed.limit(FEW + 1).count() <= FEW else asking
    norm = 1 - B + B * F.col("chars") / F.col("avg_chunk_chars")
    gain = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * norm)
    if "chars" not in posted.columns:
        posted = posted.join(chunks.select(F.col(key).alias("id"), F.length(body).alias("chars")).hint("merge"), "id")
    elif chunks is not None:
        posted = posted.join(chunks.select(F.col(key).alias("id")), "id", "left_semi")

    def scored(some: DataFrame) -> DataFrame:
        hits = some.join(asking, "lexeme").select("id", gain.alias("gain"), F.explode("asking").alias("query_id"))  # a gain is the same to each query
        return hits.groupBy("query_id", "id").agg(F.sum("gain").alias("score"))

    first = ranked(scored(posted.where(F.pmod(F.xxhash64("id"), F.lit(SLICES)) == 0)), F.round("score", 9), most, "text_rank")
    least = first.groupBy("query_id").agg(F.count("score").alias("n"), F.min("score").alias("least")).where(F.col("n") >= most).select("query_id", "least").checkpoint()
    near = scored(posted).join(few(least), "query_id", "left").where("least is null or score >= least - 1e-8").drop("least")
    return ranked(near, F.round("score", 9), most, "text_rank")


def vector_leg(queries: DataFrame, chunks: DataFrame, most: int = POOL, key: str = "id", vector: str = "embedding", query_vector: str = "query_embedding") -> DataFrame:
    """query_id, id, cosine_similarity, vector_rank: an exact scan; chunks without a vector are left out. `vector_index` has the leg
    that looks only where near vectors are."""
    return vector_index.ranked_hits(vector_index.exact_hits(queries, chunks, most, key, vector, query_vector), most)


def fused(vector_hits: DataFrame, text_hits: DataFrame, limit: int, k: int = RRF_K) -> DataFrame:
    """query_id, id, rrf_score, vector_rank, text_rank, cosine_similarity: both legs by a full outer join."""
    both = vector_hits.select("query_id", "id", "vector_rank", "cosine_similarity").join(text_hits.select("query_id", "id", "text_rank"), ["query_id", "id"], "full_outer")
    part = lambda c: F.coalesce(1.0 / (k + F.col(c)), F.lit(0.0))
    scored = both.withColumn("rrf_score", part("vector_rank") + part("text_rank"))
    return ranked(scored, F.round("rrf_score", 12), limit, "rank")


def reranked(hits: DataFrame, scorer: Callable[[DataFrame], DataFrame], limit: int) -> DataFrame:
    """Hits by the scorer's reranker_relevance; where it gives none for a query, or can't be planned, by the fused order.

    rank is new. A scorer that calls a model while the plan runs is kept from failing by `guarded`.
    """
    try:
        scored = scorer(hits)
    except Exception as e:  # a reranker is never worth an answer
        logger.warning("rerank failed, the fused order stays: %s", e)
        scored = hits.withColumn("reranker_relevance", F.lit(None).cast("double"))
    judged = F.max(F.col("reranker_relevance").isNotNull()).over(W.partitionBy("query_id"))
    order = W.partitionBy("query_id").orderBy(F.when(judged, F.col("reranker_relevance")).desc_nulls_last(), F.col("rrf_score").desc(), F.col("id").asc())
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def guarded(model: Callable[[list[str], list[str]], list[float]], queries: DataFrame, chunks: DataFrame, key: str = "id", body: str = "text") -> Callable[[DataFrame], DataFrame]:
    """A scorer from a model of (queries, texts); hits whose batch it fails on get no relevance."""

    @F.arrow_udf("double")
    def relevance(asked: pa.Array, texts: pa.Array) -> pa.Array:
        try:
            return pa.array(model(asked.to_pylist(), texts.to_pylist()), type=pa.float64())
        except Exception as e:
            logger.warning("a batch wasn't judged: %s", e)
            return pa.nulls(len(asked), pa.float64())

    def score(hits: DataFrame) -> DataFrame:
        words = hits.join(queries.select("query_id", F.col("query").alias("_q")), "query_id").join(chunks.select(F.col(key).alias("id"), F.col(body).alias("_c")), "id")
        return words.withColumn("reranker_relevance", relevance("_q", "_c")).drop("_q", "_c")

    return score


def overlap_scorer(queries: DataFrame, chunks: DataFrame, key: str = "id", body: str = "text") -> Callable[[DataFrame], DataFrame]:
    """A stand-in for a cross-encoder: the share of a query's distinct words that a chunk holds."""

    def score(hits: DataFrame) -> DataFrame:
        words = hits.join(queries.select("query_id", F.array_distinct(plain_lexemes(F.col("query"))).alias("_q")), "query_id").join(chunks.select(F.col(key).alias("id"), plain_lexemes(F.col(body)).alias("_c")), "id")
        share = F.when(F.size("_q") > 0, F.size(F.array_intersect("_q", "_c")) / F.size("_q"))
        return words.withColumn("reranker_relevance", share).drop("_q", "_c")

    return score


def gate(hits: DataFrame, queries: DataFrame, cosine: float = MIN_COSINE, relevance: float = MIN_RELEVANCE) -> DataFrame:
    """query_id, passes: some hits, and the best of each signal at its bar; a signal that no hit has passes, no hits fail."""
    best = hits.groupBy("query_id").agg(F.count("*").alias("n"), F.max("cosine_similarity").alias("c"), F.max("reranker_relevance").alias("r"))
    ok = F.coalesce(F.col("c") >= cosine, F.lit(True)) & F.coalesce(F.col("r") >= relevance, F.lit(True))
    return queries.select("query_id").distinct().join(best, "query_id", "left").select("query_id", F.when(F.coalesce("n", F.lit(0)) == 0, False).otherwise(ok).alias("passes"))


def filtered(chunks: DataFrame, celex: list[str] | None = None, topic: str | None = None) -> DataFrame:
    """Chunks of some acts and a topic; an unset filter passes all, an empty list none. It comes before either leg's limit."""
    if celex is not None:
        chunks = chunks.where(F.col("celex").isin(*celex)) if celex else chunks.where(F.lit(False))
    return chunks if topic is None else chunks.where(F.col("topic") == topic)


#: The two text legs.
BM25, COVER = "bm25", "cover_density"


def search(queries: DataFrame, chunks: DataFrame, limit: int = RESULTS, candidates: int = POOL, rerank: Callable[[DataFrame], DataFrame] | None = None, only: DataFrame | None = None, ranker: str = BM25, fields: dict[str, int] | None = None, stats: DataFrame | None = None, nearby: vector_index.VectorIndex | None = None, where: Column | str | None = None, kept: Callable[[DataFrame, int], DataFrame] | None = None) -> DataFrame:
    """Hybrid search of each query (query_id, query, query_embedding) over chunks (id, text, embedding), `only` the filtered ones.

    Counts of lexemes, and stats unless they are given, are of all chunks. With `nearby`, an index of the chunks' vectors, the
    vector leg asks that, filtered by `where` on the columns it keeps. `kept` gives the text leg of queries and a pool's size
    instead, as `text_index.text_hits` does from a kept index.
    """
    own = chunks if only is None else only
    pool = max(limit, RERANK_POOL) if rerank else limit
    if kept is not None:
        text_hits = kept(queries, candidates)
    elif ranker == BM25:
        posted = postings(dealt(chunks), fields=fields, asked=lexemes(queries), body="text")
        text_hits = bm25_leg(posted, query_terms(queries, posted), only, corpus_stats(chunks) if stats is None else stats, candidates)
    elif ranker == COVER:
        text_hits = cover_density_leg(queries, own, candidates)
    else:
        raise ValueError(f"no ranker {ranker!r}")
    vector_hits = vector_leg(queries, own, candidates) if nearby is None else vector_index.index_hits(queries, nearby, candidates, where)
    hits = fused(vector_hits, text_hits, pool)
    return reranked(hits, rerank, limit) if rerank else hits.withColumn("reranker_relevance", F.lit(None).cast("double"))


def cover_density_leg(queries: DataFrame, chunks: DataFrame, most: int = POOL, key: str = "id", analyse: Callable[[Column], Column] = plain_lexemes, fields: dict[str, str] | None = None) -> DataFrame:
    """query_id, id, score, text_rank: chunks that match web-style queries, by how closely the words stand (`cover`)."""
    return ranked(cover.ranks(queries, chunks, analyse, few, key, fields), F.round("score", 9), most, "text_rank")


def words_in_corpus(words: DataFrame, posted: DataFrame, stop_words: list[str], analyse: Callable[[Column], Column] = plain_lexemes) -> DataFrame:
    """The words (column word) that are stop words, or all of whose lexemes some chunk holds.

    A word of several lexemes is looked for in the chunks of its rarest one: first in one of `SLICES` of all chunks, then, if it
    wasn't there, in all.
    """
    shared(posted.sparkSession)
    stop = words.where(F.lower("word").isin(*stop_words))
    wanted = words.join(stop, "word", "left_anti").select("word", F.array_distinct(analyse(F.col("word"))).alias("ls")).where(F.size("ls") > 0).distinct()
    counts = posted.groupBy("lexeme").agg(F.count("*").alias("n"))
    each = wanted.select("word", "ls", F.explode("ls").alias("lexeme")).join(counts, "lexeme").groupBy("word", "ls").agg(F.count("*").alias("known"), F.min(F.struct("n", "lexeme")).alias("least"))
    known = each.where(F.col("known") == F.size("ls")).select("word", "ls", F.col("least.lexeme").alias("lexeme")).checkpoint()
    many = known.where(F.size("ls") > 1)

    def together(some: DataFrame, among: DataFrame) -> DataFrame:
        held = among.groupBy("id").agg(F.collect_list("lexeme").alias("held"))  # of a chunk, what the words ask for
        met = among.select("id", "lexeme").join(few(some), "lexeme").select("id", "word", "ls")
        return met.join(held.hint("merge"), "id").where(F.forall("ls", lambda x: F.array_contains("held", x))).select("word").distinct().checkpoint()

    early = together(many, posted.where(F.pmod(F.xxhash64("id"), F.lit(SLICES)) == 0))
    late = together(many.join(early, "word", "left_anti"), posted)
    return stop.select("word").unionByName(known.where(F.size("ls") == 1).select("word")).unionByName(early).unionByName(late).distinct()
