"""What surrounds search: widening hits to sections, following references, interleaving, merging and formatting contexts, routing."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.functions import text, vectors
from quern.operators import search
from quern.operators.vector_index import VectorIndex
from quern.streaming.groups import shared

#: The most parts a followed reference shows, and calls a review may ask for.
FOLLOW_LIMIT, CALL_LIMIT = 5, 4


def section_key() -> Column:
    """The section a chunk was cut from: its article, else the first part's place if it was split, else itself."""
    none = F.lit(None).cast("string")
    of_article = F.struct(F.lit("article").alias("kind"), F.col("celex").alias("celex"), F.col("article").alias("name"))
    of_parts = F.struct(F.lit("parts").alias("kind"), F.col("celex").alias("celex"), (F.col("position") - F.col("part") + 1).cast("string").alias("name"))
    alone = F.struct(F.lit("alone").alias("kind"), none.alias("celex"), F.col("id").cast("string").alias("name"))
    return F.when(F.col("article").isNotNull(), of_article).when(F.col("parts") > 1, of_parts).otherwise(alone)


def expand_sections(hits: DataFrame, chunks: DataFrame, limit: int) -> DataFrame:
    """query_id, id, place: hits (query_id, id, rank) widened to their sections, `limit` chunks a query at most.

    Hits come first, then each section one chunk wider a round, by distance to the section's nearest hit; what is kept
    reads by section rank and document order.
    """
    keyed = chunks.withColumn("section", section_key())
    own = hits.join(keyed.select("id", "section", "position"), "id")
    sections = own.groupBy("query_id", "section").agg(F.min("rank").alias("section_rank"), F.collect_list("position").alias("spots"))  # a query's hits: few
    near = keyed.join(sections, "section").withColumn("distance", F.array_min(F.transform("spots", lambda p: F.abs(F.col("position") - p))))
    hit = F.col("distance") == 0
    rounds = near.withColumn("round", F.row_number().over(W.partitionBy("query_id", "section_rank", hit).orderBy("distance", "position", "part", "id")))
    kept = rounds.withColumn("n", F.row_number().over(W.partitionBy("query_id").orderBy((~hit).cast("int"), "round", "section_rank", "id"))).where(F.col("n") <= limit)
    place = F.row_number().over(W.partitionBy("query_id").orderBy("section_rank", "position", "part", "id"))
    return kept.select("query_id", "id", place.alias("place"))


def targeted(targets: DataFrame, chunks: DataFrame) -> DataFrame:
    """Pairs of targets (target_id, celex, article, paragraph, point, annex) and the chunks of the division they name.

    Articles are compared in lower case, annexes as they are, where '' is an unnumbered annex and null none. A paragraph that
    an article doesn't number is read as a point of it, as it is written; a point is lower-cased.
    """
    t = targets.where(F.col("article").isNotNull() | F.col("annex").isNotNull()).select(*(F.col(c).alias(f"t_{c}") for c in ("target_id", "celex", "article", "paragraph", "point", "annex")))
    same = (F.col("celex") == F.col("t_celex")) & (F.col("t_article").isNull() | (F.lower("article") == F.lower("t_article")))
    same = same & (F.col("t_annex").isNull() | (F.col("annex") == F.col("t_annex")))
    listed = F.col("paragraph").isNull() & F.coalesce(F.array_contains("points", F.col("t_paragraph")), F.lit(False))
    same = same & (F.col("t_paragraph").isNull() | (F.col("paragraph") == F.col("t_paragraph")) | listed)
    same = same & (F.col("t_point").isNull() | F.coalesce(F.array_contains("points", F.lower("t_point")), F.lit(False)))
    return chunks.join(t, same)


def follow_references(targets: DataFrame, chunks: DataFrame, most: int | None = None) -> DataFrame:
    """target_id, id, place: the chunks each target points at, in reading order.

    In an article what stands before the paragraphs leads, then numbers by value and letters after them; an annex reads as
    it stands.
    """
    number = F.regexp_extract("paragraph", "^[0-9]+", 0).try_cast("int")
    letters = F.regexp_extract("paragraph", "^[0-9]*(.*)$", 1)
    in_annex = F.col("t_annex").isNotNull()
    order = [F.when(in_annex, F.col("position")).asc_nulls_first(), F.when(~in_annex, F.col("paragraph").isNotNull()).asc_nulls_first(), F.when(~in_annex, number).asc_nulls_last(), F.when(~in_annex, letters).asc_nulls_last(), F.asc("part"), F.asc("id")]
    placed = targeted(targets, chunks).withColumn("place", F.row_number().over(W.partitionBy("t_target_id").orderBy(*order)))
    return placed.where(F.col("place") <= most if most else F.lit(True)).select(F.col("t_target_id").alias("target_id"), "id", "place")


def division_hashes(targets: DataFrame, chunks: DataFrame) -> DataFrame:
    """target_id, content_hashes of the division, in reading order."""
    placed = follow_references(targets, chunks).join(chunks.select("id", "content_hash"), "id")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("place", "content_hash"))), lambda x: x["content_hash"])
    return placed.groupBy("target_id").agg(ordered.alias("content_hashes"))


def interleaved(hits: DataFrame) -> DataFrame:
    """question_id, id, place: hits (question_id, query_index, rank, id) of several queries, each query's first before any
    query's second; a chunk found twice stands at its earliest place."""
    first = hits.groupBy("question_id", "id").agg(F.min(F.struct("rank", "query_index")).alias("at"))
    return first.select("question_id", "id", F.row_number().over(W.partitionBy("question_id").orderBy("at.rank", "at.query_index")).alias("place"))


@dataclass(frozen=True)
class Retrieved:
    """What a retrieval leaves: every query's hits by question, gated or not; the context; tools of questions without one."""

    hits: DataFrame  # question_id, id, place
    sources: DataFrame  # question_id, id, place
    tools: DataFrame  # question_id, tool


def retrieve(queries: DataFrame, chunks: DataFrame, questions: DataFrame, cards: DataFrame, limit: int = search.RESULTS, context_chunks: int = 20, expand: bool = True, assess: bool = True, rerank: Callable[[DataFrame], DataFrame] | None = None, only: DataFrame | None = None, stats: DataFrame | None = None, nearby: VectorIndex | None = None, where: Column | str | None = None) -> Retrieved:
    """Search of every query (query_id, question_id, query_index, query, query_embedding), the gate query by query, the cleared
    queries' hits interleaved and widened to their sections; questions (question_id, question, question_embedding) none of
    whose queries clears the gate may be opened by a tool instead, if contexts are assessed."""
    of = queries.select("query_id", "question_id", "query_index")
    shared(queries.sparkSession)
    found = search.search(queries, chunks, limit, rerank=rerank, only=only, stats=stats, nearby=nearby, where=where).checkpoint()  # read by the gate, the hits and the tools
    cleared = search.gate(found, queries).where("passes").select("query_id")
    hits = found.join(of, "query_id").select("question_id", "query_index", "rank", "id", "query_id")
    admitted = interleaved(hits.join(cleared, "query_id", "left_semi"))
    sources = admitted
    if expand:
        widened = expand_sections(admitted.select(F.col("question_id").alias("query_id"), "id", F.col("place").alias("rank")), chunks, context_chunks)
        sources = widened.withColumnRenamed("query_id", "question_id")
    shut = questions.join(of.join(cleared, "query_id").select("question_id").distinct(), "question_id", "left_anti")
    tools = tool_gate(shut, cards)
    return Retrieved(interleaved(hits), sources, tools if assess else tools.where(F.lit(False)))


def merged_context(present: DataFrame, additions: DataFrame, cap: int) -> DataFrame:
    """context_id, key, place: a context (context_id, key, place) grown by additions in order of arrival.

    A block already there stays as it was; nothing is added once the whole context has `cap` blocks, and nothing ever leaves.
    """
    both = present.select("context_id", "key", F.lit(0).alias("origin"), "place").unionByName(additions.select("context_id", "key", F.lit(1).alias("origin"), "place"))
    once = both.withColumn("n", F.row_number().over(W.partitionBy("context_id", "key").orderBy("origin", "place"))).where("n = 1 or origin = 0")
    counted = once.withColumn("now", F.row_number().over(W.partitionBy("context_id").orderBy("origin", "place")))
    return counted.where((F.col("origin") == 0) | (F.col("now") <= cap)).select("context_id", "key", F.col("now").alias("place"))


def already_shown(calls: DataFrame, sources: DataFrame) -> DataFrame:
    """Calls (call_id, context_id, name, celex, article, paragraph, point) that would fetch what the context shows.

    Only calls that follow a reference to an article count: shown if a part in the context lists their point, or if their
    paragraph is there with all of its parts.
    """
    follow = calls.where("name = 'follow_reference' and article is not null").withColumn("art", F.lower("article"))
    parts = sources.select("context_id", "celex", F.lower("article").alias("art"), F.col("paragraph").alias("par"), "part", "parts", "points")
    where = ["context_id", "celex", "art"]
    # what a context shows is told once, however many blocks show it: a call meets its article's points and parts, not its blocks
    listed = search.few(parts.select(*where, F.explode("points").alias("listed")).where("listed is not null").distinct())
    pointed = follow.where("point is not null").withColumn("listed", F.lower("point"))
    by_point = pointed.join(listed, [*where, "listed"], "left_semi").select("call_id")
    held = search.few(parts.select(*where, "par", "part", "parts").distinct())
    unpointed = follow.where("point is null").select("call_id", *where, "paragraph").distinct().join(held, where)
    whole = unpointed.where(F.col("par").eqNullSafe(F.col("paragraph"))).groupBy("call_id").agg(F.count_distinct("part").alias("n"), F.max("parts").alias("all")).where("n = all").select("call_id")
    return by_point.unionByName(whole).distinct()


def planned_calls(calls: DataFrame, sources: DataFrame, most: int = CALL_LIMIT) -> DataFrame:
    """The calls (with context_id, call_id, place) that a review runs: a refusal alone stands, one beside fetches goes, as
    do fetches of what is shown; then the first `most`."""
    refusal = F.col("name") == "refuse"
    fetches = calls.where(~refusal)
    lone = calls.where(refusal).join(search.few(fetches.select("context_id").distinct()), "context_id", "left_anti").withColumn("n", F.row_number().over(W.partitionBy("context_id").orderBy("place"))).where("n = 1")
    useful = fetches.join(already_shown(calls, sources), "call_id", "left_anti").withColumn("n", F.row_number().over(W.partitionBy("context_id").orderBy("place"))).where(F.col("n") <= most)
    return lone.select(*calls.columns).unionByName(useful.select(*calls.columns))


@dataclass(frozen=True)
class Round:
    """What a round of calls leaves: contexts (context_id, key, place), and those (context_id) whose review refuses."""

    contexts: DataFrame
    refused: DataFrame


def tool_round(present: DataFrame, calls: DataFrame, sources: DataFrame, chunks: DataFrame, found: DataFrame, cap: int, most: int = CALL_LIMIT) -> Round:
    """The calls that a review makes (as in `planned_calls`, with the annex they name), run and merged into their contexts.

    A followed reference shows at most `FOLLOW_LIMIT` parts; `found` has the hits (call_id, id, place) of calls that search.
    """
    run = planned_calls(calls, sources, most)
    targets = run.where("name = 'follow_reference'").select(F.col("call_id").alias("target_id"), "celex", "article", "paragraph", "point", "annex")
    followed = follow_references(targets, chunks, FOLLOW_LIMIT).select(F.col("target_id").alias("call_id"), "id", F.col("place").alias("part_place"))
    searched = run.where("name = 'search'").select("call_id").join(found.select("call_id", "id", F.col("place").alias("part_place")), "call_id")
    arrived = followed.unionByName(searched).join(run.select("call_id", "context_id", F.col("place").alias("call_place")), "call_id")
    order = W.partitionBy("context_id").orderBy("call_place", "call_id", "part_place")
    additions = arrived.select("context_id", F.col("id").alias("key"), F.row_number().over(order).alias("place"))
    return Round(merged_context(present, additions, cap), run.where("name = 'refuse'").select("context_id"))


def formatted_context(blocks: DataFrame) -> DataFrame:
    """context_id, text: numbered blocks (context_id, place, name, citation, act, act_title, text, footer) as a model reads them.

    Each act with a title is named once above, in order of first appearance; without any there is no legend.
    """
    fields = F.struct("place", "name", "citation", "act", "act_title", "text", "footer")
    grouped = blocks.groupBy("context_id").agg(F.array_sort(F.collect_list(fields)).alias("b"))  # a context is capped
    titled = F.filter("b", lambda x: x["act_title"].isNotNull() & (x["act_title"] != ""))
    acts = F.array_distinct(F.transform(titled, lambda x: x["act"]))
    first = F.transform(acts, lambda a: F.filter(titled, lambda x: x["act"] == a)[0])
    legend = F.when(F.size(acts) > 0, F.array(F.concat(F.lit("Acts:\n"), F.array_join(F.transform(first, lambda x: F.concat(x["name"], F.lit(": "), x["act_title"])), "\n")))).otherwise(F.array().cast("array<string>"))
    body = F.transform("b", lambda x, i: F.concat_ws("\n", F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] ("), x["name"], F.lit(", "), x["citation"], F.lit(")")), x["text"], x["footer"]))
    return grouped.select("context_id", F.array_join(F.concat(legend, body), "\n\n").alias("text"))


def source_events(blocks: DataFrame) -> DataFrame:
    """Blocks with the marker they are cited by, 1 up in order of place."""
    return blocks.withColumn("marker", F.row_number().over(W.partitionBy("context_id").orderBy("place")))


def context_settled(assess_enabled: bool = True, most_rounds: int = 1) -> Column:
    """Whether a run's context is final, from last_step, sources, matched_tools, pending_calls, refused, assess_rounds."""
    shut = (F.col("sources") == 0) & (F.col("matched_tools") == 0)
    return F.when(F.col("last_step") == "retrieve", shut | F.lit(not assess_enabled)).when(F.col("last_step") == "assess", F.col("pending_calls") == 0).when(F.col("last_step").startswith("tool"), F.col("refused") | (F.col("assess_rounds") >= most_rounds)).otherwise(False)


def outcome() -> Column:
    """How a run ended: error, cached, refused, done, or aborted, in this order."""
    visited = lambda step: F.array_contains("steps", step)
    return F.when(F.coalesce(F.col("error"), F.lit("")) != "", "error").when(F.col("cached"), "cached").when(visited("refuse"), "refused").when(visited("synthesize"), "done").otherwise("aborted")


def next_node(assess_enabled: bool = True, decompose: bool = False, most_rounds: int = 1) -> Column:
    """The node that follows a run's last step; null at the end."""
    settled = context_settled(assess_enabled, most_rounds)
    split = F.lit("decompose" if decompose else "retrieve")
    start = F.when(F.col("history") > 0, "rewrite").otherwise(split)
    review = F.when(F.col("refused") | ((F.col("sources") == 0) & settled), "refuse").when(settled, "synthesize").otherwise("assess")
    after_assess = F.when(~settled, "assess_tools").when(F.col("sources") > 0, "synthesize").otherwise("refuse")
    return F.when(F.col("last_step").isNull(), start).when(F.col("last_step") == "rewrite", split).when(F.col("last_step") == "decompose", "retrieve").when(F.col("last_step") == "assess", after_assess).when(F.col("last_step").isin("synthesize", "refuse"), F.lit(None).cast("string")).otherwise(review)


def refusal_reason() -> Column:
    """nothing_retrieved where no model reviewed the context, else insufficient_context."""
    return F.when(F.array_contains("steps", "assess"), "insufficient_context").otherwise("nothing_retrieved")


def cache_lookup(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """Requests (key, first) with the answer kept under their key; only first questions are looked up."""
    return requests.join(cache.select("key", F.col("answer").alias("kept_answer")), "key", "left").withColumn("kept_answer", F.when(F.col("first"), F.col("kept_answer")))


def storable(requests: DataFrame) -> DataFrame:
    """key, answer of requests whose answers are kept: first questions that were done, with an answer."""
    return requests.where(F.col("first") & (F.col("outcome") == "done") & F.col("answer").isNotNull() & (F.col("answer") != "") & F.col("key").isNotNull()).select("key", "answer")


def answer_key(build: Column, settings: Column, corpus: Column, figures: Column, normalised: Column) -> Column:
    """What an answer is kept under; null where the corpus has no version."""
    return F.when(corpus.isNotNull(), F.concat_ws(":", build, F.left(settings, F.lit(12)), corpus, figures, F.sha2(normalised, 256)))


#: Tools that may be registered.
MOST_TOOLS = 1_000


def tool_gate(questions: DataFrame, cards: DataFrame, bar: float = 0.51) -> DataFrame:
    """question_id, tool: tools one of whose terms a question has as whole words, else those whose card is near it.

    cards: tool, terms, embedding; one row a tool.
    """
    if cards.limit(MOST_TOOLS + 1).count() > MOST_TOOLS:
        raise ValueError(f"more than {MOST_TOOLS} tools are registered")
    listed = cards.agg(F.collect_list(F.struct("tool", "terms", "embedding")).alias("cards"))  # one row, as tools are few
    both = questions.crossJoin(F.broadcast(listed)).select("question_id", "question", "question_embedding", F.explode("cards").alias("card")).select("question_id", "question", "question_embedding", "card.*")
    padded = F.concat(F.lit(" "), text.name_key("question"), F.lit(" "))
    named = F.exists("terms", lambda t: padded.contains(F.concat(F.lit(" "), t, F.lit(" "))))
    near = vectors.cosine(F.col("question_embedding"), F.col("embedding")) >= bar
    marked = both.select("question_id", "tool", named.alias("named"), F.coalesce(near, F.lit(False)).alias("near"))
    any_named = F.max("named").over(W.partitionBy("question_id"))
    return marked.withColumn("use", F.when(any_named, F.col("named")).otherwise(F.col("near"))).where("use").select("question_id", "tool")


def cited_addresses(blocks: DataFrame) -> DataFrame:
    """block_id, addresses: the divisions a block cites, each once in order, those that name no article or annex left out."""
    r = F.transform("references", lambda x: F.struct(F.coalesce(x["instrument"], F.col("celex")).alias("celex"), x["article"].alias("article"), x["paragraph"].alias("paragraph"), x["point"].alias("point"), x["annex"].alias("annex")))
    return blocks.select("block_id", F.array_distinct(F.filter(r, lambda x: x["article"].isNotNull() | x["annex"].isNotNull())).alias("addresses"))
