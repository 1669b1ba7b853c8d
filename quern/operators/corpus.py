"""Keeping a corpus current: choosing acts, standing documents, reconciling chunks, pruning, versions and reports."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.functions import identifiers
from quern.shipping import ensure
from quern.streaming.groups import shared

#: The topic of documents that were only cited, and the loss of documents that stops a run.
HOP_TOPIC = "cited"
MOST_DROPPED, MOST_DROPPED_SHARE = 3, 0.2


class CorpusError(ValueError):
    """An input that would harm the stored corpus."""


def folded_acts(rows: DataFrame) -> DataFrame:
    """celex, in_force, title, consolidations, basis_articles: one row an act from the rows a discovery query repeats it in."""
    order = F.struct("seq")
    return rows.groupBy("celex").agg(F.min_by("in_force", order).alias("in_force"), F.min_by("title", order).alias("title"), F.array_sort(F.collect_set("consolidation")).alias("consolidations"), F.array_sort(F.collect_set("basis_article")).alias("basis_articles"))


def discovered(based_on: DataFrame, base: DataFrame) -> DataFrame:
    """The rows of a discovery: of acts based on a topic's base act, and of the base act itself, each row once."""
    return based_on.unionByName(base).distinct()


def own_consolidations() -> Column:
    """An act's own consolidated versions, newest first."""
    stem = identifiers.consolidated_stem(F.col("celex"))
    return F.reverse(F.array_sort(F.filter("consolidations", lambda c: c.startswith(stem))))


def fetchable(acts: DataFrame) -> DataFrame:
    """Acts in force (null is not) that aren't folded into another act's consolidations."""
    folded = (F.size("consolidations") > 0) & (F.size(own_consolidations()) == 0)
    return acts.where(F.col("in_force").eqNullSafe(F.lit(True)) & ~folded)


def adopted_under(pattern: str) -> Column:
    """Whether a basis article begins the way the pattern does."""
    return F.exists("basis_articles", lambda b: b.rlike(f"^(?:{pattern})"))


def select_documents(rows: DataFrame, topic: str, base: str | None = None, kept: str | None = None, excluded: str | None = None) -> DataFrame:
    """topic, celex, candidates, title of the acts that a topic fetches."""
    acts = fetchable(folded_acts(rows.where(identifiers.is_legislation(F.col("celex")))))
    if kept and base:
        acts = acts.where((F.col("celex") == base) | adopted_under(kept))
    if excluded:
        acts = acts.where(~adopted_under(excluded))
    return acts.select(F.lit(topic).alias("topic"), "celex", own_consolidations().alias("candidates"), "title")


def first_topics(documents: DataFrame) -> DataFrame:
    """Documents of several topics, each act once, for the topic that comes first (topic_order)."""
    return documents.withColumn("_n", F.row_number().over(W.partitionBy("celex").orderBy("topic_order"))).where("_n = 1").drop("_n")


def dropped(discovered: DataFrame, previous: DataFrame) -> DataFrame:
    """Acts (celex) that were there before and weren't found now."""
    return previous.select("celex").distinct().join(discovered.select("celex"), "celex", "left_anti")


def check_shrink(discovered: DataFrame, previous: DataFrame) -> int:
    """The number of dropped acts; raises if they are at least three and more than a fifth of those before."""
    lost, before = dropped(discovered, previous).count(), previous.select("celex").distinct().count()
    if lost >= MOST_DROPPED and lost > MOST_DROPPED_SHARE * before:
        raise CorpusError(f"{lost} of {before} acts are gone")
    return lost


def latest_success(runs: DataFrame, documents: DataFrame) -> DataFrame:
    """topic, latest: the last successful run that holds documents of each topic."""
    return documents.join(runs.where("status = 'success'").select(F.col("id").alias("run_id")), "run_id").groupBy("topic").agg(F.max("run_id").alias("latest"))


def standing_documents(documents: DataFrame, runs: DataFrame, topic: str | None = None) -> DataFrame:
    """The newest row of each act from its topic's last successful run on; of all runs where none succeeded."""
    latest = latest_success(runs, documents)
    found = documents.join(latest, "topic", "left").where(F.col("run_id") >= F.coalesce("latest", F.lit(0))).drop("latest")
    if topic is not None:
        found = found.where(F.col("topic") == topic)
    newest = found.groupBy("celex").agg(F.max_by(F.struct(*[c for c in found.columns if c != "celex"]), "run_id").alias("_row"))
    return newest.select("celex", "_row.*")


def document_changes(found: DataFrame, standing: DataFrame) -> DataFrame:
    """celex, change: new, updated or reused by the version that was resolved."""
    before = standing.select("celex", F.col("resolved_celex").alias("_before"))
    change = F.when(F.col("_before").isNull(), "new").when(F.col("_before") == F.col("resolved_celex"), "reused").otherwise("updated")
    return found.join(before, "celex", "left").withColumn("change", change).drop("_before")


def reusable(found: DataFrame, standing: DataFrame) -> DataFrame:
    """Documents whose candidate versions are the same as before and whose stored bytes still have the recorded hash."""
    before = standing.select("celex", F.col("candidates").alias("_candidates"), "resolved_celex", "sha256", "verified")
    return found.join(before, "celex").where(F.col("candidates") == F.col("_candidates")).where("verified").drop("_candidates", "verified")


def occurrences(chunks: DataFrame) -> DataFrame:
    """Chunks with the number of equal ones before them in their document, from 0."""
    return chunks.withColumn("occurrence", F.row_number().over(W.partitionBy("celex", "content_hash").orderBy("position")) - 1)


def reconcile(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """celex, content_hash, occurrence, id, action: what makes the stored chunks match the incoming ones.

    add, delete, keep, or update where the metadata hash differs or was never stored.
    """
    key = ["celex", "content_hash", "occurrence"]
    s = stored.select(*key, "id", F.col("metadata_hash").alias("_old"), F.lit(True).alias("_s"))
    i = incoming.select(*key, F.col("metadata_hash").alias("_new"), F.lit(True).alias("_i"))
    action = F.when(F.col("_s").isNull(), "add").when(F.col("_i").isNull(), "delete").when(F.col("_old").eqNullSafe(F.col("_new")), "keep").otherwise("update")
    return s.join(i, key, "full_outer").select(*key, "id", action.alias("action"))


def reconcile_counts(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """celex, added, deleted, kept, updated; a document whose incoming chunks are none raises."""
    n = lambda a: F.count_if(F.col("action") == a)
    counts = reconcile(stored, incoming).groupBy("celex").agg(n("add").alias("added"), n("delete").alias("deleted"), n("keep").alias("kept"), n("update").alias("updated"))
    emptied = (F.col("deleted") > 0) & (F.col("added") + F.col("kept") + F.col("updated") == 0)
    guard = F.when(emptied, F.raise_error(F.concat("celex", F.lit(": no chunks over stored ones"))).cast("long")).otherwise(F.col("deleted"))
    return counts.withColumn("deleted", guard)


def cited_acts(chunks: DataFrame) -> DataFrame:
    """celex: acts whose articles or annexes the chunks cite; chunks of merely cited documents don't count, so there is one hop."""
    refs = chunks.where(F.col("topic") != HOP_TOPIC).select(F.explode("references").alias("r"))
    named = F.col("r.instrument").isNotNull() & (F.col("r.article").isNotNull() | F.col("r.annex").isNotNull())
    return refs.where(named).select(F.col("r.instrument").alias("celex")).distinct()


def hop(chunks: DataFrame, held: DataFrame) -> DataFrame:
    """Cited acts that aren't held yet."""
    return cited_acts(chunks).join(held.select("celex"), "celex", "left_anti")


def pruned(chunks: DataFrame, keep: DataFrame, complete: bool = True, others: DataFrame | None = None) -> DataFrame:
    """Chunks of the acts to keep, and of those (celex) that other topics still hold; all of them if the corpus isn't complete
    or nothing is to be kept."""
    if not complete or keep.isEmpty():
        return chunks
    keep = keep if others is None else keep.select("celex").unionByName(others.select("celex"))
    return chunks.join(keep.select("celex").distinct(), "celex", "left_semi")


def hashed_in_order(lines: DataFrame, line: str = "line", before: str = "[", between: str = ", ", after: str = "]") -> DataFrame:
    """sha256: of all lines, sorted and joined. One row.

    A hash of a sequence takes it in order, so one task sorts the lines, spilling what doesn't fit, and passes over them with
    nothing but the hash in hand.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, first = hashlib.sha256(before.encode()), True
        for batch in batches:
            for x in batch.column(0).to_pylist():
                digest.update((x if first else between + x).encode("utf-8", "surrogatepass"))
                first = False
        digest.update(after.encode())
        yield pa.RecordBatch.from_pydict({"sha256": [digest.hexdigest()]})

    return lines.select(line).where(F.col(line).isNotNull()).repartition(1).sortWithinPartitions(line).mapInArrow(run, "sha256 string")


def fingerprint(documents: DataFrame, size: int = 7) -> DataFrame:
    """fingerprint: the first digits of SHA-256 over the sorted (celex, resolved, sha256) list."""
    line = F.concat(F.lit('["'), F.concat_ws('", "', "celex", "resolved_celex", "sha256"), F.lit('"]'))
    return hashed_in_order(documents.select(line.alias("line"))).select(F.left("sha256", F.lit(size)).alias("fingerprint"))


#: Distinct lines of a leaf of the tree, about.
LEAF = 4_096


def tree_hash(lines: DataFrame, line: str = "line", digits: int | None = None) -> DataFrame:
    """sha256, n: a hash of all lines, whatever their order, that any number of tasks work out together. One row.

    Lines are counted by their hashes; a leaf holds those whose hashes begin alike, by as many digits as leave leaves of
    `LEAF` lines, and is hashed in their order; then sixteen neighbours at a time are hashed, up to the root. So no task has
    more than a leaf, and equal tables have equal hashes however they are dealt. Null lines are left out.
    """
    hashes = lines.where(F.col(line).isNotNull()).groupBy(F.sha2(line, 256).alias("h")).agg(F.count("*").alias("n"))
    if digits is None:
        distinct, digits = hashes.count(), 0
        while distinct > LEAF * 16**digits:
            digits += 1
    parts = hashes.select(F.left("h", F.lit(digits)).alias("key"), F.concat_ws(":", "h", "n").alias("part"), "n")
    for level in range(digits, -1, -1):
        nodes = parts.groupBy("key").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("part")), ""), 256).alias("digest"), F.sum("n").alias("n"))
        parts = nodes.select(F.left("key", F.lit(max(0, level - 1))).alias("key"), F.concat_ws(":", "key", "digest").alias("part"), "n", "digest")
    return parts.agg(F.coalesce(F.max("digest"), F.sha2(F.lit(""), 256)).alias("sha256"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


def next_version(current: str | None, print_: str, day: str) -> str:
    """The version of a corpus: its day and fingerprint; the current one while the fingerprint is the same."""
    return current if current and current.endswith(print_) else f"{day}-{print_}"


def corpus_stats(chunks: DataFrame) -> DataFrame:
    return chunks.agg(F.count("*").alias("chunk_count"), F.avg(F.length("text")).alias("avg_chunk_chars"))


def unembedded(chunks: DataFrame) -> DataFrame:
    return chunks.where(F.col("embedding").isNull())


def embed_batches(chunks: DataFrame, size: int = 128) -> DataFrame:
    """Chunks without a vector with the batch of their document they are embedded in; batches never span documents."""
    place = F.row_number().over(W.partitionBy("celex").orderBy("position", "id")) - 1
    return unembedded(chunks).withColumn("batch", F.floor(place / size).cast("int"))


_EMBEDDED = "celex string, batch int, id long, embedding array<float>, reason string"


def embed_sweep(chunks: DataFrame, model: Callable[[list[str]], list[list[float]]], path: str, page: int = 50_000, size: int = 128) -> int:
    """Embeds every chunk (id, celex, position, text, embedding) that has no vector yet, there or in the folder; gives how many pages it wrote.

    Pages follow a (celex, id) cursor; each is one job, whose batches go to the model apart and never span documents. A batch
    that fails, or comes back with another number of vectors, is recorded with its reason, and the rest of its page is stored.
    A sweep that is run again takes only what has no vector: failed batches, and pages that an ended run didn't write.
    """
    spark = ensure(chunks.sparkSession)
    shared(spark)

    def embed(batch: pa.Table) -> pa.Table:
        n, vectors, reason = batch.num_rows, None, None
        try:
            vectors = [[float(x) for x in v] for v in model(batch.column("text").to_pylist())]
            if len(vectors) != n:
                vectors, reason = None, f"ValueError: {len(vectors)} vectors for {n} texts"
        except Exception as e:  # a batch fails alone
            reason = f"{type(e).__name__}: {e}"[:500]
        told = {"celex": batch.column("celex"), "batch": batch.column("batch"), "id": batch.column("id"), "embedding": pa.array(vectors or [None] * n, pa.list_(pa.float32())), "reason": pa.array([reason] * n, pa.string())}
        return pa.table(told)

    before = sweep_results(spark, path)
    waiting = unembedded(chunks).join(before.where("reason is null").select("id"), "id", "left_anti").select("celex", "id", "position", "text", "embedding").checkpoint()
    number, cursor, pages = (before.agg(F.max("page")).first()[0] or 0) + 1, None, 0
    while True:
        rest = waiting if cursor is None else waiting.where(F.struct("celex", "id") > F.struct(F.lit(cursor["celex"]).alias("celex"), F.lit(cursor["id"]).cast("long").alias("id")))
        rows = rest.orderBy("celex", "id").limit(page).checkpoint()
        cursor = rows.agg(F.max(F.struct("celex", "id")).alias("last")).first()["last"]
        if cursor is None:
            return pages
        embed_batches(rows, size).groupBy("celex", "batch").applyInArrow(embed, _EMBEDDED).write.mode("overwrite").parquet(f"{path}/page={number}")
        number, pages = number + 1, pages + 1


def sweep_results(spark: SparkSession, path: str) -> DataFrame:
    """celex, batch, id, embedding, reason, page: what sweeps have written; a chunk that failed stands once for each try."""
    try:
        return spark.read.schema(f"{_EMBEDDED}, page int").parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], f"{_EMBEDDED}, page int")


def sweep_report(spark: SparkSession, path: str) -> DataFrame:
    """celex, embedded, failed, reason: a document's chunks with vectors, those whose last try failed, and why."""
    done = sweep_results(spark, path)
    last = done.groupBy("celex", "id").agg(F.max_by("reason", F.struct(F.col("reason").isNull(), "page")).alias("reason"))
    return last.groupBy("celex").agg(F.count_if(F.col("reason").isNull()).alias("embedded"), F.count_if(F.col("reason").isNotNull()).alias("failed"), F.max("reason").alias("reason"))


def after_cursor(chunks: DataFrame, celex: str, id_: int, page: int) -> DataFrame:
    """The page of rows that follow a (celex, id) cursor."""
    return chunks.where(F.struct("celex", "id") > F.struct(F.lit(celex).alias("celex"), F.lit(id_).cast("long").alias("id"))).orderBy("celex", "id").limit(page)


def stage_report(outcomes: DataFrame) -> DataFrame:
    """stage, total and counts of what became of each document in it; the counts sum to the total."""
    n = lambda c: F.count_if(F.col("result") == c).alias(c)
    return outcomes.groupBy("stage").agg(F.count("*").alias("total"), n("new"), n("updated"), n("reused"), n("failed"))


def run_status(outcomes: DataFrame) -> DataFrame:
    """run_id, status: failed where a document of a topic failed; failures of merely cited documents don't count."""
    bad = F.count_if((F.col("result") == "failed") & (F.col("topic") != HOP_TOPIC))
    return outcomes.groupBy("run_id").agg(F.when(bad > 0, "failed").otherwise("success").alias("status"))


def ingested(documents: DataFrame, held: DataFrame, chunked: Callable[[DataFrame], DataFrame], fetched: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Chunks of documents (celex, topic), and of the acts that they cite and nobody holds yet: one hop, under a topic of its own.

    `chunked` gives a document's chunks with their references; `fetched` the documents of acts (celex) that it can get.
    """
    first = chunked(documents)
    have = held.select("celex").unionByName(documents.select("celex"))
    cited = fetched(hop(first, have)).withColumn("topic", F.lit(HOP_TOPIC))
    return first.unionByName(chunked(cited))


def close_out(outcomes: DataFrame, chunks: DataFrame) -> DataFrame:
    """run_id, status, chunk_count, avg_chunk_chars: how runs ended, the successful ones stamped with the corpus's size."""
    stats = F.broadcast(corpus_stats(chunks))  # one row
    stamp = lambda c: F.when(F.col("status") == "success", F.col(c)).alias(c)
    return run_status(outcomes).crossJoin(stats).select("run_id", "status", stamp("chunk_count"), stamp("avg_chunk_chars"))
