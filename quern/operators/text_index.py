"""A kept index for the text leg: postings in blocks with bounds on their gains, searched without the chunks' texts.

A chunk lies in a block by a hash of its id. For each lexeme and block that has it the table of postings holds a row: ids,
counts and lengths of its chunks, and the greatest count and least length among them, which bound what the lexeme can add to a
score there, whatever the corpus's mean length becomes. The table is partitioned by a hash of the lexeme. A lexeme of many
chunks has many rows, none longer than a block.

A search reads the blocks' bounds first, without their ids. All queries are scored in the most promising blocks of each; the
score of a query's last place there is its bar, and of the others only blocks are looked at whose bounds, added up, reach the
bar of some query. So the result is that of scoring every chunk.

An index is made block by block: chunks are dealt by their blocks, so that counting their words and gathering a block's
postings shuffles the texts once and no words.

Changes come as generations: a generation has the postings of chunks that were added or updated, and the ids that were deleted
or updated, whose older postings count no more; counts of lexemes and lengths are added up over generations. `compacted`
writes what stands as one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators import search
from quern.shipping import ensure
from quern.streaming.groups import shared

#: Chunks of a block, about; blocks that a query is scored in first; blocks for a partition of the table, and its partitions at most.
BLOCK, FIRST, BLOCKS, MOST_BUCKETS = 512, 4, 16, 256


@dataclass(frozen=True)
class TextIndex:
    """An index's folder and how it was made."""

    path: str
    blocks: int
    buckets: int = 4
    analyse: Callable[[Column], Column] = search.plain_lexemes
    fields: dict[str, int] | None = None

    def table(self, spark: SparkSession, name: str, upto: int | None = None) -> DataFrame:
        """postings, lexemes (their chunks), removed, or sizes, by generation, those after `upto` left out."""
        every = spark.read.schema(_SCHEMAS[name]).parquet(f"{self.path}/{name}")
        return every if upto is None else every.where(F.col("gen") <= upto)


_SCHEMAS = {
    "postings": "lexeme string, block int, n int, most_tf long, least_chars int, ids array<long>, tfs array<long>, chars array<int>, gen int, bucket int",
    "lexemes": "lexeme string, n long, gen int, bucket int",
    "removed": "id long, gen int",
    "sizes": "chunks long, chars long, gen int",
}


def _bucket(index: TextIndex) -> Column:
    return F.pmod(F.xxhash64("lexeme"), F.lit(index.buckets)).cast("int")


#: Blocks of a task that makes postings; rows of postings that it hands on at once.
TASK_BLOCKS, HANDED = 16, 5000
_ROWS = "lexeme string, block int, n int, most_tf long, least_chars int, ids array<long>, tfs array<long>, chars array<int>"
_ARROW = pa.schema([("lexeme", pa.string()), ("block", pa.int32()), ("n", pa.int32()), ("most_tf", pa.int64()), ("least_chars", pa.int32()), ("ids", pa.list_(pa.int64())), ("tfs", pa.list_(pa.int64())), ("chars", pa.list_(pa.int32()))])


def _posted(block: int, held: list[pa.RecordBatch], weights: list[int]) -> Iterator[pa.RecordBatch]:
    """A block's postings: of each lexeme its chunks, with the sum of the weights of the fields that it stands in, each time it does."""
    chunks = pa.Table.from_batches(held).combine_chunks()
    n, ids, chars = chunks.num_rows, chunks.column("id").to_numpy(), chunks.column("chars").to_numpy()
    words, owners, times = [], [], []
    for i, w in enumerate(weights):
        for lists in chunks.column(f"_f{i}").chunks:
            found, owner = lists.flatten(), np.repeat(np.arange(n), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
            words.append(found.drop_null())
            owners.append(owner[found.is_valid().to_numpy(zero_copy_only=False)] if found.null_count else owner)
            times.append(np.full(len(words[-1]), w))
    coded = pa.concat_arrays(words).dictionary_encode()
    if not len(coded):
        return
    pairs, place = np.unique(coded.indices.to_numpy().astype(np.int64) * n + np.concatenate(owners), return_inverse=True)
    tf = np.bincount(place, np.concatenate(times)).astype(np.int64)
    lexeme, own = pairs // n, pairs % n
    start = np.flatnonzero(np.diff(lexeme, prepend=-1))
    ends = np.append(start, len(pairs)).astype(np.int32)
    listed = lambda x, kind: pa.ListArray.from_arrays(pa.array(ends), pa.array(x, kind))
    columns = [coded.dictionary.take(pa.array(lexeme[start])), pa.array(np.full(len(start), block), pa.int32()), pa.array(np.diff(ends), pa.int32()), pa.array(np.maximum.reduceat(tf, start)), pa.array(np.minimum.reduceat(chars[own], start), pa.int32())]
    rows = pa.RecordBatch.from_arrays([*columns, listed(ids[own], pa.int64()), listed(tf, pa.int64()), listed(chars[own], pa.int32())], schema=_ARROW)
    for at in range(0, rows.num_rows, HANDED):
        yield rows.slice(at, HANDED)


def _entries(chunks: DataFrame, index: TextIndex, key: str, body: str) -> DataFrame:
    """Rows of postings of the chunks, which are dealt by block first: what follows by block needs no shuffle. A block's words are
    counted and gathered as arrays."""
    named = chunks.withColumnRenamed(key, "id") if key != "id" else chunks
    # lengths go with the texts: in a selection with the words, each word's row would hold its text, and count its characters again
    told = named.withColumns({"_chars": F.coalesce(F.length(body), F.lit(0)), "_block": F.pmod(F.xxhash64("id"), F.lit(index.blocks)).cast("int")})
    dealt = told.repartition(max(chunks.sparkSession.sparkContext.defaultParallelism, index.blocks // TASK_BLOCKS), "_block").sortWithinPartitions("_block")
    fields = index.fields or {"text": 1}
    weights = list(fields.values())
    lexemes = dealt.select(F.col("_block").alias("block"), F.col("id").cast("long").alias("id"), F.col("_chars").alias("chars"), *(index.analyse(F.coalesce(F.col(c), F.lit(""))).alias(f"_f{i}") for i, c in enumerate(fields)))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for batch in batches:
            blocks = batch.column("block").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(blocks)) + 1).tolist(), len(blocks)]
            for a, b in zip(cuts, cuts[1:]):  # noqa: B905
                if a < b and blocks[a] != at:
                    if held:
                        yield from _posted(at, held, weights)
                    at, held = int(blocks[a]), []
                held.append(batch.slice(a, b - a))
        if held:
            yield from _posted(at, held, weights)

    return lexemes.mapInArrow(gather, _ROWS)


def _gathered(entries: DataFrame) -> DataFrame:
    """Rows of postings from lexeme, id, tf, chars, block."""
    each = F.collect_list(F.struct("id", "tf", "chars")).alias("e")
    rows = entries.groupBy("lexeme", "block").agg(F.count("*").cast("int").alias("n"), F.max("tf").cast("long").alias("most_tf"), F.min("chars").alias("least_chars"), each)
    return rows.select("lexeme", "block", "n", "most_tf", "least_chars", F.col("e.id").alias("ids"), F.col("e.tf").cast("array<long>").alias("tfs"), F.col("e.chars").alias("chars"))


def _counts(index: TextIndex, chunks: DataFrame, key: str) -> DataFrame:
    """lexeme, n: how many of the chunks hold it."""
    every = [index.analyse(F.coalesce(F.col(c), F.lit(""))) for c in index.fields or {"text": 1}]
    return chunks.select(F.explode(F.array_distinct(F.flatten(F.array(*every)))).alias("lexeme")).groupBy("lexeme").agg(F.count("*").alias("n"))


def _write(index: TextIndex, gen: int, rows: DataFrame, less: DataFrame | None, removed: DataFrame, sizes: DataFrame) -> None:
    """A generation from its rows of postings; its counts of lexemes are those of its own postings less those of `less`."""
    spark = rows.sparkSession
    rows = rows.withColumn("bucket", _bucket(index))
    # a partition's rows go to few files, as each search opens them all; more only where there would be fewer than tasks
    files = max(-(-index.blocks // (BLOCKS * MOST_BUCKETS)), -(-2 * spark.sparkContext.defaultParallelism // index.buckets))
    # sorted, so that a row group's least and greatest lexemes tell which searches need it
    rows.repartition("bucket", F.col("block") % files).sortWithinPartitions("bucket", "lexeme", "block").write.mode("overwrite").partitionBy("bucket").parquet(f"{index.path}/postings/gen={gen}")
    counts = index.table(spark, "postings").where(F.col("gen") == gen).groupBy("lexeme").agg(F.sum(F.col("n").cast("long")).alias("n"))
    if less is not None:
        counts = counts.unionByName(less.select("lexeme", (-F.col("n")).alias("n"))).groupBy("lexeme").agg(F.sum("n").alias("n"))
    counts.withColumn("bucket", _bucket(index)).repartition("bucket").sortWithinPartitions("bucket", "lexeme").write.mode("overwrite").partitionBy("bucket").parquet(f"{index.path}/lexemes/gen={gen}")
    removed.write.mode("overwrite").parquet(f"{index.path}/removed/gen={gen}")
    sizes.write.mode("overwrite").parquet(f"{index.path}/sizes/gen={gen}")  # last: a generation without sizes isn't there yet


def _sizes(chunks: DataFrame, body: str | None) -> DataFrame:
    """chunks, chars of all chunks; without a body their lengths are in chars."""
    return chunks.agg(F.count("*").alias("chunks"), F.coalesce(F.sum(F.length(body) if body else F.col("chars")), F.lit(0)).alias("chars"))


def build(chunks: DataFrame, path: str, key: str = "id", body: str = "text", analyse: Callable[[Column], Column] = search.plain_lexemes, fields: dict[str, int] | None = None) -> TextIndex:
    """Writes the index of all chunks (distinct ids) to a folder."""
    spark = ensure(chunks.sparkSession)
    shared(spark)
    blocks = max(1, -(-chunks.count() // BLOCK))
    index = TextIndex(path, blocks, min(MOST_BUCKETS, max(4, blocks // BLOCKS)), analyse, fields)
    _write(index, 0, _entries(chunks, index, key, body), None, spark.createDataFrame([], "id long"), _sizes(chunks, body))
    return index


def generation(spark: SparkSession, index: TextIndex) -> int:
    """The last complete generation."""
    return index.table(spark, "sizes").agg(F.max("gen")).first()[0]


def changed(index: TextIndex, actions: DataFrame, stored: DataFrame, incoming: DataFrame, key: str = "id", body: str = "text") -> int:
    """Brings the index up to date with actions (id, action as of a reconciliation) on stored chunks; gives the new generation.

    stored has the chunks as they were, and incoming as they are, by id; of both only the rows that actions name are read.
    """
    spark = ensure(actions.sparkSession)
    gen = generation(spark, index) + 1
    gone = actions.where("action in ('delete', 'update')").select(F.col(key).alias("id")).distinct()
    come = actions.where("action in ('add', 'update')").select(F.col(key).alias("id")).distinct()
    old, new = (df.withColumnRenamed(key, "id").join(search.few(ids), "id", "left_semi") for df, ids in ((stored, gone), (incoming, come)))
    lengths = lambda df, ids: _sizes(df.select(F.col(key).alias("id"), F.length(body).alias("chars")).join(search.few(ids), "id", "left_semi"), None)
    less, more = lengths(stored, gone), lengths(incoming, come)
    sizes = less.select((-F.col("chunks")).alias("chunks"), (-F.col("chars")).alias("chars")).unionByName(more).agg(F.sum("chunks").alias("chunks"), F.sum("chars").alias("chars"))
    _write(index, gen, _entries(new, index, "id", body), _counts(index, old, "id"), gone, sizes)
    return gen


def _standing(entries: DataFrame, removed: DataFrame) -> DataFrame:
    """Entries (id, gen) that no later generation has removed."""
    last = removed.groupBy("id").agg(F.max("gen").alias("out"))
    return entries.join(search.few(last), "id", "left").where("out is null or gen >= out").drop("out")


def _each(rows: DataFrame, *columns: str) -> DataFrame:
    """The columns with id, tf and chars of every entry of the rows."""
    return rows.select(*columns, F.explode(F.arrays_zip("ids", "tfs", "chars")).alias("e")).select(*columns, F.col("e.ids").alias("id"), F.col("e.tfs").alias("tf"), F.col("e.chars").alias("chars"))


def compacted(index: TextIndex, spark: SparkSession, path: str) -> TextIndex:
    """What stands, as one generation in another folder."""
    shared(spark)
    new = TextIndex(path, index.blocks, index.buckets, index.analyse, index.fields)
    last = generation(spark, index)
    rows = _each(index.table(spark, "postings", last), "lexeme", "block", "gen")
    entries = _standing(rows, index.table(spark, "removed", last)).drop("gen")
    sizes = index.table(spark, "sizes", last).agg(F.sum("chunks").alias("chunks"), F.sum("chars").alias("chars"))
    _write(new, 0, _gathered(entries), None, spark.createDataFrame([], "id long"), sizes)
    return new


def index_terms(queries: DataFrame, index: TextIndex, upto: int | None = None) -> DataFrame:
    """query_id, lexeme, df, bucket: the distinct lexemes of queries with their chunks in the whole corpus; those of none are left out."""
    spark = queries.sparkSession
    terms = queries.select("query_id", F.explode(F.array_distinct(index.analyse(F.col("query")))).alias("lexeme"))
    asked = search.few(terms.select("lexeme").distinct())
    known = index.table(spark, "lexemes", upto).join(asked, "lexeme", "left_semi").groupBy("lexeme").agg(F.sum("n").alias("df")).where("df > 0")
    return terms.join(search.few(known), "lexeme").withColumn("bucket", _bucket(index))


def text_hits(queries: DataFrame, index: TextIndex, most: int = search.POOL, only: DataFrame | None = None, first: int = FIRST) -> DataFrame:
    """query_id, id, score, text_rank: the best `most` chunks of each query (query_id, query), of the ids in `only` if it is given."""
    spark = ensure(queries.sparkSession)
    shared(spark)
    last = generation(spark, index)  # one that is being written isn't read
    terms = index_terms(queries, index, last).checkpoint()
    total = index.table(spark, "sizes", last).agg(F.sum("chunks").alias("n"), F.sum("chars").alias("c")).first()
    n, mean = total["n"] or 0, (total["c"] or 0) / (total["n"] or 1) or 1.0
    idf = F.log((F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    gain = lambda tf, chars: F.col("idf") * tf * (search.K1 + 1) / (tf + search.K1 * (1 - search.B + search.B * chars / mean))
    weighed = search.few(terms.withColumn("idf", idf).drop("df"))
    asking = search.few(weighed.groupBy("lexeme", "idf").agg(F.collect_list("query_id").alias("asking")).checkpoint())
    buckets = [r.bucket for r in terms.select("bucket").distinct().collect()]  # as many as the table has partitions
    postings = index.table(spark, "postings", last).where(F.col("bucket").isin(*buckets) if buckets else F.lit(False))
    heads = postings.select("bucket", "lexeme", "block", "gen", "most_tf", "least_chars").join(weighed, ["bucket", "lexeme"])
    places = heads.groupBy("query_id", "gen", "block").agg(F.sum(gain(F.col("most_tf"), F.col("least_chars"))).alias("bound")).checkpoint()
    removed = index.table(spark, "removed", last)

    def scored(blocks: DataFrame, bar: DataFrame | None = None) -> DataFrame:
        """The hits of all queries in the blocks (gen, block), those below a query's bar left out. Entries are dealt by chunk before
        they meet the queries: hits are many times as many, and are added up where they arise."""
        wanted = postings.join(search.few(weighed.select("lexeme").distinct()), "lexeme", "left_semi").join(search.few(blocks), ["gen", "block"], "left_semi")
        rows = _standing(_each(wanted, "lexeme", "gen").repartition("id"), removed)
        rows = rows if only is None else rows.join(only.select("id"), "id", "left_semi")
        hits = rows.join(asking, "lexeme").select("id", gain(F.col("tf"), F.col("chars")).alias("gain"), F.explode("asking").alias("query_id"))  # a gain is the same to each query
        sums = hits.groupBy("query_id", "id").agg(F.sum("gain").alias("score"))
        if bar is not None:  # most aren't sorted, then
            sums = sums.join(bar, "query_id", "left").where("least is null or score >= least - 1e-8").drop("least")
        return search.ranked(sums, F.round("score", 9), most, "text_rank").drop("text_rank")

    order = search.ranked(places.withColumn("id", F.struct("gen", "block")), F.col("bound"), first, "place").select("query_id", "gen", "block")
    start = order.select("gen", "block").distinct().checkpoint()
    begun = scored(start).checkpoint()
    bar = begun.groupBy("query_id").agg(F.count("*").alias("found"), F.min(F.round("score", 9)).alias("least")).where(F.col("found") >= most).select("query_id", "least").checkpoint()
    bar = search.few(bar)
    rest = places.join(search.few(start), ["gen", "block"], "left_anti").join(bar, "query_id", "left").where("least is null or bound >= least - 1e-8")
    every = begun.unionByName(scored(rest.select("gen", "block").distinct().checkpoint(), bar))
    return search.ranked(every, F.round("score", 9), most, "text_rank")
