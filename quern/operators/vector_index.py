"""The vector leg: an exact scan, and an index that looks only where near vectors are.

The index is an inverted file: cells of a k-means over a bounded sample, and a table of all vectors partitioned by cell, large
cells in parts. A query probes the cells whose centres are nearest; how many is learned when the index is built, from the
sample. Queries whose pool isn't full then (few vectors there, or a filter) probe twice as many next ones, until it is full or
no cell is left. Then they look into every cell left that may hold as near a vector as their nearest, by the angle to its centre
and how far from that its vectors reach: so the nearest is exact, ties included. Hits are ordered by exact cosines and then ids,
whichever cells they come from.

Vectors are compared only with queries that probe their cell, in numpy, a part of a cell at a time: no cross join, and no part
or block of queries larger than a bound, whatever share of all rows one cell holds. Null and zero vectors, and those of another
length than most, have no cosine and are left out.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quern.shipping import ensure
from quern.streaming.groups import shared

#: Bounds: rows and numbers of the sample, vectors of a cell's part, queries of a block and their numbers.
SAMPLE, SAMPLE_NUMBERS, PART, QUERIES, QUERY_NUMBERS = 50_000, 8 << 20, 20_000, 2_000, 1 << 22
#: Vectors of the sample for a cell, rounds of k-means, the recall that probes are learned for and the neighbours it is about.
PER_CELL, ROUNDS, RECALL, NEIGHBOURS = 16, 10, 0.985, 50
_HITS = "query_id long, id long, cosine_similarity double"


def rows_of(column: pa.ChunkedArray | pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The usable vectors of a column at length one, and where they stand."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    at = np.flatnonzero(lengths == size)
    flat = column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    vectors = flat.reshape(len(at), size)
    norm = np.sqrt((vectors * vectors).sum(axis=1))
    good = np.isfinite(norm) & (norm > 0)
    return vectors[good] / norm[good, None], at[good]


def nearest(scores: np.ndarray, ids: np.ndarray, most: int) -> np.ndarray:
    """Places of the best `most` scores, at nine digits, ties by id."""
    scores = np.round(scores, 9)
    if len(scores) > most:
        some = np.flatnonzero(scores >= np.partition(scores, len(scores) - most)[len(scores) - most])
    else:
        some = np.arange(len(scores))
    return some[np.lexsort((ids[some], -scores[some]))[:most]]


def _length(df: DataFrame, vector: str) -> int:
    """The length that most vectors have; 0 without vectors."""
    found = df.where(F.size(vector) > 0).groupBy(F.size(vector).alias("n")).count().orderBy(F.desc("count"), "n").first()
    return found["n"] if found else 0


def exact_hits(queries: DataFrame, chunks: DataFrame, most: int, key: str = "id", vector: str = "embedding", query_vector: str = "query_embedding") -> DataFrame:
    """query_id, id, cosine_similarity: at least the best `most` of each query. Every vector is compared with every query.

    The queries are the stated set; they go out in blocks of bounded size, one scan a block, and a task keeps the best only.
    """
    spark = ensure(queries.sparkSession)
    asked = queries.select(F.col("query_id").cast("long").alias("query_id"), F.col(query_vector).alias("q")).where("q is not null")
    size = _length(asked, "q")
    block = max(1, min(QUERIES, QUERY_NUMBERS // max(1, size)))
    parts = max(1, -(-asked.count() // block))
    numbered = asked.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(parts)))
    legs = []
    for b in range(parts):
        some = numbered.where(F.col("block") == b).toArrow()
        q, at = rows_of(some.column("q"), size) if size and some.num_rows else (np.zeros((0, 1)), np.zeros(0, int))
        query_ids = np.array(some.column("query_id").to_pylist(), dtype=np.int64)[at]
        chosen = chunks.where(F.size(vector) == size).select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v"))
        legs.append(chosen.mapInArrow(_scan(q, query_ids, size, most), _HITS))
    found = legs[0]
    for leg in legs[1:]:
        found = found.unionByName(leg)
    return found if size else spark.createDataFrame([], _HITS)


def _scan(q: np.ndarray, query_ids: np.ndarray, size: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0), np.zeros(0, np.int64))] * len(q)
        for batch in batches:
            v, at = rows_of(batch.column(1), size)
            ids = batch.column(0).to_numpy(zero_copy_only=False)[at]
            scores = q @ v.T
            for i in range(len(q)):
                s, k = np.concatenate([best[i][0], scores[i]]), np.concatenate([best[i][1], ids])
                top = nearest(s, k, most)
                best[i] = (s[top], k[top])
        if any(len(s) for s, _ in best):
            yield _hits(query_ids, best)

    return run


def _hits(query_ids: np.ndarray, best: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    each = [len(s) for s, _ in best]
    return pa.RecordBatch.from_arrays(
        [pa.array(np.repeat(query_ids, each), pa.int64()), pa.array(np.concatenate([k for _, k in best]), pa.int64()), pa.array(np.concatenate([s for s, _ in best]), pa.float64())],
        names=["query_id", "id", "cosine_similarity"],
    )


def ranked_hits(hits: DataFrame, most: int) -> DataFrame:
    order = W.partitionBy("query_id").orderBy(F.round("cosine_similarity", 9).desc(), F.col("id").asc())
    return hits.withColumn("vector_rank", F.row_number().over(order)).where(F.col("vector_rank") <= most)


# the index


def k_means(sample: np.ndarray, cells: int, rounds: int = ROUNDS, seed: int = 1) -> np.ndarray:
    """Centres at length one; a cell that runs empty takes the vector that is farthest from its own centre."""
    rng = np.random.default_rng(seed)
    centres = sample[rng.permutation(len(sample))[:cells]]
    for _ in range(rounds):
        near = assigned(sample, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, sample)
        size = np.sqrt((sums * sums).sum(axis=1))
        empty = np.flatnonzero(size == 0)
        if len(empty):
            far = np.argsort((sample * centres[near]).sum(axis=1))[: len(empty)]
            sums[empty], size[empty] = sample[far], 1.0
        centres = sums / size[:, None]
    return centres


def assigned(vectors: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The cell of each vector, the first of equally near ones."""
    return np.concatenate([np.zeros(0, np.int64), *((vectors[i : i + 4096] @ centres.T).argmax(axis=1) for i in range(0, len(vectors), 4096))])


def probes_for(sample: np.ndarray, centres: np.ndarray, recall: float = RECALL, neighbours: int = NEIGHBOURS) -> int:
    """The least number of cells that find the share of the sample's nearest neighbours, as 200 of its vectors ask."""
    near, asked = assigned(sample, centres), sample[:: max(1, len(sample) // 200)][:200]
    scores = asked @ sample.T
    k = min(neighbours, len(sample))
    found = np.argpartition(-scores, k - 1, axis=1)[:, :k]
    place = np.argsort(np.argsort(-(asked @ centres.T), axis=1), axis=1)  # of each cell in each one's order
    needed = np.sort(np.take_along_axis(place, near[found], axis=1).ravel())
    return int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)]) + 1


@dataclass(frozen=True)
class VectorIndex:
    """A built index: its folder, its centres (a cell a row) and how many cells a query probes first."""

    path: str
    centres: np.ndarray
    probes: int
    columns: str  # of the table, as a schema in JSON

    def vectors(self, spark: SparkSession) -> DataFrame:
        """id, v, the columns kept for filters; partitioned by cell and part."""
        return spark.read.schema(StructType.fromJson(json.loads(self.columns))).parquet(f"{self.path}/vectors")


def build(chunks: DataFrame, path: str, key: str = "id", vector: str = "embedding", keep: tuple[str, ...] = (), sample: int = SAMPLE) -> VectorIndex:
    """Writes the index of all chunks with a usable vector to a folder, with the columns that searches filter by."""
    spark = ensure(chunks.sparkSession)
    shared(spark)
    size = _length(chunks, vector)
    usable = chunks.where(F.size(vector) == size) if size else chunks.where(F.lit(False))
    n = usable.count()
    bound = max(1, min(sample, SAMPLE_NUMBERS // max(1, size)))
    every = -(-n // bound) if n else 1
    drawn = usable.where(F.pmod(F.xxhash64(key), F.lit(every)) == 0).select(F.col(vector).alias("v")).limit(bound).toArrow()
    learned, _ = rows_of(drawn.column("v"), size) if size and drawn.num_rows else (np.zeros((0, 1)), None)
    centres = k_means(learned, max(1, min(round(n**0.5), len(learned) // PER_CELL))) if len(learned) else np.zeros((1, max(1, size)))
    probes = probes_for(learned, centres) if len(learned) else 1

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v, at = rows_of(batch.column(1), size)
            rest = batch.take(pa.array(at))
            cells = assigned(v, centres)
            yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int32()), pa.array((v * centres[cells]).sum(axis=1), pa.float64()), *rest.columns], names=["cell", "near", *rest.schema.names])

    chosen = usable.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v"), *keep)
    cells = chosen.mapInArrow(placed, f"cell int, near double, {', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in chosen.schema.fields)}").checkpoint()
    parts = cells.groupBy("cell").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"), F.min("near").alias("reach")).checkpoint()  # a row a cell
    dealt = cells.join(F.broadcast(parts), "cell").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).drop("parts")
    dealt = dealt.select("id", "v", *keep, "cell", "part")
    dealt.repartition("cell", "part").write.mode("overwrite").partitionBy("cell", "part").parquet(f"{path}/vectors")
    parts.write.mode("overwrite").parquet(f"{path}/parts")
    told = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cell int, centre array<double>")
    told.withColumns({"probes": F.lit(probes), "columns": F.lit(dealt.schema.json())}).write.mode("overwrite").parquet(f"{path}/centres")
    if not spark.read.parquet(f"{path}/parts").take(1):  # a table without rows has no folders
        dealt.limit(0).write.mode("overwrite").parquet(f"{path}/vectors")
    return VectorIndex(path, centres, probes, dealt.schema.json())


def opened(spark: SparkSession, path: str) -> VectorIndex:
    rows = spark.read.parquet(f"{path}/centres").orderBy("cell").collect()  # bounded by the sample
    return VectorIndex(path, np.array([r.centre for r in rows]), rows[0].probes, rows[0]["columns"])


def index_hits(queries: DataFrame, index: VectorIndex, most: int, where: Column | str | None = None, query_vector: str = "query_embedding", probes: int | None = None) -> DataFrame:
    """query_id, id, cosine_similarity, vector_rank: each query's best of the cells it probes, until it has `most` that pass the filter."""
    spark = ensure(queries.sparkSession)
    shared(spark)
    size, cells = index.centres.shape[1], len(index.centres)
    vectors = index.vectors(spark)
    vectors = vectors if where is None else vectors.where(where)
    asked = queries.select(F.col("query_id").cast("long").alias("query_id"), F.col(query_vector).alias("q"))
    reach = {r.cell: r.reach for r in spark.read.parquet(f"{index.path}/parts").select("cell", "reach").collect()}  # cells are bounded by the sample
    reaches = np.array([reach.get(c, np.nan) for c in range(cells)])
    waiting = asked.mapInArrow(_order(index.centres, size, reaches), "query_id long, q array<double>, cells array<int>, bounds array<double>").checkpoint()
    parts = spark.read.parquet(f"{index.path}/parts").select("cell", "parts")
    found, sure, first, width = None, None, 0, probes or index.probes
    while True:
        pairs = waiting.select("query_id", "q", F.explode(F.slice("cells", first + 1, width)).alias("cell"))
        pairs = pairs if sure is None else pairs.unionByName(sure)
        probed = sorted(r.cell for r in pairs.select("cell").distinct().collect())
        if not probed:
            break
        near = _compared(vectors.where(F.col("cell").isin(*probed)), pairs, parts, size, most)
        found = ranked_hits(near if found is None else found.unionByName(near), most).drop("vector_rank").checkpoint()
        full = found.groupBy("query_id").agg(F.count("*").alias("n"), F.max(F.round("cosine_similarity", 9)).alias("best")).where(F.col("n") >= most)
        first, width = first + width, 2 * width
        left = F.slice(F.arrays_zip("cells", "bounds"), first + 1, cells)
        may = waiting.join(full, "query_id").select("query_id", "q", F.explode(F.filter(left, lambda c: c["bounds"] >= F.col("best") - 1e-8)).alias("c"))
        sure = may.select("query_id", "q", F.col("c.cells").alias("cell")).checkpoint()
        waiting = waiting.join(full, "query_id", "left_anti").checkpoint()
    return ranked_hits(spark.createDataFrame([], _HITS) if found is None else found, most)


def _order(centres: np.ndarray, size: int, reaches: np.ndarray):
    """Each query's cells, the nearest first, with the greatest cosine that a vector there can have (-2 where none is)."""
    widest = np.arccos(np.clip(reaches, -1.0, 1.0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q, at = rows_of(batch.column(1), size)
            near = q @ centres.T
            cells = np.argsort(-near, axis=1, kind="stable").astype(np.int32)
            bounds = np.nan_to_num(np.cos(np.maximum(0.0, np.arccos(np.clip(near, -1.0, 1.0)) - widest)), nan=-2.0)
            bounds = np.take_along_axis(bounds, cells, axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(list(q), pa.list_(pa.float64())), pa.array(list(cells), pa.list_(pa.int32())), pa.array(list(bounds), pa.list_(pa.float64()))], names=["query_id", "q", "cells", "bounds"])

    return run


def _compared(vectors: DataFrame, pairs: DataFrame, parts: DataFrame, size: int, most: int) -> DataFrame:
    """Hits of queries (query_id, q, cell) among the vectors of their cells; a part of a cell meets a block of queries at a time."""
    blocks = pairs.groupBy("cell").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("blocks"))
    shape = F.broadcast(parts.join(blocks, "cell").checkpoint())  # a row a cell
    task = lambda name: F.explode(F.sequence(F.lit(0), F.col(name) - 1))
    left = vectors.join(shape.drop("parts"), "cell").withColumn("block", task("blocks")).select("cell", "part", "block", "id", "v")
    right = pairs.join(shape, "cell").withColumn("block", F.pmod(F.xxhash64("query_id"), F.col("blocks")).cast("int")).withColumn("part", task("parts")).select("cell", "part", "block", "query_id", "q")
    key = ["cell", "part", "block"]

    def compare(some: pa.Table, asking: pa.Table) -> pa.Table:
        v, at = rows_of(some.column("v"), size)
        q, of = rows_of(asking.column("q"), size)
        ids, query_ids = (np.array(t.column(c).to_numpy())[i] for t, c, i in ((some, "id", at), (asking, "query_id", of)))
        best = []
        for i in range(0, len(q), 256):
            for s in q[i : i + 256] @ v.T:
                top = nearest(s, ids, most)
                best.append((s[top], ids[top]))
        if not best or not len(ids):
            return pa.table({"query_id": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "cosine_similarity": pa.array([], pa.float64())})
        return pa.Table.from_batches([_hits(query_ids, best)])

    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(compare, _HITS)
