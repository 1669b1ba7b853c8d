"""Operator 7: near-duplicate vectors by iterative quantisation and multi-index Hamming tables.

A rotation is learned that turns unit vectors into balanced binary codes with little loss: principal axes, then turns of a
random rotation towards the codes' own signs. Runs of the codes' bits are keys of as many tables; vectors that share a label
and a run meet in a cell and are candidates if few bits of their codes differ. Candidates are compared by cosine of the original
vectors, in double precision, so nothing below the threshold links.

Exact copies are folded to one row with a count first. A cell with more rows than `cell` is split into parts whose pairs are
dealt to tasks of their own. A pair counts in the first table where it meets, so links are counted once. A task returns a
row or two for each of its vectors: the number of links and a forest edge, never all pairs.

The rotation is fitted on at most `sample` vectors and `numbers` numbers, chosen by a hash of the id; every vector is indexed.
With 64 bits and 6 tables, vectors at the threshold of 0.98 differ in about 4 bits, and a pair is missed only if every run of
10 or 11 bits differs: one or two pairs of a hundred at the threshold itself, fewer above it. Candidates may differ in
`most_bits` bits, some ten standard deviations more than such pairs do.

Edge cases: vectors that are null, empty, zero, or hold null or non-finite numbers, and rows with a null label, link with
nothing and are their own component; vectors of different lengths never link; equal rows are copies of each other; an empty
table gives no rows; extra columns are left out of the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import checkpointed, emitted
from quern.llm.components import Forest, components
from quern.llm.tiles import deal, runs

THRESHOLD, SAMPLE, NUMBERS, ROUNDS = 0.98, 20_000, 4_000_000, 30
#: Bits of a code at most, tables, and bits that candidates may differ in.
BITS, TABLES, MOST_BITS = 64, 6, 24
#: The (first bit, number of bits) of each table's key.
KEYS = [(round(t * BITS / TABLES), round((t + 1) * BITS / TABLES) - round(t * BITS / TABLES)) for t in range(TABLES)]
CELL, TILE = 4096, 256


def usable(vector: Column) -> Column:
    """Whether every number is finite and one is not zero; false for null and empty vectors."""
    return F.coalesce((F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(vector, lambda x: x != 0), F.lit(False))


def unit(vectors: np.ndarray) -> np.ndarray:
    """The vectors at length one, in double precision; scaled first, so that squares neither vanish nor overflow."""
    v = vectors.astype(np.float64)
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def quantiser(vectors: np.ndarray, bits: int = BITS, rounds: int = ROUNDS, seed: int = 11) -> np.ndarray:
    """The matrix whose products' signs are the codes: principal axes turned by iterative quantisation."""
    x = unit(vectors)
    axes = np.linalg.eigh(x.T @ x)[1][:, ::-1][:, : min(bits, x.shape[1])]
    p = x @ axes
    turn = np.linalg.qr(np.random.default_rng(seed).normal(size=(axes.shape[1],) * 2))[0]
    for _ in range(rounds):
        u, _, v = np.linalg.svd(np.where(p @ turn >= 0, 1.0, -1.0).T @ p)
        turn = (u @ v).T
    return axes @ turn


def codes(units: np.ndarray, matrix: np.ndarray | None) -> np.ndarray:
    """64-bit codes; without a matrix for their length, the signs of the first numbers."""
    signs = (units @ matrix if matrix is not None else units[:, :BITS]) >= 0
    full = np.zeros((len(units), BITS), dtype=bool)
    full[:, : signs.shape[1]] = signs
    return np.packbits(full, axis=1, bitorder="little").view(np.uint64).ravel()


def fit(reps: DataFrame, vector: str = "vector", sample: int = SAMPLE, numbers: int = NUMBERS) -> dict[int, np.ndarray]:
    """The quantiser for the commonest length of vectors, from a bounded sample of those."""
    common = reps.groupBy(F.size(vector).alias("size")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "size").first()
    if common is None:
        return {}
    most = max(1, min(sample, numbers // common.size))
    chosen = reps.where(F.size(vector) == common.size).orderBy(F.xxhash64("rep"), "rep").limit(most).select(vector).toArrow().column(0).combine_chunks()
    return {common.size: quantiser(chosen.flatten().to_numpy(zero_copy_only=False).reshape(-1, common.size))}


def linked(ids: np.ndarray, counts: np.ndarray, code: np.ndarray, vectors: np.ndarray, own: np.ndarray, table: int, same_part: bool, threshold: float, most_bits: int) -> Iterator[tuple[int, int | None, int]]:
    """id, a linked id or null, links not counted elsewhere: forest edges and counts of one task's pairs."""
    n = len(ids)
    x = unit(vectors)
    found, forest = np.zeros(n, dtype=np.int64), Forest(n)
    edges: list[tuple[int, int]] = []
    for i in range(0, n, TILE):
        for j in range(i, n, TILE):
            a, b = slice(i, i + TILE), slice(j, j + TILE)
            differ = code[a, None] ^ code[None, b]
            near = np.bitwise_count(differ) <= most_bits
            if i == j:
                near = np.triu(near, 1)
            if not same_part:
                near &= own[a, None] != own[None, b]
            p, q = np.nonzero(near)
            if table and len(p):  # met in an earlier table: some run before this one agrees
                d = differ[p, q]
                new = np.ones(len(p), dtype=bool)
                for first, width in KEYS[:table]:
                    new &= (d >> np.uint64(first)) & np.uint64((1 << width) - 1) != 0
                p, q = p[new], q[new]
            if not len(p):
                continue
            cosine = (x[a] @ x[b].T)[p, q] if 8 * len(p) > near.size else np.einsum("ij,ij->i", x[a][p], x[b][q])
            hit = cosine >= threshold
            p, q = p[hit] + i, q[hit] + j
            np.add.at(found, p, counts[q])
            np.add.at(found, q, counts[p])
            edges += [(s, t) for s, t in zip(p.tolist(), q.tolist(), strict=True) if forest.join(s, t)]
    for p in np.flatnonzero(found).tolist():
        yield int(ids[p]), None, int(found[p])
    for s, t in edges:
        yield int(ids[s]), int(ids[t]), 0


def near_duplicates(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = THRESHOLD, sample: int = SAMPLE, most_bits: int = MOST_BITS, cell: int = CELL) -> DataFrame:
    """key, n_links, component_id, kept of every row."""
    given = rows.select(F.col(key).cast("long").alias("key"), F.col(vector).alias("vector"), F.col(label).alias("label"))
    given = given.withColumn("ok", usable(F.col("vector")) & F.col("label").isNotNull())
    good = given.where("ok")
    reps = checkpointed(good.groupBy("label", "vector").agg(F.min("key").alias("rep"), F.count("*").alias("copies")).withColumn("group", F.xxhash64("label", F.size("vector"))))
    models = rows.sparkSession.sparkContext.broadcast(fit(reps, sample=sample))  # one small matrix

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.diff(batch.column(3).offsets.to_numpy())
            whole = [np.asarray(v, dtype=np.float64) for v in batch.column(3).to_pylist()]
            code = np.zeros(batch.num_rows, dtype=np.uint64)
            for n in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == n)
                code[at] = codes(unit(np.array([whole[k] for k in at])), models.value.get(n))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(code.view(np.int64))], names=[*batch.schema.names, "code"])

    kind = dict(reps.dtypes)["vector"]
    coded_reps = reps.select("rep", "copies", "group", "vector").mapInArrow(coded, f"rep long, copies long, group long, vector {kind}, code long")
    # a code has as many bits as its vector has numbers, at most 64; tables without bits would hold everything in one cell
    spots = F.filter(F.array(*(F.struct(F.lit(t).alias("table"), F.shiftrightunsigned("code", first).bitwiseAND(F.lit((1 << width) - 1)).cast("int").alias("value"), F.lit(first).alias("first")) for t, (first, width) in enumerate(KEYS))), lambda s: s["first"] < F.size("vector"))
    placed = checkpointed(coded_reps).select("*", F.explode(spots).alias("spot")).select("rep", "copies", "group", "vector", "code", "spot.table", "spot.value")
    dealt = deal(placed, ["group", "table", "value"], F.col("rep"), cell)
    out = pa.schema([("node", pa.int64()), ("other", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[tuple]:
            for (_, table, _, low, high), part in runs(batches, ["group", "table", "value", "low", "high"]):
                if part.num_rows > 1:
                    v = part.column("vector").combine_chunks()
                    flat = v.flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
                    column = lambda c: part.column(c).to_numpy()  # noqa: B023, E731
                    yield from linked(column("rep"), column("copies"), column("code").view(np.uint64), flat, column("own"), table, low == high, threshold, most_bits)

        return emitted(found(), out)

    links = checkpointed(dealt.mapInArrow(run, "node long, other long, n long"))
    totals = links.groupBy("node").agg(F.sum("n").alias("n"))
    named = components(links.select(F.col("node").alias("a"), F.col("other").alias("b")))
    classes = reps.join(totals, reps["rep"] == totals["node"], "left").drop("node").join(named, reps["rep"] == named["node"], "left").select("label", "vector", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    members = good.select("key", "label", "vector").join(classes, ["label", "vector"]).select("key", "n_links", "component_id")
    alone = given.where("not ok").select("key", F.lit(0).cast("long").alias("n_links"), F.col("key").alias("component_id"))
    return members.unionByName(alone).select(F.col("key").alias(key), "n_links", "component_id", F.col("key").eqNullSafe(F.col("component_id")).alias("kept"))
