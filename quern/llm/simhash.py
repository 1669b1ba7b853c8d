"""Operator 3: near-duplicates by SimHash, compared exactly in tiles.

A text's fingerprint is the majority, bit by bit, of the XXH64 hashes of its shingles. Equal fingerprints are folded to one
row first, so that copies never meet each other. Different ones are compared in tiles: a numpy exclusive-or and a bit count
of one tile against another, skipped where the tiles' population counts differ by more than the radius, since two words can't
differ in fewer bits than their counts do.

Which tiles meet: of r + 2 bands of bits, fingerprints within a radius r agree on two, so each goes to a cell for the values of
each two bands, and only cells are compared within: other pairs are beyond the radius. With radius 4 a cell's values have
some 21 bits, so that even a billion fingerprints make cells of hundreds. A cell with more rows than
`cell` is split by a hash into parts, and each pair of parts is a task of its own, so a hot cell is shared out. Within a
task rows are sorted by population count into tiles. A task emits the forest of its links, at most a row for each of its
fingerprints, never all pairs; components come from a distributed label propagation.

Edge cases: a text without words (null and empty ones too) has fingerprint zero and is linked like any other; fewer words
than a shingle make one shingle; equal rows and equal ids each keep their row; an empty table gives no rows; other columns
of the input are left out of the result.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import byte_words, checkpointed, emitted, rows
from quern.llm.components import Forest, components
from quern.llm.tiles import deal

WORDS, SEED, RADIUS, BITS = 4, 42, 4, 64
#: Rows of a cell that one task compares, and of a tile within it.
CELL, TILE = 4096, 512
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_MASK = (1 << 63) - 1


def fingerprint(text: str | None, width: int = WORDS, seed: int = SEED) -> int:
    """The 64-bit fingerprint: bits set in over half of the shingles' hashes; zero without words."""
    ws = [w.translate(_LOWER) for w in byte_words(text or "")]
    if not ws:
        return 0
    digest, join = xxhash.xxh64_intdigest, b" ".join
    hashes = np.fromiter((digest(join(ws[i : i + width]), seed) for i in range(max(1, len(ws) - width + 1))), dtype=np.uint64, count=max(1, len(ws) - width + 1))
    set_bits = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), 8192):  # bounded memory for very long texts
        set_bits += np.unpackbits(hashes[at : at + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * set_bits > len(hashes), bitorder="little").tobytes(), "little")


def _signed(x: int) -> int:
    return x - (1 << 64) if x > _MASK else x


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WORDS, seed: int = SEED) -> DataFrame:
    """key, fp (the fingerprint's bits as a signed long). One narrow pass."""
    out = pa.schema([("key", pa.int64()), ("fp", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return emitted(((k, _signed(fingerprint(t, width, seed))) for k, t in rows(batches, "key", "text")), out)

    chosen = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    return chosen.mapInArrow(run, "key long, fp long").withColumnRenamed("key", key)


def tile_links(words: np.ndarray, radius: int, tile: int = TILE) -> Iterator[tuple[int, int]]:
    """A forest over the positions of `words` (unsigned 64-bit, all different) that links all within the radius."""
    counts = np.bitwise_count(words)
    order = np.argsort(counts, kind="stable")
    words, counts = words[order], counts[order].astype(np.int64)
    forest, root = Forest(len(words)), np.arange(len(words))
    for i in range(0, len(words), tile):
        a = words[i : i + tile]
        for j in range(i, len(words), tile):
            if counts[j] - counts[min(i + tile, len(words)) - 1] > radius:
                break  # sorted: no later tile is nearer
            near = np.bitwise_count(a[:, None] ^ words[None, j : j + tile]) <= radius
            x, y = np.nonzero(near & (root[i : i + tile, None] != root[None, j : j + tile]))
            if not len(x):
                continue  # a dense group is linked once, and its other hits are passed over here
            x, y = x + i, y + j
            trees = np.sort(np.stack([root[x], root[y]]), axis=0)
            for k in np.unique(trees[0] * len(words) + trees[1], return_index=True)[1].tolist():
                p, q = int(x[k]), int(y[k])
                if forest.join(p, q):
                    yield int(order[p]), int(order[q])
            root = np.fromiter(map(forest.root, range(len(words))), dtype=np.int64, count=len(words))


def cells(radius: int) -> list[list[tuple[int, int]]]:
    """For each two of radius + 2 runs of bits that cover the word their (start, width)."""
    edges = [round(i * BITS / (radius + 2)) for i in range(radius + 3)]
    bands = [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]
    return [list(two) for two in itertools.combinations(bands, 2)]


def links(distinct: DataFrame, radius: int = RADIUS, cell: int = CELL) -> DataFrame:
    """a, b: a forest of the links between different fingerprints. distinct: column fp, each value once."""
    bits = lambda a, w: F.shiftrightunsigned(F.col("fp"), a).bitwiseAND(F.lit((1 << w) - 1))
    value = [F.struct(F.lit(n).alias("band"), F.shiftleft(bits(a, w), v).bitwiseOR(bits(b, v)).alias("value")) for n, ((a, w), (b, v)) in enumerate(cells(radius))]
    placed = distinct.select("fp", F.explode(F.array(*value)).alias("c")).select("fp", "c.*")
    dealt = deal(placed, ["band", "value"], F.col("fp"), cell)
    out = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def linked(fps: np.ndarray) -> Iterator[tuple[int, int]]:
        if len(fps) == 2:
            a, b = fps.tolist()
            if ((a ^ b) & (1 << BITS) - 1).bit_count() <= radius:
                yield a, b
        elif len(fps) > 2:
            for p, q in tile_links(fps.view(np.uint64), radius):
                yield int(fps[p]), int(fps[q])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[tuple[int, int]]:
            key, held = None, np.zeros(0, np.int64)  # of the cell in which the last batch ended
            for batch in batches:
                if not batch.num_rows:
                    continue
                columns = [batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("band", "value", "low", "high")]
                fps = batch.column(batch.schema.get_field_index("fp")).to_numpy()
                ends = np.append(np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1, len(fps))
                begins = np.append(0, ends[:-1])
                if tuple(c[0] for c in columns) == key:
                    held = np.concatenate([held, fps[: ends[0]]])
                    begins, ends = begins[1:], ends[1:]
                if not len(begins):
                    continue
                yield from linked(held)
                for k in np.flatnonzero(ends[:-1] - begins[:-1] > 1).tolist():  # most cells hold a single fingerprint
                    yield from linked(fps[begins[k] : ends[k]])
                key, held = tuple(c[-1] for c in columns), fps[begins[-1] :]
            yield from linked(held)

        return emitted(found(), out)

    return dealt.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS, width: int = WORDS, seed: int = SEED) -> DataFrame:
    """key, fp, component (the least key reachable by links) of every row."""
    marked = checkpointed(fingerprints(docs, key, text, width, seed))
    n = marked.count()
    distinct = marked.groupBy("fp").agg(F.min(key).alias("least"))
    linked = components(links(distinct.select("fp"), radius))
    # only fingerprints with links need their component's least key; tables are kept apart before they are joined, so that
    # a join shuffles both of its sides itself and can split a component, or a fingerprint, that many rows share
    members = checkpointed(distinct.join(linked.withColumnRenamed("node", "fp"), "fp"), n)
    least = checkpointed(members.groupBy("component").agg(F.min("least").alias("component_id")), n)
    found = members.join(least, "component").select("fp", "component_id")
    named = checkpointed(distinct.join(found, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id")), n)
    return marked.join(named, "fp").select(key, "fp", "component_id")
