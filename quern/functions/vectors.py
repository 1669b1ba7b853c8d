"""Vector arithmetic on arrays: in the JVM, and of many pairs by block in numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.bind import bound
from quern.shipping import ensure
from quern.streaming.groups import shared

#: Vectors of either side that are compared at a time.
BLOCK = 1_000


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null where a vector is null or zero."""
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size > 0, dot(a, b) / size)


def normalised(a: Column) -> Column:
    """The vector at length one; null for null and zero vectors."""
    return bound(F.struct(a.alias("v"), F.sqrt(dot(a, a)).alias("size")), lambda b: F.when(b["size"] > 0, F.transform(b["v"], lambda x: x.cast("double") / b["size"])))


def hash_embedding(tokens: Column, size: int = 64, probes: int = 64) -> Column:
    """A deterministic vector of a list of tokens: each token's probes count at crc32 places; then at length one."""
    places = F.flatten(F.transform(F.coalesce(tokens, F.array().cast("array<string>")), lambda t: F.transform(F.sequence(F.lit(0), F.lit(probes - 1)), lambda i: F.crc32(F.concat(t, F.lit(":"), i.cast("string")).cast("binary")) % size)))
    counts = bound(places, lambda p: F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda d: F.size(F.filter(p, lambda x: x == d)).cast("double")))
    return bound(counts, normalised)


def cosines(left: DataFrame, right: DataFrame, by: str) -> DataFrame:
    """a, b, cosine of all pairs of left (a, x) and right (b, y) that share a value of `by`: as `cosine`, so null where a vector
    is null, zero, of another length, or holds a null.

    Each pair of blocks is one product of matrices; a value's rows are dealt to as many blocks as they fill.
    """
    shared(ensure(left.sparkSession))
    sides = left.where(F.col(by).isNotNull()), right.where(F.col(by).isNotNull())
    counted = [d.groupBy(by).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias(n)) for d, n in zip(sides, ("of_a", "of_b"), strict=True)]
    shape = counted[0].join(counted[1], by).checkpoint()  # a row a value
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    dealt = lambda k, n: F.pmod(F.xxhash64(k), F.col(n)).cast("int")
    x = sides[0].join(shape, by).withColumn("block_a", dealt("a", "of_a")).withColumn("block_b", every("of_b")).select(F.col(by).alias("by"), "block_a", "block_b", "a", "x")
    y = sides[1].join(shape, by).withColumn("block_b", dealt("b", "of_b")).withColumn("block_a", every("of_a")).select(F.col(by).alias("by"), "block_a", "block_b", "b", "y")
    key = ["by", "block_a", "block_b"]

    def unit(column: pa.ChunkedArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """Places and vectors at length one, by the vectors' length; those without a cosine are left out."""
        found: dict[int, list] = {}
        for i, v in enumerate(column.to_pylist()):
            if v and None not in v:
                found.setdefault(len(v), []).append((i, v))
        out = {}
        for n, rows in found.items():
            at, m = np.array([i for i, _ in rows]), np.array([v for _, v in rows], dtype=np.float64)
            with np.errstate(all="ignore"):
                size = np.sqrt((m * m).sum(axis=1))
                good = ~(size <= 0)
                out[n] = at[good], m[good] / size[good, None]
        return out

    def compare(ones: pa.Table, others: pa.Table) -> pa.Table:
        a, b = (np.array(t.column(c).to_pylist(), dtype=object) for t, c in ((ones, "a"), (others, "b")))
        cos, known = np.zeros((len(a), len(b))), np.zeros((len(a), len(b)), dtype=bool)
        theirs = unit(others.column("y"))
        for n, (i, m) in unit(ones.column("x")).items():
            if n in theirs:
                j, w = theirs[n]
                cos[np.ix_(i, j)], known[np.ix_(i, j)] = m @ w.T, True
        keys = pa.array(a, pa.int64()).take(pa.array(np.repeat(np.arange(len(a)), len(b)))), pa.array(b, pa.int64()).take(pa.array(np.tile(np.arange(len(b)), len(a))))
        return pa.table({"a": keys[0], "b": keys[1], "cosine": pa.array(cos.ravel(), pa.float64(), mask=~known.ravel())})

    return x.groupBy(*key).cogroup(y.groupBy(*key)).applyInArrow(compare, "a long, b long, cosine double")
