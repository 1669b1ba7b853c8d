"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import uuid
from collections.abc import Hashable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.shipping import ensure

#: What counts as white space between words: blank and \t \n \v \f \r, nothing else.
WORD = "[^\\x20\\x09-\\x0D]+"


def words(text: str) -> list[str]:
    """The words `[^\\x20\\x09-\\x0D]+` of a text, in order."""
    return [w.decode("utf-8", "surrogatepass") for w in byte_words(text)]


def byte_words(text: str) -> list[bytes]:
    """The same words, as UTF-8: bytes.split() knows just these six characters, and none of them is part of another."""
    return text.encode("utf-8", "surrogatepass").split()


class Recent:
    """Values of the keys that were used last, such as words: `most` or some more at hand, and as many from before those.

    So a table stays bounded without losing what is common. No value is None.
    """

    def __init__(self, most: int = 150_000):
        self.most = most
        self.hand: dict = {}
        self.before: dict = {}

    def unknown(self, keys: set[Hashable]) -> list:
        """The keys without a value; those with one are at hand afterwards."""
        if len(self.hand) > self.most:
            self.before, self.hand = self.hand, {}
        missing = keys.difference(self.hand)
        if not self.before:
            return list(missing)
        new, get, hand = [], self.before.get, self.hand
        for k in missing:
            if (value := get(k)) is None:
                new.append(k)
            else:
                hand[k] = value
        return new

    def clear(self) -> None:
        self.hand, self.before = {}, {}


def trimmed() -> None:
    """Gives back to the system what a finished task has freed, as Python workers live on."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # only where the C library can
        ctypes.CDLL(None).malloc_trim(0)


def rows(batches: Iterable[pa.RecordBatch], *columns: str) -> Iterator[tuple]:
    """The rows of Arrow batches, as tuples of Python values, a few hundred at a time."""
    for batch in batches:
        at = [batch.schema.get_field_index(c) for c in columns]
        for start in range(0, batch.num_rows, 256):
            part = batch.slice(start, 256)
            yield from zip(*(part.column(i).to_pylist() for i in at), strict=True)


def emitted(found: Iterable[tuple], schema: pa.Schema, weight=None, limit: int = 4 << 20, most: int = 5000) -> Iterator[pa.RecordBatch]:
    """Tuples as Arrow batches of at most `most` rows and about `limit` bytes, as `weight` of a row tells."""
    held: list[tuple] = []
    size = 0
    for row in found:
        held.append(row)
        size += weight(row) if weight else 0
        if len(held) >= most or size >= limit:
            yield _batch(held, schema)
            held, size = [], 0
    if held:
        yield _batch(held, schema)
    trimmed()


def _batch(held: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def checkpointed(df: DataFrame, rows: int | None = None, each: int = 20_000) -> DataFrame:
    """The rows, written to the folder that the executors share; the plan before it is forgotten.

    The folder is the cluster's spark.checkpoint.dir. Only where that is unset, as in tests, one in the warehouse is used.
    Where it is known that there are at most so many rows, they go to as many files as `each` rows a file take: a shuffle has
    partitions for the largest tables, and a small one in as many files costs more for files than for rows.
    """
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // each)))
    spark = df.sparkSession
    if not shared_dir(spark):
        spark.sparkContext.setCheckpointDir(f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_checkpoints")
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> tuple[DataFrame, str]:
    """The rows as a Parquet table in the folder that the executors share, and its path; `dropped` removes it."""
    spark = df.sparkSession
    if not shared_dir(spark):
        spark.sparkContext.setCheckpointDir(f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_checkpoints")
    path = f"{shared_dir(spark).rstrip('/')}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def dropped(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextlib.contextmanager
def stored(df: DataFrame) -> Iterator[DataFrame]:
    """The rows as such a table for as long as the block runs."""
    table, path = written(df)
    try:
        yield table
    finally:
        dropped(df.sparkSession, path)


def unused(columns: Iterable[str], name: str) -> str:
    """The name, or with underscores that none of the columns has."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


#: Rows of a table that may be broadcast, after a count.
SMALL = 100_000


#: Plans over rows that come back alike, and at the same places, however often and with whichever columns they are read.
_SETTLED = ("LogicalRelation", "LocalRelation", "LogicalRDD", "Project", "Filter", "SubqueryAlias", "Union")


def settled(df: DataFrame) -> DataFrame:
    """The rows, such that each reading finds the same ones at the same places; what isn't so by its plan is written first.

    Rows that come out of a shuffle, a join, a sample or a function may come in another order, or be others, the next time.
    """
    plan, steps = df._jdf.queryExecution().analyzed(), []
    nodes = [plan] if plan.deterministic() else []
    while nodes:
        node = nodes.pop()
        steps.append(node.getClass().getSimpleName())
        nodes += [node.children().apply(i) for i in range(node.children().size())]
    return df if steps and set(steps) <= set(_SETTLED) else kept(df)


def kept(df: DataFrame) -> DataFrame:
    """The rows as a table in the shared folder, which goes when the driver ends."""
    table, path = written(df)
    atexit.register(gone, df.sparkSession, path)
    return table


def gone(spark: SparkSession, path: str) -> None:
    """Drops a folder when the driver ends."""
    with contextlib.suppress(Exception):  # the session may have ended before
        dropped(spark, path)


def keyed(docs: DataFrame, key: str = "doc_id") -> tuple[DataFrame, str]:
    """The rows with a number of their own in a new column, and its name: the id, where no other row has it.

    Rows that share an id, and those without one, get numbers beyond all ids by their place in the table; so what is found
    for a number holds for one row. Rows are numbered once: where places tell, the numbers are written with the rows, and so
    are rows of any plan that may give others when it is read again (`settled`).
    """
    docs = settled(docs)
    name, id_, odd_, row = (unused(docs.columns, c) for c in ("_own", "_id", "_odd", "_row"))
    ids = docs.select(F.col(key).cast("long").alias("id"))
    odd = ids.groupBy("id").agg(F.count("*").alias("n")).where("n > 1 or id is null").select(F.col("id").alias(id_), F.lit(True).alias(odd_))
    few = odd.limit(SMALL + 1).count()
    if not few:
        return docs.withColumn(name, F.col(key).cast("long")), name
    low, high = ids.agg(F.min("id"), F.max("id")).first()
    if high is None or high < 1 << 62:
        beyond = F.lit((high or 0) + 1) + F.col(row)
    elif low > -(1 << 62):
        beyond = F.lit(low - 1) - F.col(row)
    else:  # no numbers are free on either side: all rows go by their place
        return kept(docs.withColumn(name, F.monotonically_increasing_id())), name
    placed = docs.withColumn(row, F.monotonically_increasing_id())
    told = placed.join(F.broadcast(odd) if few <= SMALL else odd, F.col(key).cast("long").eqNullSafe(F.col(id_)), "left")
    return kept(told.withColumn(name, F.when(F.col(odd_), beyond).otherwise(F.col(key).cast("long"))).drop(row, id_, odd_)), name


def shared_dir(spark: SparkSession) -> str | None:
    return spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)


def dealt(df: DataFrame) -> DataFrame:
    """The rows, dealt out to all cores where they have fewer parts.

    Files of a single row group can't be read in parts, and the passes over texts cost far more than dealing a small table.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def read(spark: SparkSession, sf_dir: str, table: str, deal: bool = True) -> DataFrame:
    """A table of the folder, dealt out to all cores if it has fewer parts.

    Where rows are to be numbered (`keyed`), a dealt table would be written first; such a table is dealt afterwards.
    """
    df = ensure(spark).read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")
    return dealt(df) if deal else df
