"""Dealing rows of cells out to tasks in which every pair of a cell's rows meets once, hot cells in parts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import SMALL

def deal(placed: DataFrame, cell: list[str], spread: Column, size: int) -> DataFrame:
    """The rows with `own` (a part of their cell), `low` and `high`, brought together by cell, low and high.

    A cell of n rows has ceil(n / size) parts by a hash of `spread`. The task (low, high) holds the parts low and high; a
    row goes to one task for each part of its cell, so that every pair of parts meets in one task. Cells of one row go.
    """
    counts = placed.groupBy(*cell).agg(F.count("*").alias("n")).where("n > 1").select(*cell, F.ceil(F.col("n") / size).cast("int").alias("parts"))
    hot = counts.where("parts > 1")
    # one hot cell for every `size` rows at most; whether that is few is counted, and if not the join shuffles
    hot = F.broadcast(hot) if hot.limit(SMALL + 1).count() <= SMALL else hot
    own = F.pmod(F.xxhash64(spread, F.lit("part")), F.coalesce("parts", F.lit(1))).cast("int")
    tasks = F.transform(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1), lambda t: F.struct(F.least(t, F.col("own")).alias("low"), F.greatest(t, F.col("own")).alias("high")))
    dealt = placed.join(hot, cell, "left").withColumn("own", own).withColumn("task", F.explode(tasks)).select(*placed.columns, "own", "task.*")
    return dealt.repartition(*cell, "low", "high").sortWithinPartitions(*cell, "low", "high")


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """The rows of each run of equal keys (numbers without nulls), as one table, in arriving order."""
    held_key, held = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys]
        cuts = (np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1).tolist()
        for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
            key = tuple(c[a].item() for c in columns)
            if key != held_key and held:
                yield held_key, pa.Table.from_batches(held)
                held = []
            held_key = key
            held.append(batch.slice(a, b - a))
    if held:
        yield held_key, pa.Table.from_batches(held)
