"""Row numbers within groups of any size, without a window over a group."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.common import checkpointed


def numbered(rows: DataFrame, group: str, order: list[str], name: str = "position") -> DataFrame:
    """The rows with their place in their group, from 0, by `order` (ascending, nulls first).

    Rows are dealt by ranges of group and order together, so that a large group lies in many partitions; each partition
    numbers its part of a group, and parts are moved up by the sizes of the parts before. Order columns should tell rows
    apart; a group's parts are as many as the partitions at most, and only they meet in a window.
    """
    keys = [F.col(group).asc_nulls_first(), *(F.col(c).asc_nulls_first() for c in order)]
    dealt = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    at = dealt.columns.index(group)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, n = TaskContext.get().partitionId(), object(), 0
        for batch in batches:
            places = []
            for g in batch.column(at).to_pylist():
                n = n + 1 if g == last else 0
                last = g
                places.append(n)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * len(places), pa.int32()), pa.array(places, pa.int64())], names=[*batch.schema.names, "_part", "_place"])

    schema = T.StructType([*dealt.schema.fields, T.StructField("_part", T.IntegerType()), T.StructField("_place", T.LongType())])
    placed = checkpointed(dealt.mapInArrow(run, schema))
    parts = placed.groupBy(F.col(group).alias("_group"), F.col("_part").alias("_of")).agg(F.count("*").alias("_n"))
    before = Window.partitionBy("_group").orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)
    moved = parts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).where("_before > 0").drop("_n")
    joined = placed.join(moved, F.col("_group").eqNullSafe(F.col(group)) & (F.col("_of") == F.col("_part")), "left")
    return joined.withColumn(name, F.col("_place") + F.coalesce("_before", F.lit(0))).drop("_group", "_of", "_before", "_part", "_place")
