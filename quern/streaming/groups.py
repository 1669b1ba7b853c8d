"""Groups of names that links connect."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_ROUNDS = 200


def shared(spark: SparkSession) -> None:
    """Sees to a checkpoint folder: the cluster's spark.checkpoint.dir; where it is unset, as in tests, one in the warehouse."""
    if not (spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)):
        spark.sparkContext.setCheckpointDir(f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_checkpoints")


def connected(links: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """node, group (the least name that links reach) of every name in a link.

    Each round a name takes the least label around it and then that label's own label, so rounds grow with the logarithm of a
    group's width. Labels are written after each round, where spark.checkpoint.dir says.
    """
    shared(links.sparkSession)
    pairs = links.select(F.col(left).alias("a"), F.col(right).alias("b")).distinct()
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).checkpoint()
    labels = both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("group")).checkpoint()
    for _ in range(MOST_ROUNDS):
        around = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("group").alias("near"))
        lower = labels.join(around.withColumnRenamed("a", "node"), "node").select("node", F.col("group").alias("before"), F.least("group", "near").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("group").alias("next"))
        after = lower.join(jump, "label").select("node", "before", F.least("label", "next").alias("group")).checkpoint()
        labels = after.select("node", "group")
        if after.where("before <> group").isEmpty():
            return labels
    raise RuntimeError(f"groups did not settle in {MOST_ROUNDS} rounds")
