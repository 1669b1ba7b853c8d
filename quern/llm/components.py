"""Connected components of a table of links, by label propagation with pointer jumping.

Each round takes, for every node, the least label among its neighbours (joined by node, reduced by minimum before the
shuffle) and then follows labels to their labels. The number of rounds grows with the logarithm of a component's width. The
state is a table in the folder that executors share; nothing but a count of changed rows comes to the driver. In both joins
one side holds each key once, so that a node with a third of all links is split by adaptive skew joins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import checkpointed

MOST_ROUNDS = 200


def components(links: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """node, component (the least node reachable) of every node that a link names; links with nulls or of a node to itself link nothing."""
    pairs = links.select(F.col(left).alias("a"), F.col(right).alias("b")).where("a is not null and b is not null and a <> b")
    both = checkpointed(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).select(F.col("a").alias("node"), F.col("b").alias("other")))
    n = both.count()  # nodes are fewer
    # the first round needs no join: a node's label is the least of itself and its neighbours
    labels = checkpointed(both.groupBy("node").agg(F.min("other").alias("o")).select("node", F.least("node", "o").alias("label")), n)
    for _ in range(MOST_ROUNDS):
        near = both.join(labels.select(F.col("node").alias("other"), "label"), "other").groupBy("node").agg(F.min("label").alias("near"))
        lower = labels.join(near, "node").select("node", F.col("label").alias("before"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("next"))
        after = checkpointed(lower.join(jump, "label").select("node", "before", F.least("label", "next").alias("label")), n)
        changed = not after.where("before <> label").isEmpty()
        labels = after.select("node", "label")
        if not changed:
            return labels.select("node", F.col("label").alias("component"))
    raise RuntimeError(f"components did not settle in {MOST_ROUNDS} rounds")


class Forest:
    """Union-find over small numbers, for links found within one tile."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        """Whether the link joins two trees; the smaller root stays."""
        x, y = self.root(x), self.root(y)
        if x == y:
            return False
        self.up[max(x, y)] = min(x, y)
        return True
