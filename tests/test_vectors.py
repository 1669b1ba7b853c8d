"""The vector leg and its index against plain sorting."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.operators import vector_index as v
from quern.plans import checks


def plain(chunks, queries, most, where=lambda i: True):
    found = {}
    unit = lambda x: None if x is None or len(x) != 8 or not np.linalg.norm(x) else np.array(x) / np.linalg.norm(x)
    rows = [(i, unit(x)) for i, x in chunks if where(i) and unit(x) is not None]
    for k, q in queries:
        if unit(q) is not None:
            found[k] = [i for _, i in sorted((-round(float(unit(q) @ x), 9), i) for i, x in rows)][:most]
    return found


def got(hits):
    out = {}
    for r in sorted(hits.collect(), key=lambda r: (r.query_id, r.vector_rank)):
        out.setdefault(r.query_id, []).append(r.id)
    return out


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 8)) + 1.5  # a common mean, and crowds
    rows = [(i, (centres[i % 40] + 0.3 * rng.normal(size=8)).tolist()) for i in range(3000)]
    rows += [(5000 + i, rows[7][1]) for i in range(1500)] + [(9000, None), (9001, [0.0] * 8), (9002, [1.0, 2.0]), (9003, [])]  # a third of all are copies
    queries = [(i, rows[i * 31][1]) for i in range(60)] + [(100, None), (101, [0.0] * 8), (102, [1.0])]
    table = spark.createDataFrame(rows, "id long, embedding array<double>").withColumn("topic", F.col("id") % 50)
    return rows, queries, table, spark.createDataFrame(queries, "query_id long, query_embedding array<double>")


def test_exact_leg(spark, data, monkeypatch):
    rows, queries, table, asked = data
    want = plain(rows, queries, 20)
    assert got(v.ranked_hits(v.exact_hits(asked, table, 20), 20)) == want
    monkeypatch.setattr(v, "QUERIES", 13)  # several blocks
    assert got(v.ranked_hits(v.exact_hits(asked, table.repartition(5), 20), 20)) == want
    assert v.exact_hits(asked.limit(0), table, 5).count() == 0 and v.exact_hits(asked, table.limit(0), 5).count() == 0


def test_index_finds_and_prunes(spark, data, tmp_path, monkeypatch):
    rows, queries, table, asked = data
    monkeypatch.setattr(v, "PART", 400)  # the copies' cell is in parts
    built = v.build(table, str(tmp_path / "index"), keep=("topic",))
    index = v.opened(spark, built.path)
    assert np.array_equal(index.centres, built.centres) and index.probes == built.probes < len(index.centres) / 2
    want, near = plain(rows, queries, 50), got(v.index_hits(asked, index, 50))
    assert near.keys() == want.keys() and all(len(x) == 50 for x in near.values())
    assert sum(len(set(near[k]) & set(want[k])) for k in want) >= 0.95 * 50 * len(want)
    assert all(near[k][0] == want[k][0] for k in want)
    every = got(v.index_hits(asked, index, 50, probes=len(index.centres)))
    assert every == want  # all cells: the exact leg, ties included
    monkeypatch.setattr(v, "PART", 20_000)
    plan = checks.physical(v._compared(index.vectors(spark).where(F.col("cell").isin(1, 2)), asked.select("query_id", F.col("query_embedding").alias("q"), (F.col("query_id") % 2 + 1).cast("int").alias("cell")), spark.read.parquet(f"{index.path}/parts"), 8, 5))
    assert "PartitionFilters: [cell" in plan.replace("isnotnull(cell#", "cell") and "CartesianProduct" not in plan and "NestedLoop" not in plan
    sizes = index.vectors(spark).groupBy("cell", "part").count().agg(F.max("count")).first()[0]
    assert sizes < 600


def test_pools_fill_past_filtered_rows(spark, data, tmp_path):
    """A filter that leaves 1 in 50 rows widens probes until pools are full, or nothing is left."""
    rows, queries, table, asked = data
    index = v.build(table, str(tmp_path / "index"), keep=("topic",))
    near = got(v.index_hits(asked, index, 30, "topic = 7"))
    want = plain(rows, queries, 30, lambda i: i % 50 == 7)
    assert all(len(near[k]) == 30 for k in want) and sum(len(set(near[k]) & set(want[k])) for k in want) >= 0.9 * 30 * len(want)
    assert got(v.index_hits(asked, index, 30, "topic = 99")) == {}
    few = got(v.index_hits(asked, index, 500, "topic = 7"))
    assert few == plain(rows, queries, 500, lambda i: i % 50 == 7)  # fewer than asked for: all cells were probed


def test_empty_index(spark, data, tmp_path):
    _, _, table, asked = data
    index = v.build(table.limit(0), str(tmp_path / "index"))
    assert v.index_hits(asked, index, 5).count() == 0
