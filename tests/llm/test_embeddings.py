"""Vector near-duplicates against all pairs, with recall measured on links, and edge cases."""

import numpy as np

from quern.llm import embeddings


def plain(rows, threshold=0.98):
    """n_links and component of each row, by every pair."""
    ok = [v is not None and lab is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v, lab in rows]
    n, links, up = len(rows), np.zeros(len(rows), int), list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    unit = [np.array(v, float) / np.linalg.norm(np.array(v, float)) if o else None for (_, v, _), o in zip(rows, ok, strict=True)]
    for i in range(n):
        for j in range(i):
            if ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= threshold:
                links[i] += 1
                links[j] += 1
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return links, [min(rows[j][0] for j in range(n) if root(j) == root(i)) for i in range(n)]


def check(spark, rows, exact=True, **options):
    got = {r.vec_id: r for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), **options).collect()}
    links, components = plain([(k, None if v is None else [None if x is None else np.float32(x) for x in v], lab) for k, v, lab in rows])
    assert len(got) == len(rows)
    if exact:
        for (k, _, _), n, c in zip(rows, links, components, strict=True):
            assert (got[k].n_links, got[k].component_id, got[k].kept) == (n, c, k == c)
    return got, links


def test_table_recall(spark):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()]
    got, links = check(spark, rows, exact=False)
    assert sum(r.n_links for r in got.values()) >= 0.97 * links.sum()
    assert all(got[k].n_links <= n for (k, _, _), n in zip(rows, links, strict=True))


def test_hot_groups_and_split_cells(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=16)
    rows = [(i, (base + rng.normal(size=16) * 0.02).tolist(), 1) for i in range(60)] + [(100 + i, base.tolist(), 1) for i in range(40)]
    rows += [(200 + i, rng.normal(size=16).tolist(), i % 3) for i in range(60)]
    check(spark, rows, cell=4096)
    check(spark, rows, cell=9)


def test_edge_cases(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(1, None, 1), (2, [], 1), (3, [0.0, 0.0, 0.0], 1), (4, [1.0, None, 2.0], 1), (5, [1.0, float("nan"), 2.0], 1), (6, [float("inf"), 1.0, 1.0], 1), (7, v, None), (8, v, 1), (9, v, 1), (10, v, 2), (11, [2.0, 4.0, 6.0], 1), (12, [1.0, 2.0], 1), (13, [1e-30, 2e-30, 3e-30], 1), (14, [1e30, 2e30, 3e30], 1)]
    check(spark, rows)
    assert embeddings.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0
