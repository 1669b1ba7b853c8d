"""SimHash against a brute-force version: fingerprints bit by bit, links over all pairs."""

import random
import re

import numpy as np
import pytest
import xxhash

from quern.llm import simhash
from quern.llm.components import components


def plain_fingerprint(text):
    ws = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not ws:
        return 0
    shingles = [" ".join(ws[i : i + 4]) for i in range(len(ws) - 3)] or [" ".join(ws)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def plain_components(fps, radius=4):
    up = list(range(len(fps)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(fps))]


def test_whole_table_against_all_pairs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())
    fps = [plain_fingerprint(t) for _, t in rows]
    want = plain_components(fps)
    got = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    assert len(got) == len(rows)
    for (doc, _), fp, c in zip(rows, fps, want, strict=True):
        assert got[doc].fp % (1 << 64) == fp
        assert got[doc].component_id == rows[c][0]


def test_edge_cases(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, " \t\n", "x"), (4, "One TWO three", "x"), (5, "one two three", "x"), (6, "é ß", "x"), (7, "w " * 50_000, "x"), (8, None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component string")
    got = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    assert [got[i].component_id for i in (1, 2, 3, 8)] == [1, 1, 1, 1]
    assert got[4].component_id == got[5].component_id == 4
    assert got[7].fp % (1 << 64) == xxhash.xxh64_intdigest("w w w w", 42)
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


@pytest.mark.parametrize("cell", [4096, 7])
def test_hot_cells_are_split_without_losing_links(spark, cell):
    rng = random.Random(5)
    base = rng.getrandbits(64)
    fps = {base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 6))) for _ in range(120)} | {rng.getrandbits(64) for _ in range(200)}
    fps = sorted(fps)
    want = plain_components(fps)
    links = simhash.links(spark.createDataFrame([(simhash._signed(x),) for x in fps], "fp long"), cell=cell)
    found = {r.node % (1 << 64): r.component for r in components(links).collect()}
    groups = {}
    for x, c in zip(fps, want, strict=True):
        groups.setdefault(c, []).append(x)
    for members in groups.values():
        assert len({found.get(x, simhash._signed(x)) for x in members}) == 1
    assert len({found.get(x, simhash._signed(x)) for x in fps}) == len(groups)


def test_tiles_skip_nothing_near():
    rng = np.random.default_rng(1)
    words = np.unique(rng.integers(0, 1 << 63, 50, dtype=np.uint64)[rng.integers(0, 50, 600)] ^ (np.uint64(1) << rng.integers(0, 64, 600, dtype=np.uint64)))
    seen = simhash.tile_links(words, 4, tile=16)
    groups = plain_components([int(w) for w in words])
    joined = set(seen)
    assert all(groups[a] == groups[b] for a, b in joined)
    assert len(joined) == len(words) - len(set(groups))
