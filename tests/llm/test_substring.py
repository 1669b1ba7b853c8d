"""Repeated passages against brute force on small corpora with planted exact and edited copies."""

import random

import numpy as np

from quern.llm import substring


def corpus(seed=1):
    """Documents of invented words, with the passages planted in them: (doc, source, start, words)."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randint(2, 7)))
    docs = {i: [word() for _ in range(rng.randint(60, 400))] for i in range(40)}
    planted = []
    for n, size in enumerate((51, 60, 80, 120, 200, 55, 70)):
        passage = [word() for _ in range(size)]
        holders = sorted(rng.sample(sorted(docs), 3 + n))
        for d in holders:
            own = list(passage)
            if n >= 4 and d != holders[0]:  # edits: a word changed, dropped or added, far apart
                for at in range(15, size, 25):
                    how = rng.randrange(3)
                    own[at : at + 1] = [[word()], [], [own[at], word()]][how]
            at = rng.randint(0, len(docs[d]))
            docs[d][at:at] = own
            planted.append((n, d, holders[0], len(own)))
    return docs, planted


def repeated_places(docs, least):
    """Words of each document that lie in a run of at least so many words that an earlier document holds, by brute force."""
    first, marked = {}, {}
    for d in sorted(docs):
        for i in range(len(docs[d]) - least + 1):
            gram = tuple(docs[d][i : i + least])
            if first.setdefault(gram, d) < d:
                marked.setdefault(d, set()).update(range(i, i + least))
    return marked


def test_planted_passages(spark):
    docs, planted = corpus()
    table = spark.createDataFrame([(d, " \n".join(ws), 1) for d, ws in docs.items()], "doc_id long, text string, source int")
    got = substring.passages(table).collect()
    found = {(r.doc_id, r.source) for r in got}
    for d, places in repeated_places(docs, 50).items():
        covered = {i for r in got if r.doc_id == d for i in range(r.start, r.end)}
        assert len(places - covered) <= 0.02 * len(places), d
    holders = {d for _, d, _, _ in planted}
    assert {d for p in found for d in p} <= holders
    for n, d, first, size in planted:
        if d != first:
            assert max(r.end - r.start for r in got if r.doc_id == d) >= 0.9 * min(size, 50), (n, d)
    for r in got:
        a, b = docs[r.doc_id][r.start : r.end], docs[r.source][r.source_start : r.source_end]
        assert len(a) >= 50 and r.similarity >= 0.8
        assert len(set(a) & set(b)) >= 0.75 * len(set(a))


def test_edge_cases(spark):
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [(1, None), (2, ""), (3, "a b"), (4, long), (5, long.upper()), (6, "same " * 400), (7, "same " * 400), (None, long), (8, "x " * 10 + " ".join(f"w{i}" for i in range(100, 151)))]
    table = spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, source string")
    got = {r.doc_id: r for r in substring.passages(table).collect()}
    assert set(got) >= {5, 8} and not set(got) & {1, 2, 3, 4, None}
    assert (got[5].source, got[5].start, got[5].end) == (4, 0, 30_000)
    assert (got[8].start, got[8].end, got[8].source_start, got[8].source_end) == (10, 61, 100, 151)
    left = {r.doc_id: r for r in substring.remove(table, substring.passages(table)).collect()}
    assert 5 not in left and left[8].text == "x " * 10 and left[4].text == long and left[1].text is None and left[8].source == "s"
    assert substring.passages(table.limit(0)).count() == 0


def test_chains_are_the_best_by_plain_search():
    """The Fenwick tree's first chain against the quadratic recurrence."""
    rng = np.random.default_rng(4)
    for _ in range(60):
        n = int(rng.integers(1, 25))
        a = np.stack([np.sort(rng.choice(400, n, replace=False)), rng.integers(0, 400, n), rng.integers(5, 12, n)], axis=1)
        best = [0.0] * n
        for i in range(n):
            gains = [best[j] - substring.GAP * (a[i, 0] - a[j, 0] - a[j, 2] + a[i, 1] - a[j, 1] - a[j, 2]) for j in range(n) if a[j, 0] + a[j, 2] <= a[i, 0] and a[j, 1] + a[j, 2] <= a[i, 1]]
            best[i] = a[i, 2] + max([0.0, *gains])
        first = substring.chains(a)[0]
        score = float(first[0, 2])
        for p, q in zip(first, first[1:], strict=False):
            score += q[2] - substring.GAP * (q[0] - p[0] - p[2] + q[1] - p[1] - p[2])
        assert abs(score - max(best)) < 1e-9


def test_stretches_with_edits_near_the_ends_and_dense_edits():
    """The gain of the first stretch against all stretches, and passages a little over 50 words."""
    place = np.arange(51)
    for at in (1, 2, 48, 49):
        edited = place.copy()
        edited[at] = -1
        assert [r[:2] for r in substring.stretches(edited)] == [(0, 51)]
    dense = np.arange(60)
    dense[5::6] = -1
    (one,) = substring.stretches(dense)
    assert one[1] - one[0] >= 50 and one[4] >= 0.8
    assert not substring.stretches(np.where(np.arange(80) < 49, np.arange(80), -1))
    rng = np.random.default_rng(7)
    for _ in range(200):
        place = np.where(rng.random(70) < rng.choice([0.75, 0.8, 0.85, 0.95]), np.arange(70), -1)
        sums = np.concatenate([[0], np.cumsum(np.where(place >= 0, 1, -4))])
        gains = [sums[j] - sums[i] for i in range(70) for j in range(i + 50, 71) if place[i] >= 0 and place[j - 1] >= 0]
        got = substring.stretches(place)
        assert bool(got) == (max(gains, default=-1) >= 0)
        if got:
            assert max(gains) in [sums[r[1]] - sums[r[0]] for r in got] and all(r[4] >= 0.8 and r[1] - r[0] >= 50 for r in got)


def test_passage_whose_parts_were_seen_first_elsewhere(spark):
    """Documents 1 and 2, and 7 and 8 between the full holders, hold parts that are too short alone."""
    own = lambda d, n: [f"own{d}x{i}" for i in range(n)]
    p = [f"p{i}" for i in range(80)]
    parts = {1: p[:48], 2: p[32:], 5: p, 7: p[:48], 8: p[32:], 9: p}
    rows = [(d, " ".join(own(d, 70) + ws + own(d + 100, 70))) for d, ws in parts.items()]
    got = substring.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.source) for r in got} == {(9, 5)}
    assert {(r.start, r.end, r.source_start, r.source_end) for r in got} == {(70, 150, 70, 150)}
