"""Pseudo-likelihood: scores against a plain per-word version, exact counts, trained order, words that occur twice."""

import math
import random
from collections import Counter

import numpy as np
import xxhash

from quern.llm import masked_lm as lm


def hashed(word):
    return xxhash.xxh64_intdigest(word.lower() if isinstance(word, bytes) else word.encode().lower())


def plain_log_prob(m, words, counts, total):
    """One word at a time, in plain loops."""
    own = [1 + hashed(w) % (lm.BUCKETS - 1) for w in words]
    found = 0.0
    for i, w in enumerate(words):
        s = [float(x) for x in m.hidden]
        for p, d in enumerate(lm.PLACES):
            near = own[i + d] if 0 <= i + d < len(own) else 0
            s = [a + float(m.place[p, k]) * float(m.embed[near, k]) for k, a in enumerate(s)]
        h = [math.tanh(a) for a in s]
        dot = lambda b: sum(x * float(y) for x, y in zip(h, m.out[b], strict=True))  # noqa: B023, E731
        z = sum(math.exp(dot(b)) for b in m.noise) / len(m.noise)
        found += math.log(counts[w.lower()] / total) + dot(own[i]) - math.log(z)
    return found


def test_table_against_a_plain_version(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: (r.text or "").encode().split() for r in docs.collect()}
    counts = Counter(w.lower() for ws in texts.values() for w in ws)
    total = sum(counts.values())
    held = lm.blocks(docs, size=5000).cache()
    model = lm.train(held)
    got = {r.doc_id: r for r in lm.score(docs, block=5000).collect()}
    assert got.keys() == texts.keys() and all(got[k].n_words == len(ws) for k, ws in texts.items())
    for k, ws in sorted(texts.items(), key=lambda x: len(x[1]))[:12]:
        assert abs(got[k].log_prob - plain_log_prob(model, ws, counts, total)) < 2e-3 * max(1, len(ws))
    first = held.first()
    parts = lm.counted(held).where(f"block = {first.block}").collect()
    totals = {a: t for r in parts for a, t in zip(np.frombuffer(r.at, "<u4").tolist(), np.frombuffer(r.total, "<i8").tolist(), strict=True)}
    words = np.frombuffer(first.packed.words, "<u8").tolist()
    known = {hashed(w): n for w, n in counts.items()}
    assert totals == {i: known[w] for i, w in enumerate(words)}


def test_conditionals_sum_to_about_one():
    rng = np.random.default_rng(0)
    m = lm.Model()
    m.out[:] = rng.normal(0, 0.7, m.out.shape)
    share = rng.dirichlet(np.full(300, 0.3))
    order = np.argsort(-share)
    m.noise = 1 + order[np.searchsorted(np.cumsum(share[order]), (np.arange(4000) + 0.5) / 4000)]
    sums = [sum(share[w] * math.exp(m.ratios(np.array([5, 9, 1 + w, 7, 3]))[0]) for w in range(300))]
    assert abs(sums[0] - 1) < 0.05


def test_word_order_counts(spark):
    sentence = "the cat sat on the mat and the dog lay by the door while rain fell on the roof of our house"
    rows = [(i, sentence) for i in range(4000)]
    shuffled = " ".join(sorted(sentence.split(), key=lambda w: w[::-1]))
    got = {r.doc_id: r for r in lm.score(spark.createDataFrame([*rows, (9000, shuffled)], "doc_id long, text string")).collect()}
    assert got[0].log_prob > got[9000].log_prob + 5


def test_documents_that_occur_twice_score_above_others(spark):
    rng = random.Random(2)
    made = lambda n: " ".join("".join(rng.choices("abcdefghijklmnop", k=rng.randint(3, 9))) for _ in range(n))
    once, twice = [made(60) for _ in range(300)], [made(60) for _ in range(30)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*once, *twice, *twice])], "doc_id long, text string")
    got = {r.doc_id: r.mean_log_prob for r in lm.score(df).collect()}
    low = sorted(got[i] for i in range(300))[-15]  # nineteen of twenty lie below
    assert sum(got[i] > low for i in range(300, 360)) >= 54


def test_edge_cases(spark):
    rows = [(1, None, 1), (2, "", 1), (3, " \n", 1), (4, "one", 1), (4, "one", 1), (5, "long text " * 20_000, 1), (None, "two", 1)]
    got = sorted(((r.doc_id, r.n_words, r.log_prob, r.mean_log_prob) for r in lm.score(spark.createDataFrame(rows, "doc_id long, text string, ids int"), block=100).collect()), key=lambda r: (r[0] is None, r[0] or 0))
    assert [g[:2] for g in got] == [(1, 0), (2, 0), (3, 0), (4, 1), (4, 1), (5, 40_000), (None, 1)]
    assert got[0][2:] == (0.0, None) and got[3] == got[4] and math.isfinite(got[5][2])
    assert lm.score(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert lm.score(spark.createDataFrame([(1, "")], "doc_id long, text string")).first().log_prob == 0
