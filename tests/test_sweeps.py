"""Hashes that many tasks work out, and embedding sweeps that go on after failures."""

import hashlib
from collections import Counter

import pytest

from quern.operators import corpus


def plain_tree(lines, digits):
    parts = [(h[:digits], f"{h}:{n}") for h, n in Counter(hashlib.sha256(x.encode()).hexdigest() for x in lines).items()]
    for level in range(digits, -1, -1):
        nodes = {}
        for key, part in parts:
            nodes.setdefault(key, []).append(part)
        digests = {k: hashlib.sha256("".join(sorted(v)).encode()).hexdigest() for k, v in nodes.items()}
        parts = [(k[: max(0, level - 1)], f"{k}:{d}") for k, d in digests.items()]
    return digests[""]


def test_tree_hash(spark, monkeypatch):
    """However rows are dealt, and with a line that a third of them repeat; a changed line or count tells."""
    lines = [f"line {i}" for i in range(400)] + ["again"] * 200
    table = spark.createDataFrame([(x,) for x in lines] + [(None,)], "line string")
    for digits in (0, 1, 2):
        for df in (table, table.repartition(7), table.orderBy("line")):
            r = corpus.tree_hash(df, digits=digits).first()
            assert (r.sha256, r.n) == (plain_tree(lines, digits), 600)
    monkeypatch.setattr(corpus, "LEAF", 40)
    assert corpus.tree_hash(table).first().sha256 == plain_tree(lines, 1)
    other = {corpus.tree_hash(spark.createDataFrame([(x,) for x in some], "line string"), digits=1).first().sha256 for some in (lines, lines[1:], [*lines, "again"], [*lines[:-1], "line 0"])}
    assert len(other) == 4
    empty = corpus.tree_hash(table.limit(0)).first()
    assert (empty.sha256, empty.n) == (hashlib.sha256(b"").hexdigest(), 0)


@pytest.mark.parametrize("page", [1000, 7])
def test_a_failed_batch_is_recorded_and_tried_again_alone(spark, tmp_path, page):
    path = str(tmp_path / "vectors")
    rows = [(f"c{d}", d * 100 + i, i, "bad" if (d, i) == (1, 4) else f"text {i}", [1.0] if d == 0 and i < 3 else None) for d in range(4) for i in range(9)]
    chunks = spark.createDataFrame(rows, "celex string, id long, position int, text string, embedding array<float>")

    def fails(texts):
        if "bad" in texts:
            raise RuntimeError("no answer")
        return [[float(len(t)), float(len(texts))] for t in texts]

    pages = corpus.embed_sweep(chunks, fails, path, page, size=3)
    assert pages == (1 if page == 1000 else 5)
    first = {r.id: r for r in corpus.sweep_results(spark, path).collect()}
    assert len(first) == 33 and all(r.reason == "RuntimeError: no answer" and r.embedding is None for r in first.values() if r.reason)
    lost = {i for i, r in first.items() if r.reason}
    assert 104 in lost and len(lost) <= 3 and {i // 100 for i in lost} == {1}
    assert max(r.embedding[1] for r in first.values() if not r.reason) <= 3  # batches never span documents
    report = {r.celex: (r.embedded, r.failed) for r in corpus.sweep_report(spark, path).collect()}
    assert report == {"c0": (6, 0), "c1": (9 - len(lost), len(lost)), "c2": (9, 0), "c3": (9, 0)}
    # again, with a model that answers: only what has no vector is asked for
    corpus.embed_sweep(chunks, lambda texts: [[9.0]] * len(texts), path, page, size=3)
    again = [r for r in corpus.sweep_results(spark, path).collect() if r.page > pages]
    assert {r.id for r in again} == lost and all(r.embedding == [9.0] for r in again)
    assert all(r.failed == 0 for r in corpus.sweep_report(spark, path).collect())
    assert corpus.embed_sweep(chunks, fails, path, page) == 0


def test_a_model_that_loses_texts_fails_its_batch(spark, tmp_path):
    chunks = spark.createDataFrame([("c", i, i, "t", None) for i in range(4)], "celex string, id long, position int, text string, embedding array<float>")
    corpus.embed_sweep(chunks, lambda texts: [[1.0]], str(tmp_path / "v"))
    assert {r.reason for r in corpus.sweep_results(spark, str(tmp_path / "v")).collect()} == {"ValueError: 1 vectors for 4 texts"}
