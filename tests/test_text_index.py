"""The kept text index against scoring every chunk, as it was built and after changes."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quern.operators import search, text_index
from quern.plans import checks


def plain(chunks, queries, most, only=None):
    words = {i: Counter(re.findall("[a-z0-9]+", (t or "").lower())) for i, t in chunks.items()}
    n, mean = len(chunks), sum(len(t or "") for t in chunks.values()) / max(1, len(chunks))
    df = Counter(w for c in words.values() for w in c)
    out = {}
    for k, q in queries:
        found = []
        for i, c in words.items():
            hit = [w for w in dict.fromkeys(re.findall("[a-z0-9]+", q.lower())) if c[w]]
            if hit and (only is None or i in only):
                norm = 1.2 * (0.25 + 0.75 * len(chunks[i] or "") / mean)
                found.append((-round(sum(math.log((n - df[w] + 0.5) / (df[w] + 0.5) + 1) * c[w] * 2.2 / (c[w] + norm) for w in hit), 9), i))
        out[k] = [i for _, i in sorted(found)[:most]]
    return {k: v for k, v in out.items() if v}


def got(hits):
    out = {}
    for r in sorted(hits.collect(), key=lambda r: (r.query_id, r.text_rank)):
        out.setdefault(r.query_id, []).append(r.id)
    return out


def corpus(seed, n):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    return {i: None if i % 97 == 0 else " ".join(words[int(60 * rng.random() ** 3)] for _ in range(rng.randint(0, 40))) + (f" rare{i % 25}" if i % 25 < 5 else "") for i in range(n)}


QUERIES = [(1, "w0 rare3"), (2, "rare1 rare2 w5"), (3, "w0 w1 w2 w40"), (4, "nowhere"), (5, ""), (6, "W59 w59 w58")]


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(text_index, "BLOCK", 20)


def frame(spark, chunks):
    return spark.createDataFrame(list(chunks.items()), "id long, text string")


def test_same_hits_as_scoring_every_chunk(spark, tmp_path, small):
    chunks = corpus(1, 900)
    asked = spark.createDataFrame(QUERIES, "query_id long, query string")
    index = text_index.build(frame(spark, chunks), str(tmp_path / "index"))
    for most in (5, 50):
        assert got(text_index.text_hits(asked, index, most)) == plain(chunks, QUERIES, most)
    posted = search.postings(frame(spark, chunks))
    leg = search.bm25_leg(posted, search.query_terms(asked, posted), frame(spark, chunks), search.corpus_stats(frame(spark, chunks)), 5)
    assert got(text_index.text_hits(asked, index, 5)) == got(leg)
    only = {i for i in chunks if i % 9 == 4}
    assert got(text_index.text_hits(asked, index, 7, frame(spark, {i: "" for i in only}))) == plain(chunks, QUERIES, 7, only)
    assert text_index.text_hits(asked.limit(0), index).count() == 0
    longest = index.table(spark, "postings").agg(F.max("n")).first()[0]
    assert longest <= 60  # no row grows with its lexeme


def test_blocks_below_the_bar_are_not_read(spark, tmp_path, small, monkeypatch):
    chunks = corpus(2, 900)
    index = text_index.build(frame(spark, chunks), str(tmp_path / "index"))
    seen = []
    standing = text_index._standing
    monkeypatch.setattr(text_index, "_standing", lambda rows, removed: seen.append(rows) or standing(rows, removed))
    text_index.text_hits(spark.createDataFrame([(1, "w0 rare3")], "query_id long, query string"), index, 5).count()
    read = sum(r.count() for r in seen)
    every = index.table(spark, "postings").where("lexeme in ('w0', 'rare3')").agg(F.sum("n")).first()[0]
    assert read < 0.8 * every


def test_kept_current_by_reconciliations_actions(spark, tmp_path, small):
    """Added, deleted, updated and added again; then written as one; a generation that isn't complete isn't read."""
    rng = random.Random(3)
    stored, spare = corpus(4, 500), corpus(5, 700)
    asked = spark.createDataFrame(QUERIES, "query_id long, query string")
    index = text_index.build(frame(spark, stored), str(tmp_path / "index"))
    for _ in range(3):
        now, actions = dict(stored), []
        for i in rng.sample(range(700), 150):
            if i not in now:
                now[i] = spare[i]
                actions.append((i, "add"))
            elif rng.random() < 0.4:
                del now[i]
                actions.append((i, "delete"))
            else:
                now[i] = spare[rng.randrange(700)]
                actions.append((i, "update"))
        actions += [(i, "keep") for i in list(now)[:20] if i not in dict(actions)]
        text_index.changed(index, spark.createDataFrame(actions, "id long, action string"), frame(spark, stored), frame(spark, now))
        stored = now
        assert got(text_index.text_hits(asked, index, 10)) == plain(stored, QUERIES, 10)
    one = text_index.compacted(index, spark, str(tmp_path / "one"))
    assert got(text_index.text_hits(asked, one, 10)) == plain(stored, QUERIES, 10) and text_index.generation(spark, one) == 0
    torn = text_index.TextIndex(index.path, index.blocks)
    text_index._write(torn, 9, text_index._entries(frame(spark, {9999: "w0 rare3"}), torn, "id", "text"), spark.createDataFrame([("rare3", 1)], "lexeme string, n long"), spark.createDataFrame([(1,)], "id long"), spark.createDataFrame([(1, 8)], "chunks long, chars long"))
    import shutil

    shutil.rmtree(tmp_path / "index" / "sizes" / "gen=9")
    assert got(text_index.text_hits(asked, index, 10)) == plain(stored, QUERIES, 10)


def test_a_search_reads_no_texts_and_few_partitions(spark, tmp_path):
    chunks = corpus(6, 300)
    index = text_index.build(frame(spark, chunks), str(tmp_path / "index"))
    table = index.table(spark, "postings", 0).where("bucket in (1, 3)").select("lexeme", "block", "most_tf")
    plan = checks.physical(table)
    assert "bucket" in plan.partition("PartitionFilters:")[2].split("]")[0] and checks.scanned_columns(table) == {"lexeme", "block", "most_tf"}
    asked = spark.createDataFrame(QUERIES, "query_id long, query string")
    found = search.search(asked.withColumn("query_embedding", F.lit(None).cast("array<double>")), frame(spark, chunks).withColumn("embedding", F.lit(None).cast("array<double>")), 5, kept=lambda q, n: text_index.text_hits(q, index, n))
    assert {r.query_id for r in found.collect()} == plain(chunks, QUERIES, 5).keys()


def test_lengths_are_counted_once_a_chunk(spark, tmp_path):
    """Not in a selection with the words, where each word's row would count its text's characters: that grew with the square of a text."""
    index = text_index.TextIndex(str(tmp_path / "none"), 4)
    plan = checks.physical(text_index._entries(frame(spark, {1: "a b a", 2: None}), index, "id", "text"))
    assert "length(" not in plan.split("Exchange")[0] and "length(" in plan


def test_postings_of_weighted_fields(spark, tmp_path, small):
    """Of any batches and blocks: each lexeme's chunks by block, a field's words as often as it weighs; few files for a partition."""
    chunks = {i: (t, None if i % 5 == 0 else f"w1 title{i % 3}") for i, t in corpus(7, 300).items()}
    table = spark.createDataFrame([(i, *c) for i, c in chunks.items()], "id int, text string, title string")
    index = text_index.build(table, str(tmp_path / "index"), fields={"title": 4, "text": 1})
    want = {}
    for i, (text, title) in chunks.items():
        for w, n in (Counter(re.findall("[a-z0-9]+", text or "")) + Counter({w: 4 * n for w, n in Counter((title or "").split()).items()})).items():
            want[w, i] = (n, len(text or ""))
    rows = index.table(spark, "postings").collect()
    assert {(r.lexeme, i): (tf, c) for r in rows for i, tf, c in zip(r.ids, r.tfs, r.chars, strict=True)} == want
    assert len({(r.lexeme, r.block) for r in rows}) == len(rows) and len({r.block for r in rows}) == 15
    assert all((r.n, r.most_tf, r.least_chars) == (len(r.ids), max(r.tfs), min(r.chars)) for r in rows)
    each = [len(list(p.glob("*.parquet"))) for p in (tmp_path / "index" / "postings" / "gen=0").glob("bucket=*")]
    assert max(each) <= 2 * spark.sparkContext.defaultParallelism // index.buckets
