"""What grows with the input and no faster."""

import math
import re

from quern.operators import search
from quern.plans import checks


def test_places_are_gathered_once_a_chunk(spark):
    """Cover density: a chunk's places are shuffled by chunk, however many queries ask for its words."""
    docs = spark.createDataFrame([(i, f"the of port state the {i}") for i in range(50)], "id long, text string")
    queries = spark.createDataFrame([(i, "the of port") for i in range(30)] + [(99, "the nowhere"), (100, "state or nowhere"), (101, "the -port")], "query_id long, query string")
    hits = search.cover_density_leg(queries, docs, 60)
    assert not re.search(r"keys=\[query_id#\d+L?, id#\d+L?\], functions=\[\w*collect_list", checks.physical(hits))
    found = {r.query_id: r.n for r in hits.groupBy("query_id").count().withColumnRenamed("count", "n").collect()}
    assert found == {**dict.fromkeys(range(30), 50), 100: 50}


def test_what_a_context_shows_is_told_once(spark, monkeypatch):
    """Calls meet the distinct parts and points of their article, not every block that shows them."""
    from quern.operators import context

    met = []
    few = search.few
    monkeypatch.setattr(search, "few", lambda df: met.append(df.count()) or few(df))
    sources = spark.range(4000).selectExpr("1L AS context_id", "'c' AS celex", "'1A' AS article", "'2' AS paragraph", "int(id % 2 + 1) AS part", "2 AS parts", "array('a', 'b') AS points")
    rows = [(1, 1, "2", None), (2, 1, "3", None), (3, 1, None, "B"), (4, 1, None, "x"), (5, 2, "2", None)]
    calls = spark.createDataFrame(rows, "call_id long, context_id long, paragraph string, point string").selectExpr("*", "'follow_reference' AS name", "'c' AS celex", "'1a' AS article")
    assert {r.call_id for r in context.already_shown(calls, sources).collect()} == {1, 3}
    assert met and max(met) == 2


def test_refunds_and_requests_of_one_second(spark):
    """A day's spend where costs may be negative and many requests share a second."""
    from quern.streaming import limits

    rows = [(i, 1_700_000_000 + (i // 3) * 13_007, (-5.0 if i % 4 == 1 else 2.5) if i % 5 else None) for i in range(120)]
    ledger = spark.createDataFrame(rows, "id long, t long, cost_usd double").selectExpr("id", "timestamp_seconds(t) AS created_at", "cost_usd")
    got = {r.id: r.spend_usd for r in limits.over_cap(ledger, 20.0).collect()}
    assert got == {i: sum(c or 0 for _, u, c in rows if t - 86_400 <= u <= t) for i, t, _ in rows}
    assert "gone" not in "".join(re.findall(r"Join.*", checks.physical(limits.over_cap(ledger, 20.0))))


def test_hits_are_added_up_where_they_arise(spark):
    """The text leg shuffles postings by chunk, and of its hits only those that are ranked."""
    from quern.registry import QUERIES

    plan = checks.physical(QUERIES["bm25_topk"](spark, "/root/testdata/sf0.001"))
    assert not re.search(r"Exchange hashpartitioning\(query_id#\d+L?, id#\d+L?", plan)


def test_words_are_looked_for_in_one_slice_first(spark, monkeypatch):
    """Words of several lexemes meet the chunks of their rarest; those that a slice of all chunks has aren't looked for in the others."""
    asked = []
    few = search.few
    monkeypatch.setattr(search, "few", lambda df: asked.append({r.word for r in df.collect()} if "word" in df.columns else None) or few(df))
    docs = spark.createDataFrame([(i, "port-state fuel" + (" oil" if i == 3 else " rare" if i == 4 else "")) for i in range(900)], "id long, text string")
    words = spark.createDataFrame([("port-state",), ("fuel-oil",), ("oil-rare",), ("fuel",), ("nowhere",), ("fuel-nowhere",), ("The",)], "word string")
    found = {r.word for r in search.words_in_corpus(words, search.postings(docs), ["the"]).collect()}
    assert found == {"port-state", "fuel-oil", "fuel", "The"}
    assert "port-state" in asked[0] and "port-state" not in asked[1] and not {"nowhere", "fuel-nowhere"} & asked[0]


def test_cosines_by_block(spark, monkeypatch):
    """Blocks of vectors give what the column function gives pair by pair, null vectors and labels included."""
    from quern.functions import vectors

    monkeypatch.setattr(vectors, "BLOCK", 3)
    rows = [(i, None if i % 11 == 5 else [0.0, 0.0] if i % 13 == 4 else [1.0, float(i % 5), 2.0] if i % 9 == 2 else [1.0, None] if i % 17 == 3 else [float(i % 7) - 3, float(i)], None if i % 10 == 9 else i % 2) for i in range(60)]
    e = spark.createDataFrame(rows, "id long, v array<float>, label int")
    a, b = e.where("id % 4 = 0").selectExpr("id AS a", "v AS x", "label"), e.selectExpr("id AS b", "v AS y", "label")
    got = {(r.a, r.b): r.cosine and round(r.cosine, 9) for r in vectors.cosines(a, b, "label").collect()}
    want = {(r.a, r.b): r.c and round(r.c, 9) for r in a.join(b, "label").select("a", "b", vectors.cosine(a["x"], b["y"]).alias("c")).collect()}
    assert got == want and None in got.values()


def test_the_nearest_is_exact_with_any_probes(spark, tmp_path):
    """Vectors without crowds, behind a filter: one cell probed first rarely has the nearest, which is found all the same."""
    import numpy as np

    from quern.operators import vector_index as v

    rows = [(i, x.tolist()) for i, x in enumerate(np.random.default_rng(8).normal(size=(900, 12)))]
    table = spark.createDataFrame(rows, "id long, embedding array<double>").selectExpr("*", "id % 3 AS third")
    asked = table.where("id % 20 = 1").selectExpr("id AS query_id", "embedding AS query_embedding")
    index = v.build(table, str(tmp_path / "index"), keep=("third",))
    first = lambda hits: {r.query_id: r.id for r in hits.where("vector_rank = 1").collect()}
    assert first(v.index_hits(asked, index, 5, "third = 0", probes=1)) == first(v.ranked_hits(v.exact_hits(asked, table.where("third = 0"), 5), 5))


def test_an_index_shuffles_texts_and_no_words(spark):
    """Chunks are dealt by block once; their postings are counted and gathered by block where they are."""
    from quern.operators import text_index

    docs = spark.createDataFrame([(i, f"port of {i}") for i in range(50)], "id long, text string")
    entries = text_index._entries(docs, text_index.TextIndex("", 7), "id", "text")
    assert checks.exchanges(entries.groupBy("lexeme", "block").count()) == 1
    assert entries.count() == 150


def test_hits_below_a_slices_last_are_not_ranked(spark, monkeypatch):
    """One slice's ranking bars the others' hits before they are sorted; ranks, ties and texts that are null stay as without it."""
    monkeypatch.setattr(search, "SLICES", 2)
    met, plain = [], search.ranked
    monkeypatch.setattr(search, "ranked", lambda scored, *more: met.append(scored.count()) or plain(scored, *more))
    rows = [(i, None if i % 50 == 7 else "port " * (1 + i % 3) + "state " * (i % 40 == 0) + f"sea{i % 4} quay", "web") for i in range(400)]
    docs = spark.createDataFrame(rows, "id long, text string, citation string")
    queries = spark.createDataFrame([(1, "port state"), (2, "port quay web"), (3, "nowhere"), (4, "sea2")], "query_id long, query string")
    posted = search.postings(search.dealt(docs), fields={"citation": 4, "text": 1}, asked=search.lexemes(queries), body="text")
    got = {(r.query_id, r.text_rank): (r.id, round(r.score, 6)) for r in search.bm25_leg(posted, search.query_terms(queries, posted), None, search.corpus_stats(docs), 5).collect()}
    words = {i: (c.split() * 4 + (t or "").split(), t and len(t)) for i, t, c in rows}
    lengths = [n for _, n in words.values() if n is not None]
    want = {}
    for q, asked in ((1, "port state"), (2, "port quay web"), (4, "sea2")):
        sums = {}
        for w in asked.split():
            df = sum(w in ws for ws, _ in words.values())
            for i, (ws, n) in words.items():
                if w in ws and n is not None:
                    tf, norm = ws.count(w), 0.25 + 0.75 * n / (sum(lengths) / len(lengths))
                    sums[i] = sums.get(i, 0) + math.log((len(rows) - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * norm)
        best = sorted(sums.items(), key=lambda x: (-round(x[1], 9), x[0]))[:5]
        want |= {(q, k): (i, round(x, 6)) for k, (i, x) in enumerate(best, 1)}
    assert got == want
    assert len(met) == 2 and met[1] < 400  # of 892 pairs


def test_weighted_postings_are_counted_where_their_texts_are(spark):
    """Texts are dealt by id and the ranked hits by query; no postings are shuffled or sorted."""
    from quern.registry import QUERIES

    plan = checks.physical(QUERIES["bm25_weighted"](spark, "/root/testdata/sf0.001"))
    assert not re.search(r"Exchange hashpartitioning\(id#\d+L?, (?:chars#\d+, )?lexeme#", plan) and "SortMergeJoin" not in plan


def test_texts_are_dealt_once_for_the_text_leg(spark):
    """Each text is shuffled once by id; its postings aren't."""
    from quern.registry import QUERIES

    plan = checks.physical(QUERIES["bm25_topk"](spark, "/root/testdata/sf0.001"))
    assert len(re.findall(r"Exchange hashpartitioning\(id#", plan)) == 1 and "SortMergeJoin" not in plan


def test_hybrid_text_legs_shuffle_no_postings(spark):
    """Nor do those of the general search, whose chunks may be filtered."""
    from quern.registry import QUERIES

    rows = [(i, f"port of {i}", [1.0, float(i)], i % 2) for i in range(40)]
    chunks = spark.createDataFrame(rows, "id long, text string, embedding array<double>, half int")
    queries = spark.createDataFrame([(1, "port of 8", [1.0, 8.0])], "query_id long, query string, query_embedding array<double>")
    found = search.search(queries, chunks, limit=3, only=chunks.where("half = 0"))
    for df in (QUERIES["hybrid_topk"](spark, "/root/testdata/sf0.001"), found):
        assert not re.search(r"Exchange hashpartitioning\(id#\d+L?, (?:chars#\d+, )?lexeme#", checks.physical(df))
    hits = found.collect()
    assert {r.id % 2 for r in hits} == {0} and next(r.id for r in hits if r["rank"] == 1) == 8
