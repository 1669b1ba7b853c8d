import random
import re
import zlib

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from quern.functions import stem
from quern.operators import context, cover, figures, search, tools


def test_stems():
    for words, want in (("consign consigned consigning consignment", "consign"), ("knack knacks", "knack"), ("generate generates generated generating", "generat")):
        assert {stem.stem(w) for w in words.split()} == {want}
    assert [stem.stem(w) for w in "caresses ties cries dying hopping hoping national relational happy by says emissions monitoring vessels succeed".split()] == ["caress", "tie", "cri", "die", "hop", "hope", "nation", "relat", "happi", "by", "say", "emiss", "monitor", "vessel", "succeed"]
    assert stem.lexemes("The monitoring of the emissions") == ["monitor", "emiss"]


def test_stemmed_search(spark):
    chunks = spark.createDataFrame([(1, "monitoring emissions of ships"), (2, "nothing here")], "id long, text string")
    posted = search.postings(chunks, stem.english_lexemes)
    terms = search.query_terms(spark.createDataFrame([(1, "the monitored emission")], "query_id long, query string"), posted, stem.english_lexemes)
    assert [r.id for r in search.bm25_leg(posted, terms, chunks, search.corpus_stats(chunks)).collect()] == [1]


def test_embedders(spark):
    rows = spark.createDataFrame([("a b",), (None,), ("b a",)], "text string")
    got = [r.embedding for r in tools.embedded(rows).collect()]
    assert got[0] == got[2] and abs(sum(x * x for x in got[0]) - 1) < 1e-5
    assert [r.embedding for r in tools.embedded(rows, lambda ts: [[float(len(t))] for t in ts]).collect()] == [[3.0], [0.0], [3.0]]
    with pytest.raises(Exception, match="0 vectors"):
        tools.embedded(rows, lambda ts: []).collect()


def test_tools_fail_alone(spark):
    def bad(_):
        raise RuntimeError("no")

    told = []
    registry = tools.Registry(tools.Tool("ok", lambda c: c.select("call_id")), tools.Tool("bad", bad))
    calls = spark.createDataFrame([(1, "ok"), (2, "bad"), (3, "unknown")], "call_id long, name string")
    assert [r.call_id for r in registry.run(calls, lambda n, e: told.append(n)).collect()] == [1] and told == ["bad"]


def test_context_text(spark):
    rows = [(1, 2, "Regulation B", "Article 2", "b", None, "tb", "f"), (1, 1, "Regulation A", "Article 1", "a", "On A", "ta", None), (1, 3, "Regulation A", "Annex", "a", "On A", "tc", None)]
    got = context.formatted_context(spark.createDataFrame(rows, "context_id long, place int, name string, citation string, act string, act_title string, text string, footer string")).collect()[0]
    assert got.text == "Acts:\nRegulation A: On A\n\n[1] (Regulation A, Article 1)\nta\n\n[2] (Regulation B, Article 2)\ntb\nf\n\n[3] (Regulation A, Annex)\ntc"


def test_figure_text(spark):
    from quern.plans.tables import reports

    q = figures.Question(1995, "company")
    got = figures.with_text(figures.query_reports(reports(spark, "/root/testdata/sf0.001"), q), q).collect()[0]
    assert got.text.startswith("Emissions reported for reporting period 1995, per company, from the public dataset (file version 1, generated 2024-01-01)")
    assert "all matched reports together — " in got.text and "EU ETS emissions" not in got.text
    total = {"reports": 1, **dict.fromkeys(figures.FIGURES, 1000.4), "reports_with_ets": 1, "median_ets_ratio": 0.5, "matching_ets_ratio": 0}
    q = figures.Question(2024, "ship", "Carras")
    row = Row(version=1, generated="2024-01-01", subject=figures.subject(q), groups=[Row(label="x", **total), Row(label="y", **{**total, "reports": 1200})], group_count=4, overall=Row(**total))
    text = figures.with_text(spark.createDataFrame([row]), q, "d").first().text
    assert 'company matching "Carras", per ship' in text and "x — 1 report\n" in text and "y — 1,200 reports\n  total CO2: 1,000 t" in text and "phase-in of 40%): 400 t" in text
    assert "Only the 2 largest by ETS figure of 4" in text and "Each of the other 2 has a smaller ETS figure" in text and text.endswith("median of 0.50, and 0% of reports sit within 1% of it.")
    empty = Row(version=1, generated="2024-01-01", subject="s", groups=row.groups, group_count=4, overall=Row(**{**total, "reports": 0}))
    assert figures.with_text(spark.createDataFrame([empty]), q, "d").first().text.endswith("No report in this period matches.")


def _search_inputs(spark):
    chunks = spark.createDataFrame([(i, f"word{i} common", [1.0, float(i)], "a", None if i < 6 else "1", i, 1, 1) for i in range(8)], "id long, text string, embedding array<double>, celex string, article string, position int, part int, parts int")
    queries = spark.createDataFrame([(1, 1, 0, "word2 common", [1.0, 2.0]), (2, 1, 1, "word5", [1.0, 5.0]), (3, 2, 0, "nothing", None)], "query_id long, question_id long, query_index int, query string, query_embedding array<double>")
    return chunks, queries


def test_a_scorer_that_fails_leaves_the_fused_order(spark):
    chunks, queries = _search_inputs(spark)

    def planned(hits):
        raise RuntimeError("no model")

    def model(asked, texts):
        raise RuntimeError("timeout")

    plain = search.search(queries, chunks, 3).select("query_id", "id", "rank").collect()
    for rerank in (planned, search.guarded(model, queries, chunks)):
        got = search.search(queries, chunks, 3, rerank=rerank)
        assert sorted(map(tuple, got.select("query_id", "id", "rank").collect())) == sorted(map(tuple, plain))
        assert got.where("reranker_relevance is not null").isEmpty()
    good = search.search(queries, chunks, 3, rerank=search.guarded(lambda asked, texts: [float(t.startswith("word7")) for t in texts], queries, chunks))
    assert {r.id for r in good.where("rank = 1 and query_id < 3").collect()} == {7}
    by_overlap = search.search(queries, chunks, 1, rerank=search.overlap_scorer(queries, chunks)).where("query_id = 2").first()
    assert (by_overlap.id, by_overlap.reranker_relevance) == (5, 1.0)


def test_legs_can_be_chosen_and_filters_come_first(spark):
    chunks, queries = _search_inputs(spark)
    covered = search.search(queries, chunks, 8, ranker=search.COVER)
    assert {(r.query_id, r.id) for r in covered.where("text_rank = 1").collect()} == {(1, 2), (2, 5)}
    only = search.filtered(chunks, ["a"], None).where("id < 3")
    assert {r.id for r in search.search(queries, chunks, 8, only=only).collect()} == {0, 1, 2}
    assert search.filtered(chunks, []).isEmpty() and search.filtered(chunks.withColumn("topic", F.lit("t")), topic="u").isEmpty()
    with pytest.raises(ValueError):
        search.search(queries, chunks, ranker="other")


def test_covers_by_hand(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "a x x b a b"), (3, "a a"), (4, None)], "id long, text string")
    queries = spark.createDataFrame([(1, "a b"), (2, ""), (3, "a"), (4, "-a"), (5, None)], "query_id long, query string")
    got = {(r.query_id, r.id): round(r.score, 6) for r in search.cover_density_leg(queries, docs).collect()}
    # covers of 2: a..b (two words between), b a, a b; an entry of a text weighs 0.2
    assert got == {(1, 1): 0.2, (1, 2): round(0.2 * (1 / 3 + 1 + 1), 6), (3, 1): 0.2, (3, 2): 0.4, (3, 3): 0.4}


def test_web_queries():
    assert cover.parts_of('ships -"port state" or "fuel oil" -tax or') == [(0, False, "ships"), (0, True, "port state"), (1, False, "fuel oil"), (1, True, "tax")]
    assert cover.parts_of("or a") == [(0, False, "a")] and cover.parts_of(None) == []


def _plain_rank(alternatives, entries):
    """Every span of entries, the least ones that match, as the rank is defined."""
    entries = sorted(entries)

    def matches(span):
        at = {(p, w) for p, w, _ in span}
        there = lambda words: any(all((p + j, w) in at for j, w in enumerate(words)) for p, _ in at)
        return any(any(not n for n, _ in a) and all(there(w) != n for n, w in a) for a in alternatives)

    spans = [(i, j) for i in range(len(entries)) for j in range(i, len(entries)) if matches(entries[i : j + 1])]
    least = [(i, j) for i, j in spans if not any((k, m) != (i, j) and i <= k and m <= j for k, m in spans)]
    total = 0.0
    for i, j in least:
        noise = entries[j][0] - entries[i][0] - (j - i)
        total += (j - i + 1) / sum(1 / w for _, _, w in entries[i : j + 1]) / (1 + noise)
    return total if least and matches(entries) else None


def test_density_against_every_span():
    rng = random.Random(1)
    for _ in range(3000):
        alternatives = [[(False, tuple(rng.choice("abc") for _ in range(rng.choice([1, 1, 2])))) for _ in range(rng.randint(1, 3))] for _ in range(rng.randint(1, 2))]
        entries = [(p, rng.choice("abcx"), rng.choice([0.2, 0.4, 1.0])) for p in range(rng.randint(0, 14))]
        entries = [e for e in entries if e[1] != "x"]
        got, want = cover.density(alternatives, entries), _plain_rank(alternatives, entries)
        assert (got is None) == (want is None) and (want is None or got == pytest.approx(want)), (alternatives, entries)
    assert cover.density([[(False, ("a",)), (True, ("b",))]], [(0, "a", 0.2), (1, "c", 0.2)]) == pytest.approx(0.2)
    assert cover.density([[(False, ("a",)), (True, ("b",))], [(False, ("b",))]], [(0, "b", 0.2)]) == pytest.approx(0.2)


def test_web_queries_over_fields(spark):
    docs = spark.createDataFrame([(1, "Art 5", "port state control"), (2, "Art 6", "state port"), (3, None, "fuel oil port"), (4, "port", "state")], "id long, citation string, text string")
    queries = spark.createDataFrame([(1, '"port state"'), (2, "port -fuel"), (3, '"fuel oil" or art'), (4, "state-control")], "query_id long, query string")
    got = {}
    for r in search.cover_density_leg(queries, docs, fields={"citation": "A", "text": "C"}).collect():
        got.setdefault(r.query_id, {})[r.id] = round(r.score, 6)
    assert got == {1: {1: 0.2, 4: round(2 / (1 + 5), 6)}, 2: {1: 0.2, 2: 0.2, 4: 1.0}, 3: {1: 1.0, 2: 1.0, 3: 0.2}, 4: {1: 0.2}}


def test_retrieval_of_questions(spark):
    chunks, queries = _search_inputs(spark)
    questions = spark.createDataFrame([(1, "Which word?", [1.0, 0.0]), (2, "Which figures?", [0.0, 1.0])], "question_id long, question string, question_embedding array<double>")
    cards = spark.createDataFrame([("figures", ["figures"], None)], "tool string, terms array<string>, embedding array<double>")
    got = context.retrieve(queries, chunks, questions, cards, limit=2, context_chunks=4)
    sources = [(r.question_id, r.id) for r in got.sources.orderBy("question_id", "place").collect()]
    assert {q for q, _ in sources} == {1} and {2, 5} <= {i for _, i in sources} and len(sources) <= 4
    assert [(r.question_id, r.tool) for r in got.tools.collect()] == [(2, "figures")]
    assert context.retrieve(queries, chunks, questions, cards, assess=False).tools.isEmpty()
    assert {r.question_id for r in got.hits.collect()} == {1}


def test_hashed_vectors_against_plain_counting(spark):
    texts = ["The cat, the CAT", "", None, "a b c d"]
    got = tools.embedded(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string")).orderBy("id").collect()
    for t, r in zip(texts, got, strict=True):
        counts = [0.0] * 64
        for w in re.findall("[a-z0-9]+", (t or "").lower()):
            for i in range(64):
                counts[zlib.crc32(f"{w}:{i}".encode()) % 64] += 1
        size = sum(x * x for x in counts) ** 0.5
        assert r.embedding is None if not size else r.embedding == pytest.approx([x / size for x in counts], abs=1e-6)
