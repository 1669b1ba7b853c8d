"""Upkeep of a corpus and rounds of calls on hand-worked cases."""

import json

import pytest
from pyspark.sql import functions as F

from quern.operators import context, corpus, evals
from quern.sources import formulas, store

CHUNKS = "id long, celex string, topic string, article string, annex string, paragraph string, points array<string>, part int, parts int, position int"


def chunk_rows(spark):
    rows = [(i, "A", "t", "1", None, p, pts, 1, 1, i) for i, (p, pts) in enumerate([("2", []), ("10", []), ("2a", []), (None, ["b", "c"]), ("1", ["a"])])]
    rows += [(10, "A", "t", None, "", None, [], 1, 1, 10), (11, "A", "t", None, "I", None, [], 2, 2, 12), (12, "A", "t", None, "I", "9", [], 1, 2, 11)]
    rows += [(20 + i, "B", "t", "5", None, str(i), [], 1, 1, 20 + i) for i in range(8)]
    return spark.createDataFrame(rows, CHUNKS)


def test_follows_articles_and_annexes(spark):
    targets = spark.createDataFrame([(1, "A", "1", None, None, None), (2, "A", None, None, None, ""), (3, "A", None, None, None, "I"), (4, "A", "1", "b", None, None), (5, "A", "1", None, "A", None), (6, "A", None, None, None, None), (7, "A", "9", None, None, None)], "target_id long, celex string, article string, paragraph string, point string, annex string")
    got = {}
    for r in context.follow_references(targets, chunk_rows(spark)).orderBy("target_id", "place").collect():
        got.setdefault(r.target_id, []).append(r.id)
    assert got == {1: [3, 4, 0, 2, 1], 2: [10], 3: [12, 11], 4: [3], 5: [4]}


def test_a_round_of_calls(spark):
    chunks = chunk_rows(spark)
    calls = spark.createDataFrame(
        [(1, 100, 1, "follow_reference", "B", "5", None, None, None), (2, 100, 2, "search", None, None, None, None, None), (3, 100, 3, "refuse", None, None, None, None, None), (4, 200, 1, "refuse", None, None, None, None, None), (5, 300, 1, "follow_reference", "A", "1", "1", None, None), (6, 300, 2, "follow_reference", "A", None, None, None, "I")],
        "call_id long, context_id long, place int, name string, celex string, article string, paragraph string, point string, annex string",
    )
    sources = spark.createDataFrame([(300, "A", "1", "1", 1, 1, ["a"])], "context_id long, celex string, article string, paragraph string, part int, parts int, points array<string>")
    present = spark.createDataFrame([(100, 99, 1), (300, 4, 1)], "context_id long, key long, place int")
    found = spark.createDataFrame([(2, 21, 1), (2, 77, 2)], "call_id long, id long, place int")
    got = context.tool_round(present, calls, sources, chunks, found, cap=7)
    at = {}
    for r in got.contexts.orderBy("context_id", "place").collect():
        at.setdefault(r.context_id, []).append(r.key)
    # five parts followed at most, a block found twice stays once, the cap holds; what is shown isn't fetched again
    assert at == {100: [99, 20, 21, 22, 23, 24, 77], 300: [4, 12, 11]}
    assert [r.context_id for r in got.refused.collect()] == [200]


def test_two_passes_with_one_hop(spark):
    refs = {"A": ["X", "B"], "B": ["A", "Y"], "X": ["Z"], "Y": []}
    library = spark.createDataFrame([(k, v) for k, v in refs.items()], "celex string, cites array<string>")

    def chunked(documents):
        refs_ = F.transform("cites", lambda c: F.struct(c.alias("instrument"), F.lit("1").alias("article"), F.lit(None).cast("string").alias("annex")))
        return documents.join(library, "celex").select("celex", "topic", refs_.alias("references"), F.lit("abcd").alias("text"))

    documents = spark.createDataFrame([("A", "t"), ("B", "t")], "celex string, topic string")
    got = corpus.ingested(documents, spark.createDataFrame([("Y",)], "celex string"), chunked, lambda acts: acts)
    assert sorted((r.celex, r.topic) for r in got.collect()) == [("A", "t"), ("B", "t"), ("X", corpus.HOP_TOPIC)]
    outcomes = spark.createDataFrame([(1, "t", "new"), (1, "cited", "failed"), (2, "t", "failed")], "run_id long, topic string, result string")
    assert sorted(map(tuple, corpus.close_out(outcomes, got).collect())) == [(1, "success", 3, 4.0), (2, "failed", None, None)]
    kept = corpus.pruned(got, documents.where("celex = 'A'"), True, spark.createDataFrame([("X",)], "celex string"))
    assert sorted(r.celex for r in kept.collect()) == ["A", "X"] and corpus.pruned(got, documents, False).count() == 3
    both = corpus.discovered(documents, documents.where("celex = 'A'"))
    assert both.count() == 2


def test_shrinking_corpora(spark):
    before = spark.createDataFrame([(str(i),) for i in range(10)], "celex string")
    assert corpus.check_shrink(before.where("celex > 1"), before) == 2
    with pytest.raises(corpus.CorpusError):
        corpus.check_shrink(before.where("celex > 2"), before)
    assert corpus.next_version("d1-abc", "abc", "d2") == "d1-abc" and corpus.next_version("d1-abc", "xyz", "d2") == "d2-xyz" and corpus.next_version(None, "x", "d") == "d-x"
    with pytest.raises(Exception, match="no chunks over stored ones"):
        rows = spark.createDataFrame([("a", "h", 0, 1, "m")], "celex string, content_hash string, occurrence int, id long, metadata_hash string")
        corpus.reconcile_counts(rows, rows.where("false")).collect()


def test_comparisons_and_reports(spark):
    base = spark.createDataFrame([("a", "1.5", 0, True), ("b", "true", 1, False), ("c", "2", 2, True)], "metric string, value string, place int, number boolean")
    other = spark.createDataFrame([("a", "1.25", 0, True), ("b", "false", 1, False), ("d", "3", 2, True)], "metric string, value string, place int, number boolean")
    got = [(r.metric, r.delta, r.shown) for r in evals.compared(base, other).collect()]
    assert got == [("a", -0.25, "-0.250"), ("b", None, None), ("c", None, None), ("d", None, None)]
    declared = spark.createDataFrame([("d", 0), ("b", 1), ("a", 2)], "metric string, place int")
    assert [r.metric for r in evals.compared(base, other, declared).collect()] == ["d", "b", "a", "c"]
    assert [x["name"] for x in evals.sweep({"k": [1, 2], "w": [5]}, {"k": 1, "w": 3}, lambda s: {"settings": s}, {"w": {"k": 9}})] == ["baseline", "k=2", "w=5"]
    with pytest.raises(ValueError, match="nothing is stamped"):
        cases = spark.createDataFrame([("x", [("A", "99", None, None, None, [])])], "case_id string, targets array<struct<celex:string,article:string,paragraph:string,point:string,annex:string,content_hashes:array<string>>>")
        evals.stamped(cases, chunk_rows(spark).withColumn("content_hash", F.lit("h")))


def test_cases_from_lines(spark, tmp_path):
    def load(*cases):
        path = tmp_path / str(len(list(tmp_path.iterdir())))
        path.write_text("\n".join(json.dumps(c) for c in cases))
        return evals.load_cases(spark, str(path))

    good = [{"case_id": "a", "kind": "in_corpus", "question": "q", "answer": "x"}, {"case_id": "b", "kind": "out_of_corpus", "question": "q"}]
    cases = load(*good)
    assert cases.count() == 2
    for bad in ([], [{**good[0], "kind": "other"}], [good[0], good[0]], [{**good[1], "answer": "x"}]):
        with pytest.raises(ValueError):
            load(*bad)
    evals.save_cases(cases, str(tmp_path / "saved"))
    again = evals.load_cases(spark, str(tmp_path / "saved"))
    assert evals.dataset_hash(again).first() == evals.dataset_hash(cases).first() != evals.dataset_hash(cases.limit(1)).first()


def test_snapshots(spark, tmp_path):
    tables = {"a": spark.range(3), "b": spark.range(2)}
    for name in ("2024-01-01", "2024-02-01"):
        store.dump(tables, str(tmp_path), name)
    newest = store.newest_dump(spark.createDataFrame([("2024-01-01",), ("2024-02-01",)], "name string")).first().name
    got = store.restored(spark, str(tmp_path), newest, ["a", "b"])
    assert newest == "2024-02-01" and {k: v.count() for k, v in got.items()} == {"a": 3, "b": 2}
    store.swap_periods(spark.createDataFrame([(1, "x"), (2, "y")], "period int, v string"), str(tmp_path / "p"))
    store.swap_periods(spark.createDataFrame([(2, "z")], "period int, v string"), str(tmp_path / "p"))
    store.appended(spark.createDataFrame([("w", 3)], "v string, period int").select("v"), str(tmp_path / "p" / "period=3"))
    assert sorted((r.period, r.v) for r in spark.read.parquet(str(tmp_path / "p")).collect()) == [(1, "x"), (2, "z"), (3, "w")]
    found = store.listed(spark, str(tmp_path / "p"), "*.parquet")
    assert found.count() >= 3 and found.where("length <> octet_length(content)").isEmpty()


def test_every_formula_mark():
    of = lambda inside: formulas.latex(f"<FORMULA>x{inside}y</FORMULA>")
    for kind, sign in formulas.OPERATORS.items():
        assert of(f"<OP.MATH TYPE='{kind}'/>") == f"x {sign} y"
    for kind, sign in formulas.COMPARISONS.items():
        assert of(f"<OP.CMP TYPE='{kind}'/>") == f"x {sign} y"
    for kind, (left, right) in formulas.BRACKETS.items():
        assert of(f"<EXPR TYPE='{kind}'>a</EXPR>") == f"x{left}a{right}y"
    assert of("<EXPR>a</EXPR><HT TYPE='ITALIC'>b</HT><FMT.VALUE>5</FMT.VALUE>") == "xab5y"
    assert of("<IND>a</IND><IND>b</IND> <IND>c</IND><EXPONENT>2</EXPONENT><HT TYPE='SUP'>3</HT> <HT TYPE='SUB'>k</HT>") == "x_{ab\\,c}^{23} _{k}y"
    assert of("<SUM><UNDER>i</UNDER><OVER>n</OVER></SUM>") == "x\\sum_{i}^{n}y" and of("<SUM/>") == "x\\sumy"
    assert of("<FRACTION><DIVIDEND>a</DIVIDEND></FRACTION>") == "x\\frac{a}{}y"
    assert formulas.plain_latex("Α Β Γ Δ α ω ο ∑ – 50% a_b two words z") == "A B \\Gamma  \\Delta  \\alpha  \\omega  omicron \\sum  - 50\\% a\\_\\text{b two words z}"
    for bad in ("<OP.MATH TYPE='ROOT'/>", "<HT TYPE='BOLD'>b</HT>", "<EXPR TYPE='ODD'>a</EXPR>", "<NOTE>n</NOTE>"):
        with pytest.raises(formulas.FormulaError):
            of(bad)
