"""Markup, chunks, references, formulas, workbooks and stores on small hand-made inputs."""

import io
import random
import tracemalloc
import zipfile

import pytest
from pyspark.sql import functions as F

from quern.functions import references, text
from quern.operators import chunking, context, corpus, figures
from quern.sources import feeds, formulas, markup, store, workbook

PUBLISHED_ACT = """<body><p class="oj-normal">Whereas nothing.</p>
<div class="eli-subdivision" id="art_1"><p class="oj-ti-art">Article 1</p><div class="eli-title"><p>Scope</p></div>
<div id="001.001"><p class="oj-normal">1. First ( ) part.</p><table><tr><td>(a)</td><td>one;</td></tr></table></div><div id="001.002"><p>2. Second.</p></div></div>
<div class="eli-subdivision" id="art_2"><p class="oj-ti-art">Article 2</p><p class="oj-normal">Only text.</p></div>
<div id="anx_I"><p class="oj-doc-ti">ANNEX I</p><p class="oj-doc-ti">Methods</p><p>Intro</p><table class="oj-table"><tr><td>h</td><td>k</td></tr><tr><td>1</td><td>2</td></tr></table><p>After</p></div></body>"""
FLAT_ACT = """<body><p class="norm">Recital</p><p class="title-article-norm">Article 3a</p><p class="stitle-article-norm">Duties</p>
<div class="norm"><span class="no-parag">1.  </span><div class="norm inline-element">Do this ►M1 now◄.</div></div><div class="norm"><span class="no-parag">2a.</span><div class="norm inline-element">And that.</div></div>
<hr class="separator-annex"><p class="title-annex-1">ANNEX II</p><p class="title-gr-seq-level-1">Rules</p><p class="title-gr-seq-level-2">A</p><p class="norm">text a</p><p class="title-gr-seq-level-3">A1</p><p class="norm">text a1</p><p class="title-gr-seq-level-2">B</p><p class="norm">text b</p></body>"""


def outline(html):
    return [(r["depth"], r["kind"], r["number"], r["title"], r["text"]) for r in markup.sections(html)]


def test_published_dialect():
    assert outline(PUBLISHED_ACT) == [
        (0, "article", "1", "Scope", ""), (1, "paragraph", "1", None, "First part.\n(a) one;"), (1, "paragraph", "2", None, "Second."),
        (0, "article", "2", None, ""), (1, "paragraph", None, None, "Only text."),
        (0, "annex", "I", "Methods", ""), (1, "paragraph", None, None, "Intro"), (1, "table", None, None, ""), (1, "paragraph", None, None, "After"),
    ]


def test_consolidated_dialect():
    assert outline(FLAT_ACT) == [
        (0, "article", "3a", "Duties", ""), (1, "paragraph", "1", None, "Do this now ."), (1, "paragraph", "2a", None, "And that."),
        (0, "annex", "II", "Rules", ""), (1, "heading", None, "A", ""), (2, "paragraph", None, None, "text a"), (2, "heading", None, "A1", ""), (3, "paragraph", None, None, "text a1"),
        (1, "heading", None, "B", ""), (2, "paragraph", None, None, "text b"),
    ]
    for bad in ("<p>x</p>", '<p class="norm">no article</p>'):
        with pytest.raises(markup.MarkupError):
            markup.sections(bad)
    with pytest.raises(markup.MarkupError):
        markup.sections(FLAT_ACT, ["x"])


def test_documents_to_chunks(spark):
    rows = spark.createDataFrame([(1, PUBLISHED_ACT), (2, "<p>x</p>"), (3, None)], "doc_id long, html string")
    parsed = markup.parse_documents(rows)
    assert {r.doc_id: r.error for r in parsed.where("error is not null").collect()} == {2: "no known dialect", 3: "no known dialect"}
    got = chunking.chunk_documents(parsed.where("error is null"), 2026).orderBy("position").collect()
    assert [(r.article, r.annex, r.paragraph, r.text) for r in got] == [("1", None, "1", "First part.\n(a) one;"), ("1", None, "2", "Second."), ("2", None, None, "Only text."), (None, "I", None, "Intro\nh | k\n1 | 2\nAfter")]
    assert got[0].points == ["a"] and got[3].title == "Methods"


def test_splits():
    assert chunking.split_text("aa bb. cc\ndd", 6) == ["aa bb.", "cc\ndd"]
    assert chunking.split_text("x" * 7, 3) == ["xxx", "xxx", "x"]
    assert chunking.split_table([("h",), ("a",), ("b",)], 3) == ["h\na", "h\nb"]
    assert chunking.split_table([("header",), ("a",)], 6) == ["header", "a"]
    assert chunking.split_text("", 5) == []


def cites(t):
    return [(r.raw, r.instrument, r.article, r.paragraph, r.point, r.annex) for r in references.extract(t, 2026)]


def test_references():
    assert cites("See Articles 6, 7(2) and 8 of Regulation (EU) 2015/757.") == [
        ("Article 6 of Regulation (EU) 2015/757", "32015R0757", "6", None, None, None),
        ("Article 7(2) of Regulation (EU) 2015/757", "32015R0757", "7", "2", None, None),
        ("Article 8 of Regulation (EU) 2015/757", "32015R0757", "8", None, None, None),
    ]
    assert cites("Article 3, point (e), and Annex I") == [("Article 3, point (e)", None, "3", None, "e", None), ("Annex I", None, None, None, None, "I")]
    assert cites("the Annex to Council Directive 96/61/EC") == [("Annex to Council Directive 96/61/EC", "31996L0061", None, None, None, "")]
    assert cites("Article 5 of Regulation 1/2") == [] and cites("Article 20th") == [] and cites("") == []
    assert cites("Regulation (EC) No 765/2008 and Article 1") == [("Article 1", None, "1", None, None, None), ("Regulation (EC) No 765/2008", "32008R0765", None, None, None, None)]


def test_formulas():
    assert formulas.latex("<FORMULA><FRACTION><DIVIDEND>a<IND>i</IND><IND>j</IND></DIVIDEND><DIVISOR>2</DIVISOR></FRACTION><OP.CMP TYPE='EQ'/>α %</FORMULA>") == "\\frac{a_{ij}}{2} = \\alpha \\%"
    with pytest.raises(formulas.FormulaError):
        formulas.latex("<FORMULA><X/></FORMULA>")


def book(sheets):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
        z.writestr("xl/workbook.xml", f'<workbook {main} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets>' + "".join(f'<sheet name="{n}" r:id="r{i}"/>' for i, (n, _) in enumerate(sheets)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="r{i}" Target="worksheets/s{i}.xml"/>' for i in range(len(sheets))) + "</Relationships>")
        for i, (_, rows) in enumerate(sheets):
            z.writestr(f"xl/worksheets/s{i}.xml", f"<worksheet {main}><sheetData>" + "".join(f'<row r="{r}">' + "".join(f'<c r="{c}{r}" t="inlineStr"><is><t>{v}</t></is></c>' for c, v in cells.items()) + "</row>" for r, cells in rows.items()) + "</sheetData></worksheet>")
    return out.getvalue()


def test_workbooks(spark):
    old = {3: {"Y": "Total CO₂ emissions [m tonnes]"}, 4: {"A": "1234567", "B": "Good Ship", "Y": "12.5", "Z": "Division by zero!"}, 6: {"A": "7654321", "B": "Other", "Y": ""}}
    new = {3: {"AL": workbook.LAYOUTS[0][0]}, 4: {"A": "1", "I": "99", "J": "Carras (Hellas) S.A.", "AL": "3"}}
    rows = spark.createDataFrame([(2023, 1, None, bytearray(book([("2023 Full", old)]))), (2024, 2, None, bytearray(book([("Full ERs", new), ("Partial ERs", new)])))], "period int, version int, generated date, content binary")
    got = workbook.read_reports(rows).orderBy("period", "sheet", "imo").collect()
    assert [(r.period, r.sheet, r.imo, r.co2_total, r.co2_between_ms) for r in got][:3] == [(2023, "full", "1234567", 12.5, None), (2023, "full", "7654321", None, None), (2024, "full", "1", None, None)]
    assert got[0].ship_key == "good ship" and got[2].company_key == "carras hellas" and got[2].co2_ets == 3.0
    with pytest.raises(workbook.LayoutError):
        list(workbook.read_rows(book([("x", {3: {"A": "?"}})])))


def test_store(spark, tmp_path):
    keys = spark.createDataFrame([("a/b.html",), ("/a",), ("a/../b",), ("",), (None,), ("a//b",)], "k string")
    assert [r[0] for r in keys.select(store.valid_key(F.col("k"))).collect()] == [True, False, False, False, False, False]
    docs = spark.createDataFrame([("3", "0", "<p>x</p><SCRIPT>1</SCRIPT >")], "celex string, resolved_celex string, html string")
    got = store.addressed(docs).collect()[0]
    assert got.stored == "<p>x</p>" and got.key == f"3/0/{got.sha256}.html"
    with pytest.raises(Exception, match="empty document"):
        store.addressed(spark.createDataFrame([("3", "0", "<script></script>")], docs.schema)).collect()
    tries = spark.createDataFrame([("a", ["v2", "v1"]), ("b", []), ("c", ["x"])], "celex string, candidates array<string>")
    held = spark.createDataFrame([("v1",), ("b",)], "version string")
    assert {r.celex: r.version for r in store.serving_versions(tries, held).collect()} == {"a": "v1", "b": "b", "c": None}
    at = str(tmp_path / "p")
    store.swap_periods(spark.createDataFrame([(1, "a"), (2, "b")], "period int, x string"), at)
    store.swap_periods(spark.createDataFrame([(2, "c")], "period int, x string"), at)
    assert sorted((r.period, r.x) for r in spark.read.parquet(at).collect()) == [(1, "a"), (2, "c")]
    (tmp_path / "m.json").write_text('{"results": {"bindings": [{"c": {"value": "32015R0757"}, "force": {"value": "1"}, "title": {"value": "A b"}}]}}')
    row = feeds.discovery_rows(spark, str(tmp_path / "m.json")).collect()[0]
    assert (row.celex, row.in_force, row.title, row.consolidation) == ("32015R0757", True, "A b", None)


def test_corpus_guards(spark):
    acts = lambda *xs: spark.createDataFrame([(x,) for x in xs], "celex string")
    assert corpus.check_shrink(acts("a", "b"), acts("a", "b", "c", "d")) == 2
    with pytest.raises(corpus.CorpusError):
        corpus.check_shrink(acts("a"), acts("a", "b", "c", "d"))
    chunk = "celex string, content_hash string, occurrence int, metadata_hash string"
    stored = spark.createDataFrame([(1, "x", "h", 0, "m"), (2, "x", "g", 0, None)], "id long, " + chunk)
    assert {(r.content_hash, r.action) for r in corpus.reconcile(stored, spark.createDataFrame([("x", "g", 0, "m"), ("x", "n", 0, "m")], chunk)).collect()} == {("h", "delete"), ("g", "update"), ("n", "add")}
    with pytest.raises(Exception, match="no chunks"):
        corpus.reconcile_counts(stored, spark.createDataFrame([], chunk)).collect()
    assert corpus.next_version("2024-abc", "abc", "2025") == "2024-abc" and corpus.next_version(None, "abc", "2025") == "2025-abc"


def test_company_and_whole_words(spark):
    names = spark.createDataFrame([("Carras (Hellas) S.A.",), ("MSC Mediterranean",), ("AS",), ("Foo Pte. Ltd.",), ("",)], "n string")
    assert [r[0] for r in names.select(text.company_key("n")).collect()] == ["carras hellas", "msc mediterranean", "as", "foo", ""]
    keys = spark.createDataFrame([("msc mediterranean",), ("amsco",)], "k string")
    assert [r[0] for r in keys.select(text.holds_whole_words("k", F.lit("msc"))).collect()] == [True, False]


def test_figures_of_a_period_that_is_not_loaded(spark):
    from quern.plans.tables import reports

    r = reports(spark, "/root/testdata/sf0.001")
    assert figures.query_reports(r, figures.Question(2050)).count() == 0
    got = figures.query_reports(r, figures.Question(1995, "ship")).collect()
    assert len(got) == 1 and len(got[0].groups) == 10 and got[0].group_count > 10


def test_reading_order(spark):
    rows = [(i, "x", "5", p, None, 1, 1, i, []) for i, p in enumerate(["11a", "2", "11", None])]
    chunks = spark.createDataFrame(rows, "id long, celex string, article string, paragraph string, annex string, part int, parts int, position int, points array<string>")
    target = spark.createDataFrame([(1, "x", "5", None, None, None)], "target_id long, celex string, article string, paragraph string, point string, annex string")
    assert [r.id for r in context.follow_references(target, chunks).orderBy("place").collect()] == [3, 1, 2, 0]


def _sections(rng, n, depth=4):
    """Rows of a random document in reading order."""
    rows, stack = [], []
    for i in range(n):
        while stack and (len(stack) >= depth or rng.random() < 0.35):
            stack.pop()
        kind = rng.choice(["paragraph", "paragraph", "paragraph", "table", "heading", "article", "annex"])
        table = [[f"h{j}" for j in range(2)], *([str(rng.randrange(99)), "x" * rng.randrange(9)] for _ in range(rng.randrange(4)))] if kind == "table" else None
        rows.append({"node_id": i, "parent_id": stack[-1] if stack else None, "kind": kind, "number": rng.choice([None, None, str(i)]), "title": rng.choice([None, None, f"t{i}"]), "text": None if table else rng.choice(["", "a b. c d", "word; " * rng.randrange(12)]), "rows": table})
        if rng.random() < 0.5:
            stack.append(i)
    return rows


def test_chunks_of_a_pass_are_those_of_the_tree():
    rng = random.Random(3)
    for n in (*range(12), *(rng.randrange(80) for _ in range(400))):
        rows = _sections(rng, n)
        for most in (12, 40, 2000):
            assert list(chunking.walked(rows, most)) == list(chunking.chunks(chunking.tree(rows), most))
    with pytest.raises(ValueError, match="doesn't come after"):
        list(chunking.walked([{"node_id": 1, "parent_id": 7, "kind": "paragraph", "number": None, "title": None, "text": "x", "rows": None}]))


def test_a_long_document_passes_in_bounded_memory(spark):
    rng = random.Random(4)
    rows = _sections(rng, 100_000)
    want = sum(1 for _ in chunking.chunks(chunking.tree(rows), 60))
    tracemalloc.start()
    got = sum(1 for _ in chunking.walked(iter(rows), 60))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got == want and peak < 1_000_000
    some = rows[:3_000]
    table = spark.createDataFrame([(d, r["node_id"], r["parent_id"], 0, i, r["kind"], r["number"], r["title"], r["text"], r["rows"]) for d in (1, 2) for i, r in enumerate(some)], "doc_id long, node_id long, parent_id long, depth int, seq int, kind string, number string, title string, text string, rows array<array<string>>")
    made = chunking.chunk_documents(table.repartition(5), 2026, 60).select("doc_id", "position", "text").collect()
    for d in (1, 2):
        assert [r.text for r in sorted(made, key=lambda r: r.position) if r.doc_id == d] == [c["text"] for c in chunking.chunks(chunking.tree(some), 60)]


def test_neighbouring_leaves_are_packed():
    leaf = lambda t, **k: chunking.Section("paragraph", text=t, **k)
    packed = chunking.pack_leaves([leaf("aa"), leaf("bb"), leaf("c", number="1"), leaf("dd"), leaf("eeeee"), leaf("f")], 6)
    assert [s.plain for s in packed] == ["aa\nbb", "c", "dd", "eeeee", "f"]


def test_institutions_in_any_case():
    """Institution words lead into an act however they are written, and a division before them is the act's."""

    def cited(t):
        return [(r.raw.lower(), r.instrument, r.article, r.paragraph, r.point, r.annex) for r in references.extract(t, 2026)]

    text_ = "Article 7 of Council Implementing Regulation (EU) 2016/1927 and Annex I to Commission Delegated Directive 2003/87/EC"
    want = cited(text_)
    assert {r[1] for r in want} == {"32016R1927", "32003L0087"} and any(r[2] == "7" and r[1] == "32016R1927" for r in want)
    for other in (text_.replace("Council", "council"), text_.replace("Commission Delegated", "COMMISSION delegated"), text_.replace("Implementing", "implementing")):
        assert cited(other) == want
    assert any(r.raw == "council regulation (EU) 2015/757" for r in references.extract("as council regulation (EU) 2015/757 says", 2026))
