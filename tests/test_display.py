from pyspark.sql import functions as F

from quern.functions import display as d
from quern.functions import normal


def test_questions():
    assert normal.question_text("  Ｗhat   IS it ?! ") == "what is it" and normal.question_text("Straße") == "strasse" and normal.question_text("?") == ""


def test_citations():
    assert d.segments("claim [1]. x [9].", {1, 2}) == [("text", "claim."), ("marker", "1"), ("text", " x [9].")]
    assert d.segments("claim [1][2]. x [9].", {1, 2}) == [("text", "claim. x [9].")]
    assert d.segments("claim [1][9]. y", {1}) == [("text", "claim "), ("marker", "1"), ("text", "[9]. y")]
    assert d.renumbered("a [1][2] b [1]", {1, 2}) == "a b [1]" and d.renumbered("a [2] b [1][5]: `x", {1, 2}) == "a [1] b [2][5]: `x"
    answer = "x [7] and `[3]` then [12], [7].\n```\n[5]\n```\n$[4]$ [2]"
    assert d.cited(answer, {7, 12, 3, 5, 2}) == {7: 1, 12: 2, 2: 3}
    assert d.renumbered(answer, {7, 12, 2}) == "x [1] and `[3]` then [2], [1].\n```\n[5]\n```\n$[4]$ [3]"
    assert d.segments("a [1]. b", {1}) == [("text", "a."), ("marker", "1"), ("text", " b")]
    for text in (answer, "``` a\n[1]\n  ````\n[2] `open\n~~~\n`[3]`\n", "`a``b`` $1 $x$ \\$5", "[1].", ""):
        assert "".join(s.text + s.stop for s in d.spans(text)) == text
    assert [s.numbers for s in d.spans("~~~\n[1]\n```\n~~~\n[2]") if s.kind == "cited"] == [(2,)]


def test_formulas_and_amounts():
    assert d.formula_segments("a\n$$x$$\nb $$y$$ c") == [("text", "a"), ("block", "x"), ("text", "b "), ("formula", "y"), ("text", " c")]
    assert d.formula_segments("$$x$$") == [("block", "x")]
    assert d.open_formula_held("a $$x$$ and $$y") == "a $$x$$ and " and d.open_formula_held("a $$x$$") == "a $$x$$"
    assert d.amounts_escaped("$5 and `$6` and $x$") == "\\$5 and `$6` and $x$"


def test_columns(spark):
    rows = spark.createDataFrame([("x [3] [1]", [1, 3], "retrieve", "running", 999.4), (None, None, "odd", "completed", 1250.0)], "a string, m array<int>, s string, t string, ms double")
    got = rows.select(d.renumbered_column(F.col("a"), F.col("m")), d.step_label(F.col("s"), F.col("t")), d.short_ms(F.col("ms"))).collect()
    assert [tuple(r) for r in got] == [("x [1] [2]", "Searching the corpus", "999ms"), (None, "odd", "1.3s")]
