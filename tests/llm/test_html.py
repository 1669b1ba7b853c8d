"""Main text of pages: the cut against all cuts of small graphs, pages marked by hand, edge cases."""

from __future__ import annotations

import itertools
import random

import numpy as np
import pyarrow.parquet as pq
import pytest

from quern.llm import html

LONG = "The history of the town is long and has many sides that are worth a few more words. "


def cost(side, lean, edges):
    own = sum(x if x > 0 and not s else -x if x < 0 and s else 0.0 for s, x in zip(side, lean, strict=True))
    return own + sum(w for a, b, w in edges if a != b and side[a] != side[b])


def test_the_cut_costs_no_more_than_any_other():
    rng = random.Random(4)
    for _ in range(200):
        n = rng.randint(1, 8)
        lean = [rng.choice([0.0, rng.uniform(-3, 3)]) for _ in range(n)]
        edges = [(rng.randrange(n), rng.randrange(n), rng.uniform(0, 2)) for _ in range(rng.randint(0, 14))]
        best = min(cost(s, lean, edges) for s in itertools.product((False, True), repeat=n))
        assert cost(html.cut(lean, edges), lean, edges) == pytest.approx(best, abs=1e-6)


PAGES = {
    "menus, footers, forms and scripts go": (
        f"<html><head><title>t</title><script>var a='<p>x</p>'</script></head><body><nav><a href=/>Home</a></nav><header><p>{LONG}</p></header><main><h1>Title</h1><p>{LONG}</p><ul><li>Sugar</li><li><a href=/s>Salt</a></li></ul>"
        f"<form><p>{LONG}</p></form></main><aside><p>{LONG * 4}</p></aside><footer>&copy; all of us</footer></body></html>",
        f"Title {LONG.strip()} Sugar Salt",
    ),
    "long comments in an article go": (f"<article><p>{LONG}</p><div class='comment-list'><p>{LONG * 20}</p><p>{LONG}</p></div><p>An end.</p></article>", f"{LONG.strip()} An end."),
    "hidden text and adverts in a line go": ("<article><p>Hel<span hidden>x<span>y</span>z</span>lo <ins class='adsbygoogle'>Buy <b>now</b></ins>world, <i style='display: none'>SECRET</i>fine.</p></article>", "Hello world, fine."),
    "hidden blocks go": (f"<article><p>{LONG}</p><div style='display:none'><p>{LONG}</p></div><p aria-hidden=true>{LONG}</p></article>", LONG.strip()),
    "a telling word in a longer name is a hint alone": (f"<div id='content' class='social-history'><p>{LONG}</p><p>{LONG}</p></div>", f"{LONG}{LONG}".strip()),
    "names with a negation say nothing": (f"<div class='has-sidebar'><p>{LONG}</p></div><div class='sidebar'><p>{LONG}</p></div>", LONG.strip()),
    "plain pages go by how they look": (f"<div><h2>Title</h2><p>{LONG * 3}</p><p>Short one.</p></div><div><a href=a>Home</a> <a href=b>About</a></div>", f"Title {(LONG * 3).strip()} Short one."),
    "notices beside the article go": (f"<div class='cookie-notice'><p>{LONG * 3}</p></div><article><p>{LONG}</p></article><p>{LONG}</p>", LONG.strip()),
    "adverts within an article go": (f"<article><p>{LONG}</p><div class=ad>{LONG * 5}</div><p>{LONG}</p></article>", f"{LONG}{LONG}".strip()),
    "references and white space": (f"<article><p>a &amp; b&nbsp;c&#33;\n\t{LONG}</p></article>", f"a & b c! {LONG}".strip()),
    "null": (None, ""),
    "empty": ("", ""),
    "no text": ("<div><p></p></div>", ""),
    "a comment without end": (f"<article><p>{LONG}</p><!-- never", LONG.strip()),
    "unclosed paragraphs": (f"<article><p>{LONG}<p>{LONG}</article>", f"{LONG}{LONG}".strip()),
}


@pytest.mark.parametrize("name", PAGES)
def test_marked_pages(name):
    page, text = PAGES[name]
    assert html.extract(page) == text


def test_real_pages_reach_the_cut_and_keep_their_articles():
    pages = pq.read_table("/root/testdata/sf0.01/pages.parquet").to_pylist()
    changed = blocks = 0
    for p in pages:
        labels = html.labelled(p["html"], html.Weights())
        blocks += len(labels)
        changed += sum(content != own for _, content, own in labels)
        article = p["html"].partition("<article>")[2].partition("</article>")[0]
        assert " ".join(b for b, content, _ in labels if content) == " ".join(" ".join(b.split()) for b, _, _ in html.labelled(f"<article>{article}</article>", html.Weights()))
    assert changed > 0.03 * blocks


def test_fitted_weights_follow_what_is_taught():
    rng = np.random.default_rng(1)
    y = (rng.random(4000) < 0.3).astype(float)
    x = np.stack([np.ones(4000), rng.random(4000) * 2 + y, rng.random(4000) * (1 - y), y * (rng.random(4000) < 0.8), np.zeros(4000), np.zeros(4000)], axis=1)
    w = html.fitted(x, y, html.Weights())
    assert w.words > 0 and w.links < 0 and w.sentence > 0.8
    assert w.rights == pytest.approx(html.Weights().rights)  # nothing seen: as given
    assert html.fitted(x[:20], y[:20], html.Weights()) == html.Weights()


def test_tables_of_any_kind(spark):
    page = f"<nav>menu</nav><article><p>{LONG}</p></article>"
    rows = [(1, "u", page, "x"), (1, "u", page, "x"), (None, None, page, None), (2, "v", None, "y")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    found = sorted(map(tuple, html.extract_pages(df).collect()), key=str)
    assert found == sorted([(1, "u", LONG.strip()), (1, "u", LONG.strip()), (None, None, LONG.strip()), (2, "v", "")], key=str)
    assert html.extract_pages(df.limit(0)).collect() == []
    taught = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    w = html.fit(taught)
    assert w != html.Weights() and w == html.fit(taught.repartition(5))
