"""Phrases against plain counting of every run, with many rounds, shards and parts."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quern.llm import collocations as c

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def pieces(text):
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER))]


def plain_counts(docs):
    found = Counter()
    for _, text, lang in docs:
        for w in pieces(text):
            for m in range(1, 5):
                found.update((lang or "und", tuple(w[i : i + m])) for i in range(len(w) - m + 1))
    return found


def plain(docs, least, top):
    f = plain_counts(docs)
    n = Counter()
    for (lang, p), k in f.items():
        n[lang] += k * (len(p) == 1)
    long = {x: k for x, k in f.items() if len(x[1]) > 1 and k >= least}
    rows = []
    for (lang, p), a in long.items():
        if any(100 * b >= 80 * a for (g, q), b in long.items() if g == lang and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))):
            continue
        score, k = min((2_000_000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k) for k in range(1, len(p)))
        rows.append((lang, " ".join(p), a, f[lang, p[:k]], f[lang, p[k:]], n[lang], score))
    out = []
    for lang in {r[0] for r in rows}:
        best = sorted((r for r in rows if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))[:top]
        out += [(lang, i + 1, *r[1:]) for i, r in enumerate(best)]
    return sorted(out)


def corpus(seed, n):
    rng = random.Random(seed)
    words = ["a", "b", "Ab", "aB", "the", "cat", "é", "É", "漢字", "x-y", "\x1c", "\x85", "\xa0", "0"]
    marks = [" "] * 14 + ["\t", "  ", ". ", ",", "\n", "\r\n", "\x0b", "; ", "!?"]
    return [(rng.choice([i, 7, None]), rng.choice([None, "", *["".join(rng.choice(words) + rng.choice(marks) for _ in range(rng.randint(1, 60)))] * 12]), rng.choice(["en", "en", "de", None, "und"])) for i in range(n)]


@pytest.mark.parametrize("sizes", [{}, {"cell_bytes": 1, "round_bits": 16, "shard_chars": 300}, {"cell_bytes": 10_000_000}])
def test_phrases_against_plain_counting(spark, sizes):
    """Also with several rounds of cells and many shards, and with a sketch that lets nearly all through."""
    docs = corpus(1, 1500) + [(1, "Every word of this line is here often " * 40 + "end", "fr")]
    table = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, lang string, n int, phrase string")
    for least, top in ((30, 2000), (9, 12)):
        got = c.phrases(table.repartition(3), least=least, top=top, **sizes).collect()
        assert sorted(map(tuple, got)) == plain(docs, least, top)
        assert len(got) > 20


def test_texts_are_read_as_often_however_many_candidates(spark):
    """Bounds of an automaton don't make for more passes over the texts: those would grow with the corpus and its phrases alike."""
    docs = corpus(3, 600)
    table = spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(2)
    read = {}
    for chars in (c.SHARD_CHARS, 300):
        rows = spark.sparkContext.accumulator(0)

        def seen(batches, rows=rows):
            for batch in batches:
                rows.add(batch.num_rows)
                yield batch

        got = c.phrases(table.mapInArrow(seen, table.schema), least=20, shard_chars=chars).collect()
        assert sorted(map(tuple, got)) == plain(docs, 20, 2000)
        read[chars] = rows.value
    assert read[300] == read[c.SHARD_CHARS] <= 3 * len(docs)


def test_a_language_and_a_word_of_one_name(spark):
    """`en` in German and `de` in English have hashes of their own."""
    docs = [(1, "de x. " * 40 + "en", "en"), (2, "en y. " * 50 + "de", "de")]
    table = spark.createDataFrame(docs, "doc_id long, text string, lang string").coalesce(1)
    assert sorted(map(tuple, c.phrases(table).collect())) == plain(docs, 30, 2000)
    hasher = c.Hasher()
    assert hasher.runs([b"de"], "en")[0][0] != hasher.runs([b"en"], "de")[0][0]


def test_long_texts_and_empty_tables(spark):
    """One piece of 200,000 words is worked through in parts; runs over their ends count once."""
    rng = random.Random(2)
    text = " ".join(rng.choice("abcd") for _ in range(200_000))
    docs = [(1, text, "en"), (2, "a b. " * 20 + "q" * 100_000, "en")]
    table = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    assert sorted(map(tuple, c.phrases(table, least=600).collect())) == plain(docs, 600, 2000)
    assert c.phrases(table.limit(0)).count() == 0
    assert c.phrases(table, least=10**9).count() == 0


def test_products_pass_64_bits(spark):
    big = 4_000_000_000_000_000_000
    found = spark.createDataFrame([("en", "a", big), ("en", "b", big + 7), ("en", "a b", big - 3), ("en", "a b c", big - 5), ("en", "b c", big - 4), ("en", "c", big)], "lang string, phrase string, f long")
    got = {r.phrase: (r.a, r.l, r.r, r.score) for r in c.scored(found).collect()}
    assert got["a b"] == (big - 3, big, big + 7, 2_000_000 * (big - 3) // (2 * big + 7))
    assert got["a b c"] == (big - 5, big, big - 4, 2_000_000 * (big - 5) // (2 * big - 4))
    assert {r.phrase for r in c.inside(found).collect()} == {"a b", "b c"}


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("ab .\n"), max_size=80), st.integers(4, 12))
def test_parts_hold_every_run_once(text, size):
    hasher, words = c.Hasher(), c.text_words(text)
    whole = Counter(np.concatenate([r[r > 0] for r in hasher.runs(words, "en")]).tolist()) if words else Counter()
    apart = Counter()
    for part, over in c.parts(words, size):
        for r in c._own(hasher.runs(part, "en"), over) if part else ():
            apart.update(r[r > 0].tolist())
    assert apart == whole
    want = plain_counts([(1, text, "en")])
    assert sorted(whole.values()) == sorted(want.values())
