"""Alignments against the two libraries on whole texts and a plain two-pointer merge, token by token."""

import hashlib
from collections import Counter

import public_tokenizers as P
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quern.llm import align

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
TEXT = st.text(st.sampled_from("  \n\n\t\r\x0b\x1c\x85\xa0　 aAbé߀ΣİÅ's'1२漢🙂#$-_.,▁;) ") | st.characters(codec="utf-8"), max_size=60)
PLAIN_A = Tokenizer.from_file(A)
PLAIN_A.encode_special_tokens = True
PLAIN_B = sentencepiece.SentencePieceProcessor(model_file=B)
TOLD = align.byte_of()


def plain(text):
    """Groups and links of a text by the contract's words; None without tokens."""
    if not text:
        return None
    a = [(i, bytes(TOLD[c] for c in PLAIN_A.id_to_token(i))) for i in PLAIN_A.encode(" " + text, add_special_tokens=False).ids]
    b = [(i, bytes([int(p[3:5], 16)]) if PLAIN_B.is_byte(i) else p.replace("▁", " ").encode()) for i, p in ((i, PLAIN_B.id_to_piece(i)) for i in PLAIN_B.encode(text))]
    whole = (" " + text).encode()
    if b"".join(x for _, x in a) != whole or b"".join(x for _, x in b) != whole:
        return None
    groups, links, i, j = [([], [])], [], 0, 0
    a_end, b_end = len(a[0][1]), len(b[0][1])
    groups[-1][0].append(a[0][0]), groups[-1][1].append(b[0][0])
    while True:
        links.append((a[i][0], b[j][0]))
        if a_end == b_end:
            i, j = i + 1, j + 1
            if i == len(a):
                break
            groups.append(([a[i][0]], [b[j][0]]))
            a_end, b_end = a_end + len(a[i][1]), b_end + len(b[j][1])
        elif a_end < b_end:
            i += 1
            a_end += len(a[i][1])
            groups[-1][0].append(a[i][0])
        else:
            j += 1
            b_end += len(b[j][1])
            groups[-1][1].append(b[j][0])
    shown = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
    return len(a), len(b), len(groups), len(links), shown, links


def agree(text):
    got, want = align.sides(A, B).text(text), plain(text)
    if want is None:
        assert got is None, repr(text)
    else:
        assert got[:5] == want[:5], repr(text)
        assert got[5].tolist() == [x << align.SHIFT | y for x, y in want[5]]


@settings(max_examples=800, deadline=None)
@given(TEXT)
def test_texts_align_as_the_libraries_say(text):
    agree(text)


def test_long_and_odd_texts(monkeypatch):
    for text in ("<|endoftext|> <s> </s> <unk>", " ", "\n", "  \n ", "a \r", "a\t", " a", "▁", "a▁b", "x" * 3000, "word one.\ntwo\r\n three " * 300, "𐀀퟿" * 90, "<0x41> <0x0A>", "0 0,0;0|0"):
        agree(text)
    monkeypatch.setattr(align, "PART", 20)
    for text in ("word one.\ntwo\r\n three  four\n\n five\t six " * 40 + " \r\n", "a " * 200, "nothing-to-cut-here" * 30):
        agree(text)


def test_documents_and_counts(spark):
    texts = [(1, "the cat sat on the mat"), (1, "the cat sat on the mat"), (2, None), (3, ""), (None, "the cats, the mats"), (None, "▁"), (5, "Ünïcödé wörds of théirs"), (6, "the " * 500), (-7, "the cat sat on the mat\n" * 3), ((1 << 62) + 1, "xyzzy plugh")]
    docs = spark.createDataFrame([(*t, "extra", 5) for t in texts], "doc_id long, text string, links string, _own int")
    found = [plain(t) for _, t in texts]
    count = Counter(p for f in found if f for p in f[5])
    top = Counter()
    for (_, b), n in count.items():
        top[b] = max(top[b], n)
    want = [(k, *f[:4], sum(count[p] == top[p[1]] for p in f[5]), sum(count[p] for p in f[5]), hashlib.sha256(f[4].encode()).hexdigest()) if f else (k, 0, 0, 0, 0, 0, 0, "") for (k, _), f in zip(texts, found, strict=True)]
    for most in (200_000, 8, 1):  # all pairs broadcast, some, next to none
        got = align.alignments(docs.repartition(3), A, B, most=most).drop("n_best_a")
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr), most
    assert align.alignments(docs.limit(0), A, B).count() == 0
    groups = {r.doc_id: r.groups for r in align.align(docs.where("doc_id > 3"), A, B).collect()}
    assert groups == {k: f[4] for (k, _), f in zip(texts, found, strict=True) if k and k > 3}
    both = align.counts(align.linked(align.align(docs, A, B))).collect()
    assert {(r.a, r.b): r["count"] for r in both} == count
    best = {r.b for r in both if r.best_of_b}
    assert best == {b for _, b in count} and all((r["count"] == top[r.b]) == bool(r.best_of_b) for r in both)


def test_rare_pairs_do_not_meet_one_task(spark):
    """What is broadcast is bounded by its share of all links."""
    docs = spark.createDataFrame([(i, f"w{i} the x{i % 7}") for i in range(200)], "doc_id long, text string")
    each = align.counts(align.linked(align.align(docs, A, B)))
    total = each.agg(F.sum("count")).first()[0]
    assert each.where(F.col("count") * 10 > total).count() <= 10
