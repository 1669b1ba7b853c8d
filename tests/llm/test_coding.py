"""Byte-level BPE and packing: the libraries on whole texts are the brute-force versions, with round trips."""

import zlib

import numpy as np
import public_tokenizers as P
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quern.llm import bpe, packing

RANKS, WORD_BPE = P.path("byte_bpe_multi_50k.tiktoken"), P.path("word_bpe_49k.json")
TEXT = st.text(st.sampled_from(" \t\n\r\x0b\x1c\x85\xa0 aAbé߀ΣİÅ's'1२漢🙂#$-_.,") | st.characters(codec="utf-8"), max_size=60)


@settings(max_examples=400, deadline=None)
@given(TEXT, st.integers(1, 20))
def test_safe_parts_encode_alike(text, size):
    whole = bpe.encoding(RANKS, P.PATTERN).encode_ordinary(text)
    parts = list(bpe.parts(text, size))
    assert "".join(parts) == text
    assert bpe.encode_text(text, RANKS, P.PATTERN, size).tolist() == whole
    assert bpe.encoding(RANKS, P.PATTERN).decode_bytes(whole) == text.encode()


def test_bpe_rows(spark):
    rows = [(1, None), (2, ""), (3, "a <|endoftext|> b"), (4, "x y\n" * 60_000), (4, "x"), (5, "z" * 3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    back = bpe.decode(bpe.encode(docs, RANKS, P.PATTERN), RANKS, P.PATTERN).collect()
    assert sorted((r.doc_id, bytes(r.decoded).decode()) for r in back) == sorted((k, t or "") for k, t in rows)
    assert {len(r.tokens) for r in back if r.doc_id in (1, 2)} == {0}
    assert bpe.encode(docs.limit(0), RANKS, P.PATTERN).count() == 0


@settings(max_examples=400, deadline=None)
@given(st.lists(TEXT | st.none(), max_size=6))
def test_chunk_tables_give_the_librarys_ids(texts):
    plain = Tokenizer.from_file(WORD_BPE)
    plain.encode_special_tokens = True
    got = [np.frombuffer(x, dtype="<u4").tolist() for x in packing.chunks(WORD_BPE).ids(texts)]
    assert got == [plain.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_every_id_lies_in_one_piece(spark):
    rows = [(1, None), (2, ""), (3, "a b c " * 3000), (4, "x"), (4, "x"), (5, "The quick brown fox, jumps! " * 40), *((10 + i, "word " * (i % 37 * 11)) for i in range(300))]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, length int")
    pieces = packing.pack(docs.repartition(3), WORD_BPE, size=128).collect()
    plain = Tokenizer.from_file(WORD_BPE)
    want = sorted((k, np.array([*plain.encode(t or "", add_special_tokens=False).ids, 1], dtype="<u4").tobytes()) for k, t in rows)
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_sequence.setdefault(p.sequence_id, []).append(p)
    for k, ids in want:
        if k != 4:
            assert b"".join(bytes(p.ids) for p in sorted(by_doc[k], key=lambda p: p.start)) == ids
        assert all(p.doc_tokens * 4 == len(ids) for p in by_doc[k])
    assert sum(len(p.ids) for p in by_doc[4]) == 2 * sum(len(i) for k, i in want if k == 4) // 2
    for ps in by_sequence.values():
        at = 0
        for p in sorted(ps, key=lambda p: p.offset):
            assert p.offset == at and len(p.ids) == 4 * p.length and zlib.crc32(p.ids) >= 0
            at += p.length
        assert at <= 128
    padding = sum(128 - sum(p.length for p in ps) for ps in by_sequence.values())
    assert padding < 3 * 128
    assert packing.pack(docs.limit(0), WORD_BPE).count() == 0


def test_places_where_the_sum_of_squares_grows_least():
    """Each choice against a plain search over all levels."""
    rng = np.random.default_rng(3)
    packer, size = packing.Packer(32), 32
    for n in rng.integers(1, 33, 2000).tolist():
        before = packer.level.copy()
        packer.place((0, 0, b"", 0), n)
        change = int((packer.level.astype(int) ** 2).sum() - (before.astype(int) ** 2).sum())
        best = None
        for f in [0, *np.flatnonzero(before).tolist()]:
            if f + n <= size:
                after = before.copy()
                after[f] -= f > 0
                after[f + n] += f + n < size
                c = int((after.astype(int) ** 2).sum() - (before.astype(int) ** 2).sum())
                best = c if best is None else min(best, c)
        assert change == best


def test_open_windows_are_kept_as_placed():
    """A partition of a thousand documents: little padding, few documents cut that a window could hold whole."""
    rng = np.random.default_rng(6)
    for count in (0, 1, 2, 1000):
        sizes = np.minimum(rng.lognormal(5.5, 1.2, count).astype(int) + 1, 9000).tolist()
        docs = [(k, np.arange(n, dtype="<u4").tobytes()) for k, n in enumerate(sizes)]
        pieces = list(packing.pack_ids(docs, 2048, 7))
        got, fill, cut = {}, {}, set()
        for doc, start, length, ids, total, sequence, offset in pieces:
            assert length * 4 == len(ids) and total == sizes[doc] and offset == fill.get(sequence, 0)
            fill[sequence] = offset + length
            got.setdefault(doc, []).append((start, ids))
        assert all(b"".join(x for _, x in sorted(got[k])) == ids for k, ids in docs) and len(got) == count
        assert all(f <= 2048 for f in fill.values()) and sorted(fill) == list(range(7, 7 + len(fill)))
        assert sum(f < 2048 - 20 for f in fill.values()) <= 1
        cut = sum(len(got[k]) > -(-n // 2048) for k, n in enumerate(sizes))
        assert cut <= 0.06 * count
