"""Operator 12: alignment of two tokenizers' tokens on the bytes of a text.

A (byte-level BPE of a tokenizers file) encodes space+text, B (a sentencepiece model, which adds the space itself) the text.
The ends of both sides' tokens, added up in bytes, are merged by two pointers inside `mapInPandas`: a place where both end
closes a group, and each stretch between two neighbouring places of the merged sequence lies in one token of A and one of B,
which is a link. The merge runs over numpy arrays: the places of the merged sequence, looked up in both, are the pointers.

Texts are cut into chunks where a character that is no white space meets a space or a newline. Neither side has a token over
such a place: A's pattern begins a match there and looks no further back, and B's model has no piece with a space or newline
behind another character (`Sides` checks its pieces). So tokens, groups and links of a text are those of its chunks in a row,
chunks that were seen before aren't encoded again, and memory follows a part of a text, but for the strings of its groups.

Spark adds up the links of each id pair over the corpus, finds the largest count of each id of either side, and joins both
back to the documents' pairs. Pairs are so uneven that some would fill a task: those with more than one in `most` of all links
are at most `most` pairs and are broadcast; the others meet their counts in a shuffle, in which no pair has more rows than that.
Texts are encoded once; their links lie in a table in the shared folder, each pair of a document once, in one number.

Edge cases: texts that are null, empty, or whose joined tokens of either side aren't the bytes of space+text (such as those
with U+2581) have no tokens: zeros, and no groups. Special tokens' strings are plain text. Rows that share an id, or have none,
are each aligned, for their own text. An empty table gives no rows. Other columns are left out.
"""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import Recent, checkpointed, kept, trimmed

#: The pattern that the byte-level side is split by: a fixed value.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: A chunk: white space and what follows up to a place that is safe for both sides; or white space that ends the text.
CHUNK = re.compile(r"\s+\S+(?:[^\S \n]\s*\S+)*(?:[^\S \n]\s*\Z)?|\s+")
SAFE = re.compile(r"(?<=\S)(?=[ \n])")
#: Characters of a part of a text; characters of chunks that are remembered.
PART, LONGEST = 1 << 16, 48
#: A link pair is A's id times 2^16 plus B's, and a document's link that pair times 2^32 plus how often the document has it.
SHIFT, TIMES = 16, 32
#: Pairs that are broadcast at most: 200,000 pairs of two long numbers and two flags.
MOST = 200_000


def byte_of() -> dict[str, int]:
    """Byte-level BPE writes printable bytes as themselves and the others as the characters from U+0100 on, in order."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Sides:
    """Both tokenizers, the bytes of their tokens, and the alignments of chunks that were seen."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        import tiktoken

        told = byte_of()
        with open(a_path, encoding="utf-8") as f:
            vocabulary = json.load(f)["model"]["vocab"]
        ranks = {bytes(map(told.__getitem__, token)): i for token, i in vocabulary.items()}
        self.a = tiktoken.Encoding(a_path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        pieces = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(map(self.b.id_to_piece, range(self.b.get_piece_size())))]
        for i, p in enumerate(pieces):
            if not self.b.is_byte(i) and p.strip(b" \n") and (b" " in p[1:].rstrip(b" \n") or b"\n" in p or p[1:].endswith(b" ")):
                raise ValueError(f"piece {i} of {b_path} reaches over a place where texts are cut")
        self.a_bytes, self.b_bytes = [b""] * (max(ranks.values()) + 1), pieces
        for token, i in ranks.items():
            self.a_bytes[i] = token
        self.a_size, self.b_size = (np.array([len(x) for x in side], dtype=np.int64) for side in (self.a_bytes, self.b_bytes))
        if len(self.a_bytes) > 1 << TIMES - SHIFT or len(pieces) > 1 << SHIFT:
            raise ValueError("a vocabulary has too many ids for the numbers of pairs")
        self.digits = _digits(max(len(self.a_bytes), len(pieces)))
        self.known = Recent(120_000)

    def tokens(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of both sides for a stretch of space+text that begins with white space."""
        a = self.a.encode_to_numpy(text, disallowed_special=()).astype(np.int64)
        if text[0] == " " and len(text) > 1:
            return a, np.array(self.b.encode(text[1:], num_threads=1), dtype=np.int64)
        # a letter before, behind which texts may be cut, stands for the space that the model adds
        return a, np.array(self.b.encode("a" + text, num_threads=1)[len(self.b.encode("a")) :], dtype=np.int64)

    def aligned(self, chunks: list[str]) -> list[tuple | None]:
        """For each chunk the number of its tokens (A, B), of its groups, their string and its links' pairs; None if its tokens' bytes aren't the chunk.

        Chunks that end with white space have to be encoded alone; all others in a row.
        """
        found: dict[str, tuple | None] = {}
        row = []
        for c in chunks:
            if "▁" in c:
                found[c] = None
            elif c[-1].isspace():
                found[c] = next(self._merged([c]))
            else:
                row.append(c)
        # a first chunk that begins with a space gives the model its own
        for c, one in zip(row, list(self._merged([" a", *row]))[1:] if row else (), strict=True):
            found[c] = one
        return [found[c] for c in chunks]

    def _merged(self, chunks: list[str]) -> Iterator[tuple | None]:
        text = "".join(chunks)
        a, b = self.tokens(text)
        raw = text.encode("utf-8", "surrogatepass")
        if b"".join(map(self.a_bytes.__getitem__, a.tolist())) != raw or b"".join(map(self.b_bytes.__getitem__, b.tolist())) != raw:
            for c in chunks:  # those that differ are found one by one
                yield None if len(chunks) == 1 else next(self._merged([c]))
            return
        a_end, b_end = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
        place = np.union1d(a_end, b_end)
        at_a, at_b = np.searchsorted(a_end, place), np.searchsorted(b_end, place)  # the pointers at each place
        pairs = (a[at_a] << SHIFT | b[at_b]).tobytes()
        closes = np.intersect1d(a_end, b_end, assume_unique=True)
        shown, upto = self._shown(a, b, np.searchsorted(a_end, closes) + 1, np.searchsorted(b_end, closes) + 1)
        ends = np.cumsum([len(c.encode("utf-8", "surrogatepass")) for c in chunks])
        n_a, n_b, n_p = (np.searchsorted(x, ends, side="right") for x in (a_end, b_end, place))
        first = np.diff(n_a, prepend=0).tolist()
        shown_at, pairs_at = upto[n_a + n_b].tolist(), (8 * n_p).tolist()
        for n, s0, s1, p0, p1 in zip(first, [0, *shown_at[:-1]], shown_at, [0, *pairs_at[:-1]], pairs_at, strict=True):
            yield n, shown[s0 : s1 - 1], pairs[p0:p1]

    def _shown(self, a: np.ndarray, b: np.ndarray, a_upto: np.ndarray, b_upto: np.ndarray) -> tuple[bytes, np.ndarray]:
        """All groups as `a1,a2|b1;a3|b2;` and the place behind each number of its ids; a_upto and b_upto have the number of ids up to each group's end."""
        out = np.zeros((len(a) + len(b), self.digits.shape[1]), dtype=np.uint8)
        for ids, upto, other, last in ((a, a_upto, np.concatenate([[0], b_upto[:-1]]), b"|"), (b, b_upto, a_upto, b";")):
            at = np.arange(len(ids)) + np.repeat(other, np.diff(upto, prepend=0))
            line = self.digits[ids]
            line[:, -1] = ord(",")
            line[upto - 1, -1] = last[0]
            out[at] = line
        some = out > 0
        return out[some].tobytes(), np.concatenate([[0], np.cumsum(some.sum(axis=1))])

    def text(self, text: str) -> tuple[int, int, int, int, str, np.ndarray] | None:
        """n_a, n_b, n_groups, n_links, the groups and the links' pairs of a text; None if it has no tokens."""
        if not text or "▁" in text:
            return None
        whole, start, n_a = " " + text, 0, 0
        shown, pairs = [], []
        while start < len(whole):
            cut = SAFE.search(whole, start + PART) if len(whole) - start > PART else None
            end = cut.start() if cut else len(whole)
            chunks = CHUNK.findall(whole[start:end])
            start = end
            rare = {c: None for c in chunks if len(c) > LONGEST}
            new = self.known.unknown(set(chunks).difference(rare))
            for at in range(0, len(new), 4096):
                some = new[at : at + 4096]
                self.known.hand.update(zip(some, (x or () for x in self.aligned(some)), strict=True))
            get = self.known.hand.__getitem__
            if rare:
                rare = dict(zip(rare, (x or () for x in self.aligned(list(rare))), strict=True))
                each = [rare[c] if len(c) > LONGEST else get(c) for c in chunks]
            else:
                each = list(map(get, chunks))
            if not all(each):
                return None
            firsts, groups, links = zip(*each, strict=True)
            n_a += sum(firsts)
            shown.append(b";".join(groups))
            pairs.append(b"".join(links))
        links = np.frombuffer(b"".join(pairs), dtype=np.int64)
        groups = b";".join(shown)
        n_groups = groups.count(b";") + 1
        return n_a, len(links) + n_groups - n_a, n_groups, len(links), groups.decode(), links


def _digits(n: int) -> np.ndarray:
    """The decimal digits of 0 to n-1, without zeros in front (0 stands for none), and a place for what follows."""
    width = len(str(n - 1))
    table = np.frombuffer("".join(f"{i:>{width}}\0" for i in range(n)).encode(), dtype=np.uint8).reshape(n, width + 1).copy()
    table[table == ord(" ")] = 0
    return table


@functools.lru_cache(maxsize=2)
def sides(a_path: str, b_path: str) -> Sides:
    """Both tokenizers, once per Python worker."""
    return Sides(a_path, b_path)


def align(docs: DataFrame, a_path: str, b_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_a, n_b, n_groups, n_links, groups (`a1,a2|b1;a3|b2,b3`: ids in order) and links (each pair of ids that tokens of the text link, once,
    with its times; `linked` takes them apart) of every text. One narrow pass."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        both = sides(a_path, b_path)
        none = np.zeros(0, np.int64)

        def aligned(text: str | None) -> tuple:
            if not isinstance(text, str) or not (found := both.text(text)):
                return 0, 0, 0, 0, "", none
            pairs, times = np.unique(found[5], return_counts=True)
            return *found[:5], pairs << TIMES | times

        for frame in frames:
            for at in range(0, len(frame), 64):
                some = frame.iloc[at : at + 64]
                rows = pd.DataFrame([aligned(t) for t in some["text"]], columns=["n_a", "n_b", "n_groups", "n_links", "groups", "links"])
                yield rows.assign(key=some["key"].to_numpy())[["key", *rows.columns]]
        both.known.clear()  # the worker lives on
        trimmed()

    # as a string: pandas has no nulls among whole numbers
    chosen = docs.select(F.col(key).cast("long").cast("string").alias("key"), F.col(text).cast("string").alias("text"))
    found = chosen.mapInPandas(run, "key string, n_a long, n_b long, n_groups long, n_links long, groups string, links array<long>")
    return found.withColumn("key", F.col("key").cast("long")).withColumnRenamed("key", key)


def linked(aligned: DataFrame, *columns: str) -> DataFrame:
    """The columns, pair and times of each pair that a row links."""
    each = aligned.select(*columns, F.explode("links").alias("link"))
    return each.select(*columns, F.shiftrightunsigned("link", TIMES).alias("pair"), F.col("link").bitwiseAND(F.lit((1 << TIMES) - 1)).alias("times"))


def counts(pairs: DataFrame) -> DataFrame:
    """pair, a, b, count, best_of_a, best_of_b (1 if no pair of its id of that side has more links, else 0) of all pairs with links.

    The largest counts are as many as a vocabulary has ids, so they can be broadcast.
    """
    each = checkpointed(pairs.groupBy("pair").agg(F.sum("times").alias("count")))
    each = each.withColumns({"a": F.shiftright("pair", SHIFT), "b": F.col("pair").bitwiseAND(F.lit((1 << SHIFT) - 1))})
    for side in ("a", "b"):
        top = each.groupBy(side).agg(F.max("count").alias(f"most_of_{side}"))
        each = each.join(F.broadcast(top), side)
    return each.select("pair", "a", "b", "count", *((F.col("count") == F.col(f"most_of_{s}")).cast("long").alias(f"best_of_{s}") for s in ("a", "b")))


def alignments(docs: DataFrame, a_path: str, b_path: str, key: str = "doc_id", text: str = "text", most: int = MOST) -> DataFrame:
    """key, n_a, n_b, n_groups, n_links, n_best (links whose pair has the largest count of its B id), n_best_a (of its A id), count_sum (of the pairs'
    counts over the links), groups_sha256 ('' without tokens) of every text."""
    sha = F.when(F.col("groups") != "", F.sha2("groups", 256)).otherwise("")
    numbered = align(docs, a_path, b_path, key, text).withColumn("groups_sha256", sha).drop("groups").withColumn("_own", F.monotonically_increasing_id())
    found = kept(numbered)  # rows get their numbers as they are written, once
    each = checkpointed(counts(linked(found)))
    total = each.agg(F.sum("count")).first()[0] or 0
    often = F.col("count") * most > total
    met = linked(found, "_own").join(F.broadcast(each.where(often)), "pair", "left")
    # rows of frequent pairs are summed by document at once; each other one keeps its pair, to meet its count in a shuffle
    rare = F.when(F.col("count").isNull(), F.col("pair")).otherwise(-1 - F.col("_own"))
    values = {"n_best": F.col("best_of_b"), "n_best_a": F.col("best_of_a"), "count_sum": F.col("count")}
    first = met.groupBy("_own", rare.alias("rare")).agg(*(F.sum(F.col("times") * v).alias(k) for k, v in values.items()), F.sum("times").alias("times"))
    joined = first.join(each.where(~often).withColumnRenamed("pair", "rare"), "rare", "left")
    told = joined.groupBy("_own").agg(*(F.sum(F.coalesce(k, F.col("times") * v, F.lit(0))).alias(k) for k, v in values.items()))
    numbers = found.select("_own", key, "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    return numbers.join(told, "_own", "left").select(key, "n_a", "n_b", "n_groups", "n_links", *(F.coalesce(x, F.lit(0)).alias(x) for x in values), "groups_sha256")
