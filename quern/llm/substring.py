"""Operator 4: passages that repeat across documents, by collinear chaining of shared k-mers.

Seeds are k-mers of words, thinned to the least hash of every window, so that any shared run of window + k - 1 words shares
one. Each seed's first document (least id) is its source, and every other occurrence is joined to that one: as many matches
as occurrences, however many documents share a passage. Where the first documents show no passage though the seeds lie as
close as in one, the document before that has the seed left over too, and those before that have it with its neighbours, are
tried: parts of a passage may have been seen first in different documents, none of which holds enough of it. Matches of a document with one source are merged along diagonals and
chained in order of both texts by a Fenwick tree of prefix maxima, with a cost for each word of a gap. Chains are then
aligned on the words themselves, fetched in blocks of word hashes: anchors word by word, gaps from both ends, and past both
ends along the diagonal. Stretches of an alignment with enough words and enough of them equal are the passages; so edits
within a passage don't hide it, and what lies between two passages doesn't join them.

A seed that a third of all documents hold is reduced before the shuffle and joined to a single row, which adaptive joins
split; no row is dealt by a source alone. A document's matches are as many as its own seeds.

Edge cases: null and empty texts, and texts shorter than a k-mer, have no seeds; rows with a null id take no part; rows that
share an id count as one document, with the words of one of them; of equal texts all but the first are passages of the
first; extra columns are left out of the result, and `remove` keeps them.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import Recent, byte_words, checkpointed, emitted, rows, stored, trimmed
from quern.llm.tiles import runs

K, WINDOW, LEAST_WORDS, SIMILARITY = 5, 12, 50, 0.8
#: Cost of a word of a gap, in matched words.
GAP = 0.05
#: Words fetched beyond a chain's ends, and words in a fetched block.
BEYOND, BLOCK = 64, 256
#: Words of a passage that may lie before its first seed, and after its last, when further holders of its seeds are tried.
REACH = 8
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
#: Odd multipliers that tell the places of a k-mer apart.
_PLACES = np.array([xxhash.xxh64_intdigest(f"place {i}") | 1 for i in range(16)], dtype=np.uint64)


class Hashes:
    """XXH64 of lower-cased words, each distinct word once."""

    def __init__(self):
        self.known = Recent()

    def __call__(self, text: str) -> np.ndarray:
        ws = byte_words(text)
        new = self.known.unknown(set(ws))
        known = self.known.hand
        for w in new:
            known[w] = xxhash.xxh64_intdigest(w.translate(_LOWER))
        return np.fromiter(map(known.__getitem__, ws), dtype=np.uint64, count=len(ws))


@functools.cache
def hashes() -> Hashes:
    return Hashes()


def minimizers(words: np.ndarray, k: int = K, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and places of the k-mers with the least hash of some window (of all, if there are fewer than a window)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = np.zeros(n, dtype=np.uint64)
    for i in range(k):
        h += words[i : i + n] * _PLACES[i]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    if n <= window:
        at = np.array([int(h.argmin())])
    else:
        parts = []
        for start in range(0, n - window + 1, 1 << 16):  # bounded memory for very long texts
            view = np.lib.stride_tricks.sliding_window_view(h[start : start + (1 << 16) + window - 1], window)
            parts.append(np.unique(view.argmin(axis=1) + np.arange(start, start + len(view))))
        at = np.unique(np.concatenate(parts))
    return h[at], at


def seeds(docs: DataFrame, key: str, text: str, k: int = K, window: int = WINDOW) -> DataFrame:
    """h, doc, pos of every document's seeds."""
    out = pa.schema([("h", pa.int64()), ("doc", pa.int64()), ("pos", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for doc, t in rows(batches, "key", "text"):
            h, at = minimizers(hashes()(t or ""), k, window)
            if len(h):
                held.append((h.view(np.int64), np.full(len(h), doc), at.astype(np.int32)))
                size += len(h)
            if size > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held, strict=True)], schema=out)
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held, strict=True)], schema=out)
        hashes().known.clear()  # the worker lives on
        trimmed()

    chosen = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).where("key is not null")
    return chosen.mapInArrow(run, "h long, doc long, pos int")


#: Matches that a task joins, chains or looks through, and chains that it aligns.
MATCHES, CHAINS = 200_000, 5_000


def matches(found: DataFrame) -> DataFrame:
    """h, doc, source, x, y: every seed occurrence outside its first document, with the first one's place."""
    firsts = found.groupBy("h").agg(F.min(F.struct("doc", "pos")).alias("first"), F.max("doc").alias("last")).where("last > first.doc")
    # kept apart, so that the join below shuffles both sides itself and can split a seed that many documents hold
    firsts = checkpointed(firsts.select("h", F.col("first.doc").alias("source"), F.col("first.pos").alias("y")), found.count(), MATCHES)
    return found.join(firsts, "h").where("doc > source").select("h", "doc", "source", F.col("pos").alias("x"), "y")


def unexplained(matched: DataFrame, told: DataFrame, key: str, k: int = K, least: int = LEAST_WORDS, reach: int = REACH) -> DataFrame:
    """key, doc, x, until: matched seeds outside the passages of `told`, in runs of a document's matched seeds that a passage
    fits; by themselves and as rows of three and five, from the first one's place to the last one's.

    Two seeds further apart than `least` words end a run; a run ends at most `reach` words inside a passage.
    """
    out = pa.schema([("key", pa.int64()), ("doc", pa.int64()), ("x", pa.int32()), ("until", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (doc,), part in runs(batches, ["doc"]):
            h, x, end = (part.column(c).to_numpy() for c in ("h", "x", "end"))
            spans, seed = end >= 0, end < 0
            h, at = h[seed], x[seed]
            if not len(at):
                continue
            begin = np.flatnonzero(np.append(True, np.diff(at) > least))
            last = np.append(begin[1:], len(at)) - 1
            wide = np.repeat(at[last] - at[begin] + k >= least - 2 * reach, last - begin + 1)
            # a seed is explained if some passage holds all of it: the furthest end among those that begin before it
            ends = np.maximum.accumulate(np.append(-1, end[spans]))[np.searchsorted(x[spans], at, side="right")]
            left = wide & (ends < at + k)
            h, at = h[left].view(np.uint64), at[left].astype(np.int32)
            for n in (1, 3, 5):
                if (size := len(h) - n + 1) > 0:
                    row = sum(h[i : i + size] * _PLACES[i] for i in range(n))
                    yield pa.RecordBatch.from_arrays([pa.array(row.view(np.int64)), pa.array(np.full(size, doc)), pa.array(at[:size]), pa.array(at[n - 1 :])], schema=out)

    seen = matched.select("h", "doc", F.col("x").cast("int").alias("x"), F.lit(-1).alias("end"))
    spans = told.select(F.lit(0).cast("long").alias("h"), F.col(key).alias("doc"), F.col("start").cast("int").alias("x"), F.col("end").cast("int").alias("end"))
    return seen.unionByName(spans).repartition("doc").sortWithinPartitions("doc", "x").mapInArrow(run, "key long, doc long, x int, until int")


def further(left: DataFrame) -> DataFrame:
    """doc, source, x, y: both ends of each seed or row of seeds with their places in the document before that has it too."""
    each = left.groupBy("key", "doc").agg(F.min(F.struct("x", "until")).alias("own"))
    before = F.lag(F.struct("doc", "own")).over(Window.partitionBy("key").orderBy("doc"))
    linked = each.withColumn("before", before).where("before is not null")
    ends = F.explode(F.array(*(F.struct(F.col(f"own.{c}").alias("x"), F.col(f"before.own.{c}").alias("y")) for c in ("x", "until"))))
    return linked.select("doc", F.col("before.doc").alias("source"), ends.alias("end")).select("doc", "source", "end.*").distinct()


class PrefixMax:
    """Fenwick tree: the greatest value, with its number, among places up to one."""

    def __init__(self, n: int):
        self.best: list[tuple[float, int]] = [(float("-inf"), -1)] * (n + 1)

    def put(self, place: int, value: float, number: int) -> None:
        i, new, best = place + 1, (value, number), self.best
        while i < len(best):
            if best[i] < new:
                best[i] = new
            i += i & -i

    def upto(self, place: int) -> tuple[float, int]:
        """Over places before `place`."""
        i, found, best = place, (float("-inf"), -1), self.best
        while i > 0:
            if best[i] > found:
                found = best[i]
            i -= i & -i
        return found


def anchors(x: np.ndarray, y: np.ndarray, k: int = K, window: int = WINDOW) -> np.ndarray:
    """Runs (x, y, length) of matches, sorted by x, that follow each other on one diagonal within a window."""
    if not len(x):
        return np.zeros((0, 3), dtype=np.int64)
    new = np.ones(len(x), dtype=bool)
    new[1:] = (np.diff(y - x) != 0) | (np.diff(x) > window + k)
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], len(x)) - 1
    return np.stack([x[begin], y[begin], x[end] - x[begin] + k], axis=1)


def chains(runs_: np.ndarray, gap: float = GAP) -> list[np.ndarray]:
    """Anchors in disjoint chains, ascending in both texts, best chains first."""
    n = len(runs_)
    if n == 1:
        return [runs_]
    x0, y0, size = (runs_[:, i].tolist() for i in range(3))
    x1, y1 = [a + s for a, s in zip(x0, size, strict=True)], [a + s for a, s in zip(y0, size, strict=True)]
    places = sorted(set(y1))
    rank = {v: i for i, v in enumerate(places)}
    below = np.searchsorted(places, y0, side="right").tolist()
    tree, score, before = PrefixMax(len(places)), [0.0] * n, [-1] * n
    by_end = sorted(range(n), key=x1.__getitem__)
    done = 0
    for i in sorted(range(n), key=x0.__getitem__):
        while done < n and x1[by_end[done]] <= x0[i]:
            j = by_end[done]
            tree.put(rank[y1[j]], score[j] + gap * (x1[j] + y1[j]), j)
            done += 1
        best, j = tree.upto(below[i])
        gain = best - gap * (x0[i] + y0[i])
        score[i], before[i] = (size[i] + gain, j) if gain > 0 else (float(size[i]), -1)
    used, found = [False] * n, []
    for i in sorted(range(n), key=score.__getitem__, reverse=True):
        chain = []
        while i >= 0 and not used[i]:
            used[i] = True
            chain.append(i)
            i = before[i]
        if chain:
            found.append(runs_[chain[::-1]])
    return found


def aligned(a: np.ndarray, b: np.ndarray, chain: np.ndarray) -> np.ndarray:
    """For each word of `a` the place of its equal in `b`, or -1. chain: (x, y, length) within a and b."""
    place = np.full(len(a), -1, dtype=np.int64)

    def diagonal(x: int, y: int, n: int) -> None:
        equal = np.flatnonzero(a[x : x + n] == b[y : y + n])
        place[x + equal] = y + equal

    def shared(p: np.ndarray, q: np.ndarray) -> int:
        n = min(len(p), len(q))
        differ = np.flatnonzero(p[:n] != q[:n])
        return int(differ[0]) if len(differ) else n

    for i, (x, y, n) in enumerate(chain.tolist()):
        diagonal(x, y, n)
        if i + 1 < len(chain):
            u, v = chain[i + 1, 0].item(), chain[i + 1, 1].item()
            if u - x == v - y:
                diagonal(x + n, y + n, u - x - n)
            else:
                front = shared(a[x + n : u], b[y + n : v])
                diagonal(x + n, y + n, front)
                back = shared(a[x + n + front : u][::-1], b[y + n + front : v][::-1])
                diagonal(u - back, v - back, back)
    x, y = chain[0, 0].item(), chain[0, 1].item()
    n = min(x, y)
    diagonal(x - n, y - n, n)
    x, y = (chain[-1, 0] + chain[-1, 2]).item(), (chain[-1, 1] + chain[-1, 2]).item()
    diagonal(x, y, min(len(a) - x, len(b) - y))
    return place


def stretches(place: np.ndarray, least: int = LEAST_WORDS, similarity: float = SIMILARITY) -> list[tuple[int, int, int, int, float]]:
    """(x0, x1, y0, y1, similarity) of disjoint stretches of an alignment with at least so many words and such a share equal.

    similarity is the share of the stretch's words that the source holds in this order; what the source has between them
    counts only through the chain's gap costs, so that a source in which the passage was torn apart still shows it.

    Of all stretches with enough words that begin and end on an equal word the one with the greatest gain is taken, then the
    same on both sides of it. Its gain is below zero only if no stretch of enough words has the share.
    """
    loss = similarity / (1 - similarity)
    found, todo = [], [(0, len(place))]
    while todo:
        lo, hi = todo.pop()
        if hi - lo < least:
            continue
        equal = place[lo:hi] >= 0
        sums = np.concatenate([[0.0], np.cumsum(np.where(equal, 1.0, -loss))])
        begins = np.where(equal, sums[:-1], np.inf)
        low = np.minimum.accumulate(begins)[: hi - lo - least + 1]
        gains = np.where(equal[least - 1 :], sums[least:] - low, -np.inf)
        best = int(gains.argmax())
        if gains[best] < -1e-6:
            continue
        x0, x1 = lo + int(begins[: best + 1].argmin()), lo + best + least
        y = place[x0:x1]
        y = y[y >= 0]
        found.append((x0, x1, int(y.min()), int(y.max()) + 1, len(y) / (x1 - x0)))
        todo += [(lo, x0), (x1, hi)]
    return sorted(found)


def _chained(found: DataFrame, k: int, window: int, least: int) -> DataFrame:
    """doc, source, x0, x1, y0, y1, anchors (packed numbers) of every chain that may hold a passage."""
    out = pa.schema([(c, pa.int64()) for c in ("doc", "source", "x0", "x1", "y0", "y1")] + [("anchors", pa.binary())])
    enough = max(k, least - 2 * (window + k))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def chained() -> Iterator[tuple]:
            for (doc, source), part in runs(batches, ["doc", "source"]):
                x, y = (part.column(c).to_numpy().astype(np.int64) for c in ("x", "y"))
                if x[-1] - x[0] + k < enough:
                    continue
                for c in chains(anchors(x, y, k, window)):
                    x0, y0 = c[0, 0].item(), c[0, 1].item()
                    x1, y1 = (c[-1, 0] + c[-1, 2]).item(), (c[-1, 1] + c[-1, 2]).item()
                    if x1 - x0 >= enough:
                        yield doc, source, x0, x1, y0, y1, c.astype("<i4").tobytes()

        return emitted(chained(), out)

    dealt = found.repartition("doc", "source").sortWithinPartitions("doc", "source", "x")
    return dealt.mapInArrow(run, "doc long, source long, x0 long, x1 long, y0 long, y1 long, anchors binary")


def _blocks(docs: DataFrame, key: str, text: str) -> DataFrame:
    """of, block, words: 32-bit word hashes of every document, in blocks. (Two words agree by chance once in four billion times.)"""
    out = pa.schema([("of", pa.int64()), ("block", pa.int32()), ("words", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def cut() -> Iterator[tuple]:
            for doc, t in rows(batches, "key", "text"):
                h = (hashes()(t or "") >> np.uint64(32)).astype("<u4")
                for b in range(0, len(h), BLOCK):
                    yield doc, b // BLOCK, h[b : b + BLOCK].tobytes()

        yield from emitted(cut(), out)
        hashes().known.clear()
        trimmed()

    chosen = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).where("key is not null")
    return chosen.mapInArrow(run, "of long, block int, words binary")


def passages(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = K, window: int = WINDOW, least: int = LEAST_WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """key, start, end (words), source, source_start, source_end, similarity: a row for each passage of a later document that
    an earlier one (by id) holds too."""
    with stored(seeds(docs, key, text, k, window)) as sown:
        matched = checkpointed(matches(sown), sown.count(), MATCHES)
        n = matched.count()
        chained = checkpointed(_chained(matched, k, window, least), n, MATCHES)
        told = checkpointed(_told(docs, chained, key, text, least, similarity), chained.count(), CHAINS)
        left = checkpointed(unexplained(matched, told, key, k, least), n, MATCHES)
        if not (n := left.count()):
            return told
        found = checkpointed(_chained(further(left), k, window, least), n, MATCHES)
    more = _told(docs, found, key, text, least, similarity)
    # a first document may be the one before too
    return told.unionByName(more.join(told.select(key, "source", "start", "end"), [key, "source", "start", "end"], "left_anti").select(*told.columns).distinct())


def _told(docs: DataFrame, found: DataFrame, key: str, text: str, least: int, similarity: float) -> DataFrame:
    """The passages of the chains, as their words show them."""
    name = ["doc", "source", "x0"]

    def wanted(side: int, of: str, lo: str, hi: str) -> DataFrame:
        first = F.floor(F.greatest(F.col(lo) - BEYOND, F.lit(0)) / BLOCK)
        last = F.floor((F.col(hi) + BEYOND - 1) / BLOCK)
        return found.select(*name, F.lit(side).alias("side"), F.col(of).alias("of"), F.explode(F.sequence(first.cast("int"), last.cast("int"))).alias("block"))

    asked = wanted(1, "doc", "x0", "x1").unionByName(wanted(2, "source", "y0", "y1"))
    fetched = asked.join(_blocks(docs, key, text), ["of", "block"]).select(*name, "side", "block", F.col("words").alias("payload"))
    whole = found.select(*name, F.lit(0).alias("side"), F.lit(0).alias("block"), F.col("anchors").alias("payload")).unionByName(fetched)
    dealt = whole.repartition(*name).sortWithinPartitions(*name, "side", "block", "payload")
    out = pa.schema([(c, pa.int64()) for c in ("key", "start", "end", "source", "source_start", "source_end")] + [("similarity", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def aligned_rows() -> Iterator[tuple]:
            for (doc, source, _), part in runs(batches, name):
                chain, sides = None, {1: {}, 2: {}}
                for side, block, payload in zip(*(part.column(c).to_pylist() for c in ("side", "block", "payload")), strict=True):
                    if side == 0:
                        chain = np.frombuffer(payload, dtype="<i4").reshape(-1, 3).astype(np.int64)
                    else:
                        sides[side].setdefault(block, payload)
                if chain is None or not sides[1] or not sides[2]:
                    continue
                a, b = (np.frombuffer(b"".join(sides[s][i] for i in sorted(sides[s])), dtype="<u4") for s in (1, 2))
                at = min(sides[1]) * BLOCK, min(sides[2]) * BLOCK
                local = chain - np.array([*at, 0])
                local = local[(local[:, 0] + local[:, 2] <= len(a)) & (local[:, 1] + local[:, 2] <= len(b))]
                if len(local):
                    for x0, x1, y0, y1, s in stretches(aligned(a, b, local), least, similarity):
                        yield doc, at[0] + x0, at[0] + x1, source, at[1] + y0, at[1] + y1, s

        return emitted(aligned_rows(), out)

    done = dealt.mapInArrow(run, "key long, start long, end long, source long, source_start long, source_end long, similarity double")
    return done.withColumnRenamed("key", key)


def remove(docs: DataFrame, found: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents without the words of their passages; documents of which no word is left go. Other columns stay.

    Spans belong to a key: where rows share an id, key has to name a column that tells them apart, as `keyed` gives.
    """
    spans = found.groupBy(F.col(key).alias("key")).agg(F.collect_list(F.struct("start", "end")).alias("spans"))  # a document's own

    @F.arrow_udf("string")
    def without(texts: pa.Array, spans_: pa.Array) -> pa.Array:
        return pa.array((cut_words(t, [(s["start"], s["end"]) for s in x]) for t, x in zip(texts.to_pylist(), spans_.to_pylist(), strict=True)), type=pa.string())

    # the row goes as one column, so that its own names don't matter
    joined = docs.select(F.struct("*").alias("doc"), F.col(key).cast("long").alias("key")).join(spans, "key", "left")
    untouched = joined.where("spans is null").select("doc.*")
    left = joined.where("spans is not null").select("doc", without(F.col("doc").getField(text), F.col("spans")).alias("left")).where(F.col("left").rlike(r"[^\x20\x09-\x0D]"))
    return untouched.unionByName(left.select(F.col("doc").withField(text, F.col("left")).alias("doc")).select("doc.*"))


def cut_words(text: str | None, spans: list[tuple[int, int]]) -> str | None:
    """A text without the words of the spans (by number, ends excluded) and the white space after them."""
    if text is None:
        return None
    data = text.encode("utf-8", "surrogatepass")
    begins = [m.start() for m in _WORD.finditer(data)]
    kept, at = [], 0
    for start, end in sorted(spans):
        lo = begins[start] if start < len(begins) else len(data)
        hi = begins[end] if end < len(begins) else len(data)
        if hi > at:
            kept.append(data[at : max(at, lo)])
            at = hi
    return b"".join([*kept, data[at:]]).decode("utf-8", "surrogatepass")
