"""Operator 11: phrases whose words keep together, counted exactly by automata over candidates that a sketch leaves.

Words are what blanks and tabs part within pieces that marks of punctuation and line ends part; A-Z count as a-z. All counts are per language.

1. Sketch: every task counts its runs of one to four words in two rows of cells, by two hashes, and hands on, packed, how
   often each cell of a block of 65,536 was met. Spark adds up the blocks, wherever they lie. A cell's count is at least that
   of each of its runs, so the lower of a run's two bounds it from above; what remains is a table of bits, one for each cell
   that reaches the least count. A row has a cell for some `cell_bytes` bytes of text, so it grows with the corpus, and how
   full it is doesn't. Where bits would outgrow a worker, they are worked through in rounds of 2^`round_bits` cells.
2. Candidates: runs of one to four words whose cells, and whose parts' cells, reach the least count. A task gathers those of a
   stretch of its texts, until they or the texts fill their bounds.
3. Automata: the candidates of a stretch become one pyahocorasick automaton for each language, whose keys have a blank on each
   side, as all words of the scanned texts have; so a match begins and ends at words, and overlapping matches share blanks.
   What a stretch doesn't hold needn't be looked for in it: each text is scanned once, however many candidates the corpus has.
   Spark adds up the matches of all stretches; as bits are the same to all tasks, a candidate is one wherever it occurs.
4. Thresholds: on exact counts alone, so what the sketch let through too much changes nothing.

Bits are a Parquet table in the shared folder, which tasks open there; nothing of them passes the driver.

Edge cases: a null or empty text has no words; a null language is `und`; equal rows and repeated ids count as often as they are
there; a text of any length is worked through in parts that end with a piece or overlap by three words; an empty table gives
no rows; other columns are left out. Hashes have 64 bits: a candidate could be lost only where two of a task's runs shared one.
"""

from __future__ import annotations

import functools
from collections import Counter
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import Recent, kept, rows, trimmed
from quern.llm.shared import new_folder, opened

#: Fixed values of the scores.
LEAST, LONGEST, SCALE, INSIDE_PERCENT, TOP = 30, 4, 2_000_000, 80, 2000
#: Bytes of text for a cell of a row; cells of a block; cells of a round, whose bits take 512 MB of a worker.
CELL_BYTES, BLOCK_BITS, ROUND_BITS = 24, 16, 32
#: Words that are hashed at once; runs counted before a task hands its cells on; characters of a stretch's candidates.
PART_WORDS, HELD, SHARD_CHARS = 1 << 16, 1 << 22, 12_000_000
#: Bytes of a stretch of text; cells for the hashes of its candidates, so that most aren't looked up one by one.
HELD_BYTES, NEAR_BITS = 1 << 26, 22
_MARK = 0xFF  # a byte that UTF-8 never has
_TABLE = bytes(_MARK if chr(b) in ".,;:!?\n\v\f\r" else 0x20 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def text_words(text: str) -> list[bytes]:
    """The words of a text in lower case, with b'\\xff' between pieces."""
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).replace(b"\xff", b" \xff ").split()


def parts(text: list[bytes], size: int = PART_WORDS) -> Iterator[tuple[list[bytes], int]]:
    """Words in parts of about `size`, with how many of a part's first words belong to the part before: three where a piece goes on, else none."""
    start = over = 0
    while start < len(text):
        end = start + size
        if end >= len(text):
            yield text[start:], over
            return
        while end > start + size // 2 and text[end - 1] != b"\xff":
            end -= 1
        whole = text[end - 1] == b"\xff"
        end = end if whole else start + size
        yield text[start:end], over
        over = 0 if whole else LONGEST - 1
        start = end - over


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * _ODD[1]
    return x ^ (x >> np.uint64(32))


class Hasher:
    """64-bit hashes of the runs of a list of words, words hashed once."""

    def __init__(self):
        self.known = Recent(300_000)

    def runs(self, words: list[bytes], lang: str) -> list[np.ndarray]:
        """For runs of one to four words their hashes, by where they begin; 0 where a run holds a mark."""
        if new := self.known.unknown(set(words)):
            self.known.hand.update((w, xxhash.xxh3_64_intdigest(w) | 1) for w in new)
        if b"\xff" in self.known.hand:
            self.known.hand[b"\xff"] = 0
        one = np.fromiter(map(self.known.hand.__getitem__, words), np.uint64, len(words))
        seed = np.uint64(xxhash.xxh3_64_intdigest(lang, 1) | 1)  # a seed of their own: as a product, en in German would be de in English
        found = [np.where(one > 0, _mixed(one * seed) | np.uint64(1), np.uint64(0))]
        for _ in range(LONGEST - 1):
            last = found[-1]
            n = max(0, len(last) - 1)
            longer = _mixed(last[:n] * _ODD[0] + found[0][len(words) - n :]) | np.uint64(1)
            found.append(np.where((last[:n] > 0) & (found[0][len(words) - n :] > 0), longer, np.uint64(0)))
        return found


def _cells(runs: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The cells of hashes in both rows; the second row's come after the first one's 2^bits."""
    shift = np.uint64(64 - bits)
    return runs >> shift, (_mixed(runs * _ODD[2]) >> shift) + np.uint64(1 << bits)


def _own(runs: list[np.ndarray], over: int) -> list[np.ndarray]:
    """The hashes of runs that don't lie within the first `over` words, which the part before has counted."""
    return [r[max(0, over - m) :] if over else r for m, r in enumerate(runs)]


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[bytes], int]]:
    """Language, words, and how many of the first ones are known from the part before; short texts of a language come together,
    a mark between them, as arrays of few words cost more than their words."""
    held: dict[str, list[bytes]] = {}
    for lang, text in rows(batches, "lang", "text"):
        for part, over in parts(text_words(text)):
            if over or len(part) >= PART_WORDS // 2:
                yield lang, part, over
            elif part:
                some = held.setdefault(lang, [])
                some += part
                some.append(b"\xff")
                if len(some) >= PART_WORDS // 2:
                    yield lang, held.pop(lang), 0
    for lang, some in held.items():
        yield lang, some, 0


def sketch(docs: DataFrame, bits: int, least: int = LEAST) -> DataFrame:
    """block, cells (a bit for each of its cells, set where runs of a hash have been met `least` times in sum), of all blocks with some."""
    narrow = np.uint32 if bits < 32 else np.uint64  # sorted twice as fast
    kind = np.dtype("<u1" if least < 256 else "<u4")  # what a task counts of a cell may stop at the least count
    partial = pa.schema([("block", pa.int32()), ("cells", pa.binary())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, held, size = Hasher(), [], 0

        def told() -> Iterator[pa.RecordBatch]:
            every = np.concatenate(held)
            every.sort()
            at = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
            cells, times = every[at].astype(np.uint64), np.diff(at, append=len(every))
            block = (cells >> np.uint64(BLOCK_BITS)).astype(np.int64)
            cuts = np.flatnonzero(np.diff(block, prepend=-1))
            place = (cells & np.uint64((1 << BLOCK_BITS) - 1)).astype("<u2")
            times = np.minimum(times, least).astype(kind)
            ends = [*cuts[1:].tolist(), len(cells)]
            packed = [place[a:b].tobytes() + times[a:b].tobytes() for a, b in zip(cuts.tolist(), ends, strict=True)]
            for at in range(0, len(packed), 2000):
                yield pa.RecordBatch.from_arrays([pa.array(block[cuts[at : at + 2000]], pa.int32()), pa.array(packed[at : at + 2000], pa.binary())], schema=partial)

        for lang, part, over in _texts(batches):
            for r in _own(hasher.runs(part, lang), over):
                held += (c.astype(narrow) for c in _cells(r[r > 0], bits))
                size += 2 * len(held[-1])
            if size >= HELD:
                yield from told()
                held, size = [], 0
        if size:
            yield from told()
        trimmed()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, sums = None, np.zeros(1 << BLOCK_BITS, np.int64)

        def told() -> Iterator[pa.RecordBatch]:
            if at is not None and (sums >= least).any():
                yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([np.packbits(sums >= least).tobytes()], pa.binary())], schema=partial)

        for batch in batches:
            for block, cells in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if block != at:
                    yield from told()
                    at = block
                    sums[:] = 0
                data = np.frombuffer(cells.as_buffer(), np.uint8)
                n = 2 * (len(data) // (2 + kind.itemsize))
                sums[data[:n].view("<u2")] += data[n:].view(kind)  # a task's cells are distinct
        yield from told()
        trimmed()

    counted = docs.mapInArrow(count, "block int, cells binary")
    return counted.repartition("block").sortWithinPartitions("block").mapInArrow(add, "block int, cells binary")


@functools.lru_cache(maxsize=1)
def _bits(path: str, first: int, blocks: int) -> np.ndarray:
    """The bits of `blocks` blocks from the first one on, once per Python worker."""
    store, at = opened(path)
    each = (1 << BLOCK_BITS) // 8
    found = np.zeros(blocks * each, np.uint8)
    for batch in pq.ParquetDataset(at, filesystem=store).fragments:
        for part in batch.to_batches(batch_size=256):
            for block, cells in zip(part.column("block").to_pylist(), part.column("cells"), strict=True):
                if first <= block < first + blocks:
                    found[(block - first) * each : (block - first + 1) * each] = np.frombuffer(cells.as_buffer(), np.uint8)
    return found


def automaton(phrases: list[str]):
    """The automaton of phrases, which gives a phrase's place for each of its occurrences."""
    import ahocorasick

    found = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for i, p in enumerate(phrases):
        found.add_word(f" {p} ", i)
    found.make_automaton()
    return found


def scanned(docs: DataFrame, bits: int, path: str, shard_chars: int = SHARD_CHARS, first: int = 0, blocks: int | None = None) -> DataFrame:
    """lang, phrase, n: how often stretches of text hold their candidates, overlapping occurrences included; with the first blocks
    also how many words they have, as the empty phrase.

    Candidates are runs of one to four words with enough hits in their cells and in those of their parts; of runs whose cell in
    the first row is one of the given blocks'. What cells of other blocks hold isn't known here, and passes.
    """
    blocks = blocks or 1 << bits + 1 - BLOCK_BITS
    low, high = first << BLOCK_BITS, (first + blocks) << BLOCK_BITS
    shift = np.uint64(64 - NEAR_BITS)
    out = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("n", pa.int64())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, table = Hasher(), _bits(path, first, blocks)
        near, seen = np.zeros(1 << NEAR_BITS, np.uint64), set()  # near: of the hashes in seen, the last one of each cell
        held: dict[str, tuple[list[str], list[tuple[bytes, int]]]] = {}
        words: Counter = Counter()
        chars = size = 0

        def met(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Whether the cells of runs reach the least count, as far as they are known here, and whether the first row's is."""
            good, known = np.ones(len(r), bool), None
            for cells in _cells(r, bits):
                cell = cells.astype(np.int64) - low
                here = (cell >= 0) & (cell < high - low)
                cell[~here] = 0
                good &= (table[cell >> 3] >> (7 - (cell & 7)).astype(np.uint8) & 1).astype(bool) | ~here
                known = here if known is None else known
            return good, known

        def told() -> Iterator[pa.RecordBatch]:
            for lang, (phrases, texts) in held.items():
                machine, each = automaton(phrases), np.zeros(len(phrases), np.int64)
                for text, sign in texts if phrases else ():
                    found = np.fromiter(map(itemgetter(1), machine.iter(text.decode("utf-8", "surrogatepass"))), np.int64)
                    each += sign * np.bincount(found, minlength=len(phrases))
                there = np.flatnonzero(each)
                for at in range(0, len(there), 5000):
                    few = there[at : at + 5000].tolist()
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(few), pa.string()), pa.array([phrases[i] for i in few], pa.string()), pa.array(each[few], pa.int64())], schema=out)

        for lang, part, over in _texts(batches):
            phrases, texts = held.setdefault(lang, ([], []))
            # what the part before has counted is taken off
            for some, sign in ((part, 1), (part[:over], -1)) if over else ((part, 1),):
                texts.append((b" %b " % b" ".join(some).replace(b"\xff", b"\n"), sign))
                size += len(texts[-1][0])
                words[lang] += sign * (len(some) - some.count(b"\xff"))
            good = np.ones(len(part) + 1, bool)
            for m, r in enumerate(hasher.runs(part, lang), 1):
                n = len(r)
                at = np.flatnonzero(good[:n] & good[1 : n + 1] & (r > 0))
                often, known = met(r[at])
                good = np.zeros(n, bool)
                good[at[often]] = True
                at = at[often & known]
                at = at[near[r[at] >> shift] != r[at]]
                distinct, where = np.unique(r[at], return_index=True)
                near[distinct >> shift] = distinct
                new = [(h, i) for h, i in zip(distinct.tolist(), at[where].tolist(), strict=True) if h not in seen]
                seen.update(h for h, _ in new)
                phrases += (b" ".join(part[i : i + m]).decode("utf-8", "surrogatepass") for _, i in new)
                chars += sum(len(p) + 2 for p in phrases[len(phrases) - len(new) :])
            if chars >= shard_chars or size >= HELD_BYTES:
                yield from told()
                held.clear()
                seen.clear()
                near[:] = 0
                chars = size = 0
        yield from told()
        if first == 0 and words:
            yield pa.RecordBatch.from_arrays([pa.array(list(words), pa.string()), pa.array([""] * len(words), pa.string()), pa.array(list(words.values()), pa.int64())], schema=out)
        trimmed()

    return docs.mapInArrow(scan, "lang string, phrase string, n long")


def counts(docs: DataFrame, least: int = LEAST, cell_bytes: int = CELL_BYTES, round_bits: int = ROUND_BITS, shard_chars: int = SHARD_CHARS) -> DataFrame:
    """lang, phrase, f of all phrases of two to four words with `least` occurrences, and of their words; exact. The empty phrase has all words."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # a task hands on each phrase that it sees once a stretch: tasks of many files do so less often, and are no larger than a gigabyte
    docs = docs.coalesce(max(2 * docs.sparkSession.sparkContext.defaultParallelism, size >> 30))
    bits, path = max(BLOCK_BITS, (size // cell_bytes).bit_length() - 1), new_folder(docs.sparkSession, "sketch")
    sketch(docs, bits, least).write.parquet(path)
    if bits < round_bits:
        found = [scanned(docs, bits, path, shard_chars)]
    else:
        blocks = 1 << round_bits - BLOCK_BITS
        found = [scanned(docs, bits, path, shard_chars, first, blocks) for first in range(0, 1 << bits - BLOCK_BITS, blocks)]
    each = functools.reduce(DataFrame.unionByName, found)
    return kept(each.groupBy("lang", "phrase").agg(F.sum("n").alias("f")).where((F.col("f") >= least) | (F.col("phrase") == "")))


def _size() -> Column:
    return F.length("phrase") - F.length(F.translate("phrase", " ", "")) + 1


def scored(found: DataFrame) -> DataFrame:
    """lang, phrase, a, l, r, score of the phrases of two and more words: by the cut with the lowest score, of those the first one."""
    words = F.split("phrase", " ")
    cuts = found.where(_size() > 1).select("lang", "phrase", F.col("f").alias("a"), words.alias("words")).select("*", F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k"))
    halves = cuts.select("lang", "phrase", "a", "k", F.array_join(F.slice("words", 1, F.col("k")), " ").alias("first"), F.array_join(F.slice("words", F.col("k") + 1, F.size("words") - F.col("k")), " ").alias("rest"))
    for part, name in (("first", "l"), ("rest", "r")):
        halves = halves.join(found.select("lang", F.col("phrase").alias(part), F.col("f").alias(name)), ["lang", part])
    score = F.expr(f"CAST({SCALE} AS DECIMAL(8,0)) * CAST(a AS DECIMAL(19,0)) DIV (CAST(l AS DECIMAL(19,0)) + CAST(r AS DECIMAL(19,0)))")
    lowest = F.min(F.struct(score.cast("long").alias("score"), "k", "l", "r")).alias("least")
    return halves.groupBy("lang", "phrase", "a").agg(lowest).select("lang", "phrase", "a", "least.l", "least.r", "least.score")


def inside(found: DataFrame, percent: int = INSIDE_PERCENT) -> DataFrame:
    """lang, phrase of those whose words lie in a longer one that has at least the share of their occurrences."""
    words = F.split("phrase", " ")
    longer = found.where(_size() > 2).select("lang", F.col("f").alias("most"), words.alias("words"), F.size(words).alias("size"))
    n = longer.select("*", F.explode(F.sequence(F.lit(2), F.col("size") - 1)).alias("n"))
    parts_ = n.select("lang", "most", F.explode(F.transform(F.sequence(F.lit(1), F.col("size") - F.col("n") + 1), lambda i: F.array_join(F.slice("words", i, F.col("n")), " "))).alias("phrase"))
    most = parts_.groupBy("lang", "phrase").agg(F.max("most").alias("most"))
    wide = F.expr(f"CAST(100 AS DECIMAL(3,0)) * CAST(most AS DECIMAL(19,0)) >= CAST({percent} AS DECIMAL(3,0)) * CAST(f AS DECIMAL(19,0))")
    return found.join(most, ["lang", "phrase"]).where(wide).select("lang", "phrase")


def phrases(docs: DataFrame, text: str = "text", lang: str = "lang", top: int = TOP, least: int = LEAST, **sizes: int) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first `top` phrases by score, then occurrences, then the phrase's bytes."""
    chosen = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    found = counts(chosen, least, **sizes)
    left = scored(found).join(inside(found), ["lang", "phrase"], "left_anti")
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    best = left.withColumn("rank", place.cast("long")).where(F.col("rank") <= top)
    return best.join(found.where("phrase = ''").select("lang", F.col("f").alias("n")), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
