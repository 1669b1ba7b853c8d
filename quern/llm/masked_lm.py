"""Operator 9: document scores by masked pseudo-likelihood.

A small network predicts every word from the two words on either side of it: embeddings of the neighbours, weighted by
place, go through a hidden layer, whose product with the word's own output embedding says how much likelier the word is here
than elsewhere. So P(word | neighbours) = share of the word in the corpus * exp(product) / Z, where Z is the mean of the
exponential over words drawn from the corpus. A document's score is the sum of the logarithms of these conditional
probabilities over all of its words.

Words are counted exactly, by 64-bit hashes, in a distributed table that grows with the corpus: documents are gathered in
blocks of words, the blocks' distinct words meet by hash to be summed, and the sums go back to their blocks. Nothing of it
comes to the driver. Embeddings are of `BUCKETS` hashed words, the network's fixed size.

The network is trained in numpy on every word of the corpus, by telling it from words drawn from the same task (negative
sampling, whose optimum is the logarithm of the ratio above): each task passes once over its rows from a common start, and
the tasks' embeddings are averaged by the words that each has seen, the other weights by all words. Tasks send their tables
in packed parts, summed in two rounds: first those of a group of tasks, then the groups. The result depends on how rows are
dealt to tasks, as averages of models do.

Edge cases: a null or empty text has no words, log_prob 0 and no mean; a single word is predicted from pads; a text of any
length is trained and scored whole, in pieces that overlap by a window; equal rows and ids are trained and scored each; null
ids stay null; an empty table gives no rows; extra columns are left out of the result. Ids are whole numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import Recent, byte_words, checkpointed, emitted, rows, trimmed

BUCKETS, SIZE, SIDE, SEED = 1 << 16, 16, 2, 5
#: Words of a block at least, of a training step, and of a scoring run; drawn words of a step, and for Z.
BLOCK, STEP, BATCH, DRAWN, NOISE = 1 << 20, 2048, 4096, 16, 64
#: Neighbours by place, as offsets.
PLACES = tuple(d for d in range(-SIDE, SIDE + 1) if d)
#: Rows of a packed part of the embeddings, and tasks whose parts are summed together first.
PART, GROUP = 1024, 64
#: Counts that a task packs by block at once.
PACKED = 1 << 20
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_PACKED = "struct<keys:array<long>,lengths:binary,ids:binary,words:binary>"


def blocks(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = BLOCK) -> DataFrame:
    """block, n_words, packed: documents in blocks; each word as its number among the block's distinct words' hashes."""
    kind = pa.struct([("keys", pa.list_(pa.int64())), ("lengths", pa.binary()), ("ids", pa.binary()), ("words", pa.binary())])
    out = pa.schema([("block", pa.int64()), ("n_words", pa.int64()), ("packed", kind)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, first = Recent(), TaskContext.get().partitionId() << 32

        def packed(keys: list, held: list[np.ndarray], number: int) -> tuple:
            words, ids = np.unique(np.concatenate([np.zeros(0, np.uint64), *held]), return_inverse=True)
            return first + number, len(ids), {"keys": keys, "lengths": np.array([len(x) for x in held], "<i8").tobytes(), "ids": ids.astype("<u4").tobytes(), "words": words.astype("<u8").tobytes()}

        def found() -> Iterator[tuple]:
            keys, held, n, number = [], [], 0, 0
            for k, t in rows(batches, "key", "text"):
                ws = byte_words(t or "")
                new = known.unknown(set(ws))
                at = known.hand
                for w in new:
                    at[w] = xxhash.xxh64_intdigest(w.translate(_LOWER))
                keys.append(k)
                held.append(np.fromiter(map(at.__getitem__, ws), dtype=np.uint64, count=len(ws)))
                n += len(ws)
                if n >= size or len(keys) >= size:
                    yield packed(keys, held, number)
                    keys, held, n, number = [], [], 0, number + 1
            if keys:
                yield packed(keys, held, number)

        yield from emitted(found(), out, weight=lambda r: r[1] * 4)
        known.clear()
        trimmed()

    chosen = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    return chosen.mapInArrow(run, f"block long, n_words long, packed {_PACKED}")


def counted(held: DataFrame) -> DataFrame:
    """block, at, total: how often distinct words of a block (their numbers, packed) stand in the whole corpus (packed too)."""
    out = pa.schema([("word", pa.int64()), ("block", pa.int64()), ("at", pa.int32()), ("n", pa.int64())])
    packed = pa.schema([("block", pa.int64()), ("at", pa.binary()), ("total", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = np.frombuffer(p["words"], dtype="<u8")
                n = np.bincount(np.frombuffer(p["ids"], dtype="<u4"), minlength=len(words))
                for a in range(0, len(words), 1 << 16):
                    part = slice(a, a + (1 << 16))
                    own = words[part].view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(np.full(len(own), block)), pa.array(np.arange(a, a + len(own), dtype=np.int32)), pa.array(n[part].astype(np.int64))], schema=out)

    def by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of a block in one, as far as they meet in a task."""

        def found() -> Iterator[tuple]:
            some, n = [], 0
            for batch in batches:
                some.append([c.to_numpy() for c in batch.columns])
                n += batch.num_rows
                if n >= PACKED:
                    yield from together(some)
                    some, n = [], 0
            if n:
                yield from together(some)

        def together(some: list[list[np.ndarray]]) -> Iterator[tuple]:
            block, at, total = (np.concatenate(c) for c in zip(*some, strict=True))
            order = np.argsort(block, kind="stable")
            block, at, total = block[order], at[order].astype("<u4"), total[order].astype("<i8")
            begins = np.flatnonzero(np.append(True, block[1:] != block[:-1])).tolist()
            for a, b in zip(begins, [*begins[1:], len(block)], strict=True):
                yield block[a].item(), at[a:b].tobytes(), total[a:b].tobytes()

        return emitted(found(), packed, weight=lambda r: len(r[1]) + len(r[2]))

    each = held.select("block", "packed").mapInArrow(run, "word long, block long, at int, n long")
    # a word has at most a row for each block, and the window spills
    totals = each.select("block", "at", F.sum("n").over(Window.partitionBy("word")).alias("total"))
    return totals.mapInArrow(by_block, "block long, at binary, total binary")


def bucket(words: np.ndarray) -> np.ndarray:
    """The embedding of each word hash: 1 up; 0 is the pad."""
    return (1 + words % np.uint64(BUCKETS - 1)).astype(np.int64)


class Model:
    """The network's weights."""

    def __init__(self, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.embed = rng.normal(0, 0.3, (BUCKETS, SIZE)).astype(np.float32)
        self.embed[0] = 0
        self.out = rng.normal(0, 0.05, (BUCKETS, SIZE)).astype(np.float32)
        self.place = np.full((len(PLACES), SIZE), 0.5, dtype=np.float32)
        self.hidden = np.zeros(SIZE, dtype=np.float32)
        self.noise = np.zeros(0, dtype=np.int64)  # buckets drawn by their share of the corpus, evenly over it

    def forward(self, padded: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Embeddings, and the hidden layer of what stands between the side pads."""
        n = len(padded) - 2 * SIDE
        x = self.embed.take(padded, axis=0)
        s = np.tile(self.hidden, (n, 1))
        for w, d in zip(self.place, PLACES, strict=True):
            s += w * x[SIDE + d : SIDE + d + n]
        return x, np.tanh(s)

    def ratios(self, padded: np.ndarray) -> np.ndarray:
        """For each bucket between the side pads the logarithm of how much likelier it is there than elsewhere."""
        found = [np.zeros(0)]
        noise = self.out[self.noise].T
        for a in range(0, len(padded) - 2 * SIDE, BATCH):
            piece = padded[a : a + BATCH + 2 * SIDE]
            _, h = self.forward(piece)
            z = np.log(np.exp(h @ noise).mean(axis=1)) if noise.size else 0.0
            found.append((np.einsum("ij,ij->i", h, self.out.take(piece[SIDE:-SIDE], axis=0)) - z).astype(np.float64))
        return np.concatenate(found)


class Trainer:
    """One pass of Adagrad over the words of a task."""

    def __init__(self, model: Model, rate: float = 0.1, seed: int = SEED):
        self.model, self.rate, self.rng = model, rate, np.random.default_rng(seed)
        self.seen = {"embed": np.zeros(BUCKETS, np.float32), "out": np.zeros(BUCKETS, np.float32)}
        self.squares = {"place": np.full(model.place.shape, 1e-3, np.float32), "hidden": np.full(model.hidden.shape, 1e-3, np.float32), "embed": np.full(BUCKETS, 1e-3, np.float32), "out": np.full(BUCKETS, 1e-3, np.float32)}
        self.words = 0

    def _step(self, name: str, slope: np.ndarray) -> None:
        total, value = self.squares[name], getattr(self.model, name)
        total += slope * slope
        value -= self.rate * slope / np.sqrt(total)

    def _rows(self, name: str, at: np.ndarray, slopes: np.ndarray, seen: np.ndarray) -> None:
        """A step of the embeddings `at`, whose slopes add up where an embedding stands several times."""
        order = np.argsort(at, kind="stable")
        ids = at[order]
        begins = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
        which, total = ids[begins], np.add.reduceat(slopes.take(order, axis=0), begins, axis=0)
        self.seen[name][which] += np.add.reduceat(seen[order], begins)
        if which[0] == 0:  # the pad stays as it is
            which, total = which[1:], total[1:]
        squares = self.squares[name]
        squares[which] += (total * total).mean(axis=1)
        getattr(self.model, name)[which] -= self.rate * total / np.sqrt(squares[which])[:, None]

    def step(self, padded: np.ndarray) -> None:
        m = self.model
        own = padded[SIDE:-SIDE]
        words = own[own > 0]
        if not len(words):
            return
        n = len(own)
        real = (own > 0).astype(np.float32)  # pads between documents are no words
        x, h = m.forward(padded)
        drawn = words[self.rng.integers(0, len(words), DRAWN)]
        o, other = m.out.take(own, axis=0), m.out[drawn]
        good = (1 / (1 + np.exp(-np.clip(np.einsum("ij,ij->i", h, o), -15, 15))) - 1) * real / len(words)
        bad = (1 / (1 + np.exp(-np.clip(h @ other.T, -15, 15)))) * (real / (len(words) * DRAWN))[:, None]
        back = (good[:, None] * o + bad @ other) * (1 - h * h)
        change = np.zeros_like(x)
        slope = np.empty_like(m.place)
        for i, (w, d) in enumerate(zip(m.place, PLACES, strict=True)):
            near = slice(SIDE + d, SIDE + d + n)
            slope[i] = (back * x[near]).sum(axis=0)
            change[near] += back * w
        self._step("hidden", back.sum(axis=0))
        self._step("place", slope)
        self._rows("embed", padded, change, np.ones(len(padded), np.float32))
        self._rows("out", np.concatenate([own, drawn]), np.concatenate([good[:, None] * h, bad.T @ h]), np.concatenate([real, np.zeros(DRAWN, np.float32)]))
        self.words += len(words)


def padded(p: dict, buckets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A block's words as buckets with pads around each document; where each word is; each document's number of words."""
    ids, lengths = np.frombuffer(p["ids"], dtype="<u4"), np.frombuffer(p["lengths"], dtype="<i8")
    at = np.arange(len(ids)) + SIDE * (1 + np.repeat(np.arange(len(lengths)), lengths))
    whole = np.zeros(len(ids) + SIDE * (len(lengths) + 1), dtype=np.int64)
    whole[at] = buckets[ids]
    return whole, at, lengths


def train(held: DataFrame, seed: int = SEED) -> Model:
    """The average of the models that tasks train on their blocks, from one pass over the whole corpus."""
    out = pa.schema([("part", pa.int32()), ("team", pa.int32()), ("sums", pa.binary())])
    width = 2 * SIZE + 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, task = Trainer(Model(seed)), TaskContext.get().partitionId()
        for batch in batches:
            for p in batch.column(0).to_pylist():
                whole, _, _ = padded(p, bucket(np.frombuffer(p["words"], dtype="<u8")))
                for a in range(0, len(whole) - 2 * SIDE, STEP):
                    t.step(whole[a : a + STEP + 2 * SIDE])
        if not t.words:
            return

        def found() -> Iterator[tuple]:
            yield -1, task // GROUP, np.append(np.concatenate([t.model.place.ravel(), t.model.hidden]) * t.words, t.words).astype("<f4").tobytes()
            for part in range(0, BUCKETS, PART):
                own = slice(part, part + PART)
                e, o = t.seen["embed"][own, None], t.seen["out"][own, None]
                if e.any() or o.any():
                    yield part // PART, task // GROUP, np.concatenate([t.model.embed[own] * e, t.model.out[own] * o, e, o], axis=1).astype("<f4").tobytes()

        yield from emitted(found(), out, weight=lambda r: len(r[2]))

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for part, team, sums in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                x = np.frombuffer(sums, dtype="<f4").astype(np.float64)
                totals[part, team] = totals[part, team] + x if (part, team) in totals else x
        yield from emitted(((part, team, x.astype("<f4").tobytes()) for (part, team), x in totals.items()), out, weight=lambda r: len(r[2]))

    kind = "part int, team int, sums binary"
    teams = held.select("packed").mapInArrow(run, kind).repartition("part", "team").mapInArrow(summed, kind)
    whole = teams.select("part", F.lit(0).alias("team"), "sums").repartition("part").mapInArrow(summed, kind).select("part", "sums").toArrow()  # the network's size
    model, share = Model(seed), np.zeros(BUCKETS)
    for part, sums in zip(whole.column(0).to_pylist(), whole.column(1).to_pylist(), strict=True):
        x = np.frombuffer(sums, dtype="<f4")
        if part < 0:
            model.place, model.hidden = (x[: model.place.size] / x[-1]).reshape(model.place.shape), x[model.place.size : -1] / x[-1]
            continue
        x = x.reshape(PART, width)
        own = slice(part * PART, (part + 1) * PART)
        for name, sums_, n in (("embed", x[:, :SIZE], x[:, -2:-1]), ("out", x[:, SIZE : 2 * SIZE], x[:, -1:])):
            getattr(model, name)[own] = np.where(n > 0, sums_ / np.maximum(n, 1), getattr(model, name)[own])
        share[own] = x[:, -1]
    model.embed[0] = 0
    if share.sum():
        order = np.argsort(-share, kind="stable")
        model.noise = order[np.searchsorted(np.cumsum(share[order]), (np.arange(NOISE) + 0.5) / NOISE * share.sum())]
    return model


def score(docs: DataFrame, key: str = "doc_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """key, n_words, log_prob, mean_log_prob, perplexity of every row, by a model of these documents."""
    held = checkpointed(blocks(docs, key, text, block))
    model = docs.sparkSession.sparkContext.broadcast(train(held))
    words = held.agg(F.coalesce(F.sum("n_words"), F.lit(0))).first()[0]
    out = pa.schema([("key", pa.int64()), ("n_words", pa.int64()), ("log_prob", pa.float64())])
    nothing = F.lit(None).cast("binary")
    whole = held.select("block", F.lit(0).alias("side"), "packed", nothing.alias("at"), nothing.alias("total"))
    whole = whole.unionByName(counted(held).select("block", F.lit(1).alias("side"), F.lit(None).cast(_PACKED).alias("packed"), "at", "total"))  # counts come behind their block

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def scored(p: dict, counts: np.ndarray) -> Iterator[tuple]:
            share = np.log(counts) - np.log(max(words, 1))
            line, at, lengths = padded(p, bucket(np.frombuffer(p["words"], dtype="<u8")))
            each = model.value.ratios(line)[at - SIDE] + share[np.frombuffer(p["ids"], dtype="<u4")]
            ends = np.cumsum(lengths)
            for k, a, b in zip(p["keys"], (ends - lengths).tolist(), ends.tolist(), strict=True):
                yield k, b - a, float(each[a:b].sum())

        def found() -> Iterator[tuple]:
            p, counts = None, np.zeros(0)
            for batch in batches:
                for side, packed, at, total in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True):
                    if side == 0:
                        if p is not None:
                            yield from scored(p, counts)
                        p, counts = packed, np.ones(len(packed["words"]) // 8)
                    else:
                        counts[np.frombuffer(at, dtype="<u4")] = np.frombuffer(total, dtype="<i8")
            if p is not None:
                yield from scored(p, counts)

        return emitted(found(), out)

    dealt = whole.repartition("block").sortWithinPartitions("block", "side")
    mean = F.when(F.col("n_words") > 0, F.col("log_prob") / F.col("n_words"))
    return dealt.mapInArrow(run, "key long, n_words long, log_prob double").select(F.col("key").alias(key), "n_words", "log_prob", mean.alias("mean_log_prob"), F.exp(-mean).alias("perplexity"))
