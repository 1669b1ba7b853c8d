"""Operator 10: toxicity by a convolutional text classifier.

A word is the sum of hashed embeddings: of itself and of its beginnings of three to five bytes, so that unseen inflections
share what their stem taught. Filters of several widths slide over the words, the largest answer of each filter over the
whole text is kept, and a logistic layer weighs them. All of it is trained here in numpy, by Adagrad on a bounded sample of
labelled rows. A part of the sample is set aside to calibrate: each language, told by its function words in the text itself,
gets the threshold with the best F1, and scores are shifted so that every threshold lies at 0.7.

Training gathers at most `positives` + `negatives` texts on the driver, chosen by a hash of the id, none of them longer than
`longest` characters (120 MB in all at most); scoring is one narrow pass over whole texts of any length. Only the text enters
a score. A language has a threshold of its own if 20 toxic and 20 other texts of the part set aside are in it; else, as for a
language that isn't told, the threshold of all holds.

Edge cases: a null id scores and is not held out; a null or empty text scores as a text without words; a text of any length is scored whole; rows without a label
train nothing; of several labels of one id the largest counts; without any positive or negative row every score is 0;
columns other than the key and the text are left out of the scores.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import Recent, emitted, rows, trimmed

#: Scores at or above it predict 1; calibration puts each language's threshold there.
THRESHOLD = 0.7
#: Bounds of the training sample, in rows, and in characters of a row.
POSITIVES, NEGATIVES, LONGEST = 2000, 4000, 20_000
BUCKETS, SIZE, FILTERS, WIDTHS, EPOCHS = 1 << 15, 16, 8, (1, 2, 3), 4
#: Common function words that tell the language of a text.
FUNCTION_WORDS = {
    "en": "the of and to in is that for it with was on are be this by not from or an as at",
    "fr": "le la les de des et est une un que qui dans pour sur pas avec du au elle en",
    "de": "der die das und ist nicht mit von für auf den dem ein eine zu im sich auch des",
    "es": "el la los las de que y en es una un por para con del su no se lo como",
}
_EDGE = re.compile(r"^\W+|\W+$")
_FOUR, _M = struct.Struct("<4i"), BUCKETS - 1
_NONE = _FOUR.pack(0, 0, 0, 0)


def features(word: str) -> bytes:
    """Hash buckets of a word and its beginnings, as four 32-bit numbers; bucket 0 stands for none."""
    if not word.isalnum():
        word = _EDGE.sub("", word)
    w = word.encode("utf-8", "surrogatepass")
    n = len(w)
    if not n:
        return _NONE
    return _FOUR.pack(1 + crc32(w) % _M, 1 + crc32(w[:3], 3) % _M if n > 3 else 0, 1 + crc32(w[:4], 4) % _M if n > 4 else 0, 1 + crc32(w[:5], 5) % _M if n > 5 else 0)


class Words:
    """Texts as rows of a small table of distinct words, with pads after each text."""

    def __init__(self):
        self.known = Recent()
        self.speech = {w: sum(1 << i for i, ws in enumerate(FUNCTION_WORDS.values()) if w in ws.split()) for ws in FUNCTION_WORDS.values() for w in ws.split()}

    def table(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Features of the distinct words (row 0: pad), word rows of all texts, where each text begins, and its language (-1: unknown)."""
        split = [t.lower().split() if t else [] for t in texts]
        words = set().union(*split)
        new = self.known.unknown(words)
        known = self.known.hand
        for w in new:
            known[w] = features(w)
        distinct = list(words)
        feats = np.frombuffer(_NONE + b"".join(map(known.__getitem__, distinct)), dtype="<i4").reshape(-1, 4)
        number = {w: i for i, w in enumerate(distinct, 1)}
        pads = [0] * (max(WIDTHS) - 1)
        flat: list[int] = []
        begins = []
        for ws in split:
            begins.append(len(flat))
            flat.extend(map(number.__getitem__, ws))
            flat.extend(pads)
        ids = np.array(flat, dtype=np.int64)
        begins = np.array(begins, dtype=np.int64)
        marks = np.array([0, *(self.speech.get(w, 0) for w in distinct)], dtype=np.int64)[ids]
        votes = np.stack([np.add.reduceat((marks >> i) & 1, begins) for i in range(len(FUNCTION_WORDS))], axis=1) if len(begins) else np.zeros((0, 4), int)
        speech = np.where(votes.max(axis=1, initial=0) > 0, votes.argmax(axis=1) if len(votes) else 0, -1)
        return feats, ids, begins, speech


@dataclass
class Model:
    embed: np.ndarray = field(default_factory=lambda: np.zeros((BUCKETS, SIZE), np.float32))
    filters: list[np.ndarray] = field(default_factory=list)  # of each width: (width, SIZE, FILTERS)
    bias: np.ndarray = field(default_factory=lambda: np.zeros(FILTERS * len(WIDTHS), np.float32))
    out: np.ndarray = field(default_factory=lambda: np.zeros(FILTERS * len(WIDTHS), np.float32))
    shift: float = 0.0
    thresholds: dict[int, float] = field(default_factory=dict)
    trained: bool = False

    def answers(self, feats: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """What every filter says of the words from every word on; nothing where none begins."""
        vectors = self.embed[feats].sum(axis=1)
        answer = np.empty((len(ids), len(self.bias)), np.float32)
        for k, w in enumerate(self.filters):
            z = (vectors @ w[0])[ids]
            for j in range(1, len(w)):
                z[:-j] += (vectors @ w[j])[ids[j:]]
            answer[:, k * FILTERS : (k + 1) * FILTERS] = z
        answer[ids == 0] = -np.inf  # windows that begin at a pad would see the next text
        return answer

    def logits(self, feats: np.ndarray, ids: np.ndarray, begins: np.ndarray) -> np.ndarray:
        if not len(begins):
            return np.zeros(0)
        pooled = np.maximum(np.maximum.reduceat(self.answers(feats, ids), begins, axis=0) + self.bias, 0)
        return (pooled @ self.out + self.shift).astype(np.float64)

    def scores(self, feats: np.ndarray, ids: np.ndarray, begins: np.ndarray, speech: np.ndarray) -> np.ndarray:
        if not self.trained:
            return np.zeros(len(begins))
        at = np.array([self.thresholds.get(int(s), self.thresholds[-1]) for s in speech])
        z = self.logits(feats, ids, begins) - at + np.log(THRESHOLD / (1 - THRESHOLD))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _log_odds(texts: list[str], toxic: np.ndarray) -> np.ndarray:
    """How much likelier each bucket is in a toxic text, drawn towards nothing where it is rare."""
    seen = np.zeros((2, BUCKETS))
    words = Words()
    for t, y in zip(texts, toxic, strict=True):
        feats, _, _, _ = words.table([t])
        seen[int(y), np.unique(feats[1:])] += 1
    share = (seen.sum(axis=0) / len(texts)) * 4
    odds = np.log((seen[1] + 0.1 + share) / (toxic.sum() + 4)) - np.log((seen[0] + 0.1 + share) / ((1 - toxic).sum() + 4))
    odds[seen.sum(axis=0) < 3] = 0
    odds[0] = 0
    return np.clip(odds, -3, 3)


def train(texts: list[str], labels: list[int], seed: int = 7, epochs: int = EPOCHS) -> Model:
    """A model from texts and their labels; every fifth text calibrates instead of training."""
    rng = np.random.default_rng(seed)
    y = np.array(labels, dtype=np.float64)
    model = Model()
    fit = np.array([zlib.crc32((t or "").encode("utf-8", "surrogatepass")) % 5 != 0 for t in texts], dtype=bool)
    if not 0 < y[fit].sum() < fit.sum():
        return model
    model.trained = True
    model.embed = rng.normal(0, 0.02, (BUCKETS, SIZE)).astype(np.float32)
    model.embed[:, 0] = 0.3 * _log_odds([t for t, f in zip(texts, fit, strict=True) if f], y[fit])
    model.embed[0] = 0
    model.filters = [rng.normal(0, 0.2, (w, SIZE, FILTERS)).astype(np.float32) for w in WIDTHS]
    for w in model.filters:
        w[0, 0] = np.abs(w[0, 0]) + 0.5
    model.out = np.full(len(model.bias), 1.0 / len(model.bias), np.float32)
    model.shift = -1.0
    state: dict[str, np.ndarray] = {}

    def step(name: str, value: np.ndarray, slope: np.ndarray, rate: float = 0.05) -> None:
        total = state.setdefault(name, np.full(value.shape, 1e-2, np.float32))
        total += slope * slope
        value -= (rate * slope / np.sqrt(total)).astype(np.float32)

    words, train_at = Words(), np.flatnonzero(fit)
    weight = np.where(y > 0, 0.5 / max(y[fit].mean(), 1e-9), 0.5 / max(1 - y[fit].mean(), 1e-9))
    for _ in range(epochs):
        rng.shuffle(train_at)
        for k in range(0, len(train_at), 32):
            some = train_at[k : k + 32]
            feats, ids, begins, _ = words.table([texts[i] for i in some])
            answer = model.answers(feats, ids)
            ends = [*begins[1:], len(ids)]
            best = np.stack([b + answer[b:e].argmax(axis=0) for b, e in zip(begins, ends, strict=True)])  # text, filter
            raw = np.take_along_axis(answer, best, axis=0) + model.bias
            pooled = np.maximum(raw, 0)
            p = 1 / (1 + np.exp(-np.clip(pooled @ model.out + model.shift, -30, 30)))
            slope = ((p - y[some]) * weight[some] / len(some)).astype(np.float32)
            back = np.where(raw > 0, slope[:, None] * model.out[None], 0).astype(np.float32)
            step("out", model.out, pooled.T @ slope)
            model.shift -= 0.1 * float(slope.sum())
            step("bias", model.bias, back.sum(axis=0))
            vectors = model.embed[feats].sum(axis=1)
            change = np.zeros_like(vectors)
            for n, w in enumerate(model.filters):
                own = slice(n * FILTERS, (n + 1) * FILTERS)
                grad = np.zeros_like(w)
                for j in range(len(w)):
                    at = best[:, own] + j
                    inside = at < len(ids)
                    word, g = ids[np.minimum(at, len(ids) - 1)], np.where(inside, back[:, own], 0)
                    grad[j] = np.einsum("tfs,tf->sf", vectors[word], g)
                    np.add.at(change, word.ravel(), (g[:, :, None] * w[j].T[None]).reshape(-1, SIZE))
                step(f"w{n}", w, grad)
            touched = np.flatnonzero(change.any(axis=1))
            touched = touched[touched > 0]
            buckets, where = np.unique(feats[touched], return_inverse=True)
            summed = np.zeros((len(buckets), SIZE), np.float32)
            np.add.at(summed, where.reshape(-1), np.repeat(change[touched], feats.shape[1], axis=0))
            total = state.setdefault("embed", np.full(model.embed.shape, 1e-2, np.float32))
            total[buckets] += summed * summed
            model.embed[buckets] -= 0.02 * summed / np.sqrt(total[buckets])
            model.embed[0] = 0
    _calibrate(model, [t for t, f in zip(texts, fit, strict=True) if not f], y[~fit])
    return model


def _best(z: np.ndarray, y: np.ndarray) -> float:
    """The middle of the gap between scores that gives the best F1."""
    order = np.argsort(z)
    z, y = z[order], y[order]
    caught = y.sum() - np.concatenate([[0], np.cumsum(y)])  # positives at or above each place
    taken = len(y) - np.arange(len(y) + 1)
    f1 = 2 * caught / np.maximum(taken + y.sum(), 1)
    places = np.flatnonzero(f1 >= f1.max() - 1e-12)
    low = np.concatenate([[z[0] - 2], z])[places]
    high = np.concatenate([z, [z[-1] + 2]])[places]
    k = int((high - low).argmax())
    return float((low[k] + high[k]) / 2)


def _calibrate(model: Model, texts: list[str], y: np.ndarray, least: int = 20) -> None:
    words, z, speech = Words(), [], []
    for k in range(0, len(texts), 64):
        feats, ids, begins, s = words.table(texts[k : k + 64])
        z.append(model.logits(feats, ids, begins))
        speech.append(s)
    z, speech = np.concatenate([*z, []]), np.concatenate([*speech, []])
    enough = lambda m: y[m].sum() >= least and (1 - y[m]).sum() >= least
    model.thresholds = {-1: _best(z, y) if len(y) and 0 < y.sum() < len(y) else 0.0}
    for s in set(speech.tolist()) - {-1}:
        if enough(m := speech == s):
            model.thresholds[int(s)] = _best(z[m], y[m])


def held_out(key: Column) -> Column:
    """Whether a row's label must not be learned from: crc32 of the id as text, modulo 3, is 1. A null id, which no label has, is not."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", positives: int = POSITIVES, negatives: int = NEGATIVES, longest: int = LONGEST) -> DataFrame:
    """text, label of at most so many labelled rows of each kind that may be learned from, chosen by a hash of the id."""
    known = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull() & ~held_out(F.col(key))).groupBy(F.col(key).cast("long").alias("key")).agg(F.max(label).alias("label"))
    order = [F.xxhash64("key"), F.col("key")]
    chosen = known.where("label > 0").orderBy(*order).limit(positives).unionByName(known.where("label <= 0").orderBy(*order).limit(negatives))
    texts = docs.where(~held_out(F.col(key)) & (F.coalesce(F.length(text), F.lit(0)) <= longest)).select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    # at most positives + negatives ids: a bounded side; an id that stands in several rows gives one of them
    return texts.join(F.broadcast(chosen), "key").groupBy("key").agg(F.min_by(F.struct("text", "label"), F.coalesce("text", F.lit(""))).alias("row")).select("row.*", "key")


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", positives: int = POSITIVES, negatives: int = NEGATIVES) -> Model:
    found = sorted((r.key, r.text or "", int(r.label > 0)) for r in sample(docs, labels, key, text, label, positives, negatives).collect())
    return train([t for _, t, _ in found], [y for _, _, y in found])


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, score, language (as told from the text) of every row, by one narrow pass."""
    out = pa.schema([("key", pa.int64()), ("score", pa.float64()), ("language", pa.string())])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few MB at any size of input
    names = [*FUNCTION_WORDS, None]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, m = Words(), shared.value

        def scored() -> Iterator[tuple]:
            held: list[tuple] = []
            size = 0
            for row in rows(batches, "key", "text"):
                held.append(row)
                size += len(row[1] or "")
                if size >= 1 << 20 or len(held) >= 512:
                    yield from chunk(held)
                    held, size = [], 0
            yield from chunk(held)

        def chunk(held: list[tuple]) -> Iterator[tuple]:
            if held:
                feats, ids, begins, speech = words.table([t for _, t in held])
                yield from zip((k for k, _ in held), m.scores(feats, ids, begins, speech).tolist(), (names[s] for s in speech), strict=True)

        yield from emitted(scored(), out)
        words.known.clear()  # the worker lives on
        trimmed()

    chosen = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    return chosen.mapInArrow(run, "key long, score double, language string").withColumnRenamed("key", key)


def scorer(docs: DataFrame, model: Model):
    """The score as a function of a text column, for rows that keep their other columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def scored(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        words = Words()
        for some in texts:
            found: list[float] = []
            for at in range(0, len(some), 256):
                feats, ids, begins, speech = words.table(some.slice(at, 256).to_pylist())
                found += shared.value.scores(feats, ids, begins, speech).tolist()
            yield pa.array(found, type=pa.float64())
        words.known.clear()  # the worker lives on
        trimmed()

    return scored
