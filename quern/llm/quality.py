"""Operator 8: quality rules by tokeniser fertility.

A public vocabulary with byte fallback encodes every word of a text; three measures follow: characters per token, the share
of byte-fallback tokens, and the entropy of the text's tokens in bits. Each language (or script, where no language is given)
has a band for each measure and each octave of length: the median over all of its texts, give or take the larger of a share
of it and a term that shrinks with the root of a text's tokens, since short texts scatter. A text outside a band of its
language is rejected.

Beside them stand plain counts: words, characters in words, symbols, repeated lines and words in repeated 5-word windows.
Base rules reject texts with too few words or too large a share of words in repeated windows.

One narrow pass over the texts measures them; medians come from Spark's mergeable quantile sketch over all rows, so that they
are exact to a rank in two thousand, and a text that close to an edge may be judged otherwise when rows are dealt otherwise; a language
with a third of all rows is summed before the shuffle like any other.

Edge cases: a null or empty text has no words, fails the base rules and stays out of the bands; a null language goes by the
script of its text's letters; a length
with fewer than `least` texts of a language goes by the whole language, or for entropy by the nearest length; a language with
fewer goes by its texts' scripts, and a script with fewer by all texts, however few; equal rows are each measured; other columns are left out of the measures and untouched by `keep`.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import Recent, byte_words, checkpointed, emitted, rows, trimmed

#: Fixed values of the base rules.
WINDOW, LEAST_WORDS, MOST_REPEATED_PERCENT = 5, 10, 20
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\v\f\r"
#: Measures, and how far from the median a text may be: the larger of a share of the median and a term over the root of its
#: tokens; the last says whether the upper side counts, the lower, or both.
BANDS = {"chars_per_token": (0.06, 8.0, "both"), "byte_share": (1.0, 2.0, "upper"), "entropy": (0.11, 6.0, "lower")}
#: The least number of texts that a band of its own takes.
LEAST = 30
#: Rows of a table that may be broadcast, after a count; files of the tables of bands, a few rows for each language.
SMALL, MOST_FILES = 20_000, 8


@functools.cache
def _script_table() -> tuple[np.ndarray, list[str]]:
    """For each 16-bit code unit the number of its script, 0 for what is no letter; the scripts' names."""
    names, table = ["other"], np.zeros(1 << 16, dtype=np.uint8)
    number: dict[str, int] = {}
    for c in range(1 << 16):
        if (x := chr(c)).isalpha() and (first := unicodedata.name(x, "").split(" ")[0].split("-")[0].lower()) and len(number) < 250:
            table[c] = number.setdefault(first, len(number) + 1)
    return table, names + list(number)


def script(text: str) -> str:
    """The script that most of a text's letters belong to, as the letters' names begin; "other" if it has none."""
    table, names = _script_table()
    each = np.bincount(table[np.frombuffer(text.encode("utf-16-le", "surrogatepass"), dtype="<u2")], minlength=len(names))
    each[0] = 0
    return names[int(each.argmax())]


class Vocabulary:
    """Tokens of words by a sentencepiece model, each distinct word encoded once."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes = np.array([self.model.is_byte(i) for i in range(self.model.get_piece_size())])
        self.known = Recent()

    def tokens(self, texts: list[list[bytes]]) -> list[np.ndarray]:
        if new := self.known.unknown(set().union(*texts)):
            for w, ids in zip(new, self.model.encode([w.decode("utf-8", "replace") for w in new], num_threads=1), strict=True):
                self.known.hand[w] = np.array(ids, dtype="<i4").tobytes()
        get = self.known.hand.__getitem__
        return [np.frombuffer(b"".join(map(get, ws)), dtype="<i4") for ws in texts]


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    """The vocabulary of a model file, once per Python worker."""
    return Vocabulary(path)


def repeated_words(ids: np.ndarray, window: int = WINDOW) -> int:
    """Words that lie in windows found twice or more, each word once. ids: small numbers, equal for equal words."""
    n = len(ids) - window + 1
    if n < 2:
        return 0
    k = int(ids.max()) + 1
    if k**window < 1 << 63:
        key = ids[:n].astype(np.int64)
        for i in range(1, window):
            key = key * k + ids[i : i + n]
    else:  # pairs of ranks keep the numbers small, and equal numbers still mean equal windows
        key = ids[:n].astype(np.int64)
        for i in range(1, window):
            key = np.unique(key, return_inverse=True)[1] * k + ids[i : i + n]
    order = np.sort(key)
    if not (twice := order[1:][order[1:] == order[:-1]]).size:
        return 0
    begins = np.zeros(len(ids) + 1, dtype=np.int64)
    found = np.flatnonzero(np.isin(key, twice))
    begins[found] += 1
    begins[found + window] -= 1  # several windows may end at one place, but each begins at its own
    return int((np.cumsum(begins)[:-1] > 0).sum())


def base_counts(text: str, ws: list[bytes]) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    chars = len(text) - sum(map(text.count, SPACES))
    seen: set[str] = set()
    lines = dup = 0
    for line in text.split("\n"):
        if line.strip(SPACES):
            lines += 1
            seen.add(line)
    dup = lines - len(seen)
    number = {w: i for i, w in enumerate(dict.fromkeys(ws))}
    ids = np.fromiter(map(number.__getitem__, ws), dtype=np.int64, count=len(ws))
    return len(ws), chars, sum(map(text.count, SYMBOLS)), dup, repeated_words(ids)


def fertility(tokens: np.ndarray, chars: int, byte: np.ndarray) -> tuple[int, float | None, float | None, float | None]:
    """n_tokens, chars_per_token, byte_share, entropy in bits; nulls without tokens."""
    if not (n := len(tokens)):
        return 0, None, None, None
    each = np.bincount(tokens)
    each = each[each > 0] / n
    return n, chars / n, float(byte[tokens].mean()), float(-(each * np.log2(each)).sum())


def measure(docs: DataFrame, model_path: str, key: str = "doc_id", text: str = "text", lang: str | None = "lang") -> DataFrame:
    """key, lang, script, the five counts, n_tokens and the three measures of every whole text."""
    out = pa.schema([("key", pa.int64()), ("lang", pa.string()), ("script", pa.string()), *((c, pa.int64()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_tokens")), *((c, pa.float64()) for c in BANDS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(model_path)

        def measured() -> Iterator[tuple]:
            for batch in batches:
                for at in range(0, batch.num_rows, 200):
                    some = [(k, g, t or "") for k, g, t in rows([batch.slice(at, 200)], "key", "lang", "text")]
                    split = [byte_words(t) for _, _, t in some]
                    for (k, g, t), ws, ids in zip(some, split, v.tokens(split), strict=True):
                        counts = base_counts(t, ws)
                        yield k, g, script(t), *counts, *fertility(ids, counts[1], v.bytes)

        yield from emitted(measured(), out)
        v.known.clear()  # the worker lives on
        trimmed()

    chosen = docs.select(F.col(key).cast("long").alias("key"), (F.col(lang) if lang else F.lit(None)).cast("string").alias("lang"), F.col(text).alias("text"))
    ddl = "key long, lang string, script string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_tokens long, chars_per_token double, byte_share double, entropy double"
    return chosen.mapInArrow(run, ddl).withColumnRenamed("key", key)


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))


def bands(measured: DataFrame, least: int = LEAST) -> DataFrame:
    """level, group, octave (null: all lengths), n and the medians of the measures over the texts that pass the base rules.

    Level 0 has the languages (scripts, for texts without one), 1 the scripts, 2 all texts; the first two only where there are
    `least` texts, the last always.
    """
    usable = measured.where(~base_failed() & (F.col("n_tokens") > 0)).select(F.explode(_levels(_group(), F.col("script"))).alias("at"), _octave().alias("octave"), *BANDS).select("at.*", "octave", *BANDS)
    # whole groups from the same sketches as their octaves: one pass, one shuffle of partial sketches
    each = usable.rollup("level", "group", "octave").agg(F.count("*").alias("n"), *(F.percentile_approx(c, 0.5, 2_000).alias(f"mid_{c}") for c in BANDS))
    return checkpointed(each.where(F.col("group").isNotNull() & ((F.col("n") >= least) | (F.col("level") == 2))).coalesce(MOST_FILES))


def _group() -> Column:
    return F.coalesce(F.concat(F.lit("lang "), "lang"), F.concat(F.lit("script "), "script"))


def _levels(group: Column, script_: Column) -> Column:
    return F.array(*(F.struct(F.lit(i).alias("level"), g.alias("group")) for i, g in enumerate((group, script_, F.lit("all")))))


def _octave() -> Column:
    # of words: tokens and characters would give texts in a strange script lengths of their own
    return F.floor(F.log2(F.greatest("n_words", F.lit(1))))


def resolved(asked: DataFrame, limits: DataFrame) -> DataFrame:
    """_group, script, octave and the mids that hold for them: of the first level that has some.

    Within a level the octave's own come before the whole group's. Entropy grows with length: it comes from the nearest
    shorter octave, which longer texts don't fall below, else from the nearest longer one in proportion
    to the octaves, at two tokens a word.
    """
    key = ["_group", "script", "octave"]
    levels = asked.select(*key, F.explode(_levels(F.col("_group"), F.col("script"))).alias("at")).select(*key, "at.*")
    some = levels.join(limits.withColumnRenamed("octave", "of"), ["level", "group"])
    plain = [c for c in BANDS if c != "entropy"]
    own = F.when(F.col("of").isNull() | (F.col("of") == F.col("octave")), F.struct("level", F.col("of").isNull()))
    near = F.when(F.col("of").isNotNull(), F.struct("level", F.col("of") > F.col("octave"), F.abs(F.col("of") - F.col("octave"))))
    entropy = F.when(F.col("of") > F.col("octave"), F.col("mid_entropy") * (F.col("octave") + 1) / (F.col("of") + 1)).otherwise(F.col("mid_entropy"))
    return some.groupBy(*key).agg(*(F.min_by(f"mid_{c}", own).alias(f"mid_{c}") for c in plain), F.min_by(entropy, near).alias("mid_entropy"))


def judge(measured: DataFrame, limits: DataFrame) -> DataFrame:
    """The measured rows with base_failed and kept."""
    told = measured.withColumns({"_group": _group(), "octave": _octave()})
    key = ["_group", "script", "octave"]
    mids = checkpointed(resolved(told.select(*key).distinct(), limits).coalesce(MOST_FILES))
    # a few rows for each language and script; counted, and only if few does every task get them instead of a shuffle by language
    found = told.join(F.broadcast(mids) if mids.limit(SMALL + 1).count() <= SMALL else mids, key, "left")
    root = F.sqrt(F.greatest("n_tokens", F.lit(1)))
    inside = F.lit(True)
    for c, (share, scatter, side) in BANDS.items():
        mid = F.col(f"mid_{c}")
        off = F.col(c) - mid
        off = {"both": F.abs(off), "upper": off, "lower": -off}[side]
        inside = inside & F.coalesce(off <= F.greatest(mid * share, scatter / root), F.lit(True))  # null only without tokens
    return found.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & inside).drop("_group")


def rate(docs: DataFrame, model_path: str, key: str = "doc_id", text: str = "text", lang: str | None = "lang") -> DataFrame:
    """Measures, base_failed and kept of every document; bands come from the documents themselves."""
    measured = checkpointed(measure(docs, model_path, key, text, lang))
    return judge(measured, bands(measured))
