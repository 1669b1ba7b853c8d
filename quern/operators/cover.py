"""The text leg by cover density: chunks that a web-style query matches, by how closely its words stand.

A query is alternatives joined by `or`; an alternative is parts that must all be there: words, "phrases in quotes" (and words that
an analyser takes apart), and parts after a minus that must not be. The rank is PostgreSQL's ts_rank_cd without normalisation:
the sum over covers, the least spans that match, of their entries' mean weight over one plus the words between that aren't the query's.

A chunk's places of the query's words are swept once in order. Each part keeps where it was last begun; an alternative's
span begins at the earliest of these, and the best alternative's begin makes a cover when it has moved on. So the work at a place
hangs on the query's parts, not on the places before.

A first pass counts the chunks of the words that must be there. A second looks only at chunks with an alternative's rarest one,
where every match is; a word that every chunk has leaves all chunks, whose places are shuffled once, not once a query.

A null or empty text or query matches nothing, and neither does a query of only what must not be there.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.streaming.groups import shared

#: What entries of the classes A to D weigh.
WEIGHTS = {"A": 1.0, "B": 0.4, "C": 0.2, "D": 0.1}
_PART = re.compile(r'(?P<no>-)?"(?P<phrase>[^"]*)"?|(?P<word>[^\s"]+)')

Part = tuple[bool, tuple[str, ...]]


def parts_of(query: str | None) -> list[tuple[int, bool, str]]:
    """Alternative, whether it must not be there, and text of each part of a web-style query."""
    found: list[tuple[int, bool, str]] = []
    alternative = 0
    for m in _PART.finditer(query or ""):
        word = m["word"]
        if word is not None and word.lower() == "or":
            alternative += bool(found) and found[-1][0] == alternative
            continue
        no = bool(m["no"]) or word is not None and word.startswith("-")
        found.append((alternative, no, m["phrase"] if word is None else word.lstrip("-") if no else word))
    return found


def density(alternatives: Iterable[list[Part]], entries: list[tuple[int, str, float]]) -> float | None:
    """The rank of a text with these entries (place, word, weight), or None if the query doesn't match it."""
    entries = sorted(entries)
    places = [p for p, _, _ in entries]
    there = {(p, w) for p, w, _ in entries}
    asked = [a for a in alternatives if any(not no for no, _ in a)]
    by_word: dict[str, list[int]] = {}
    for place, word, _ in entries:
        by_word.setdefault(word, []).append(place)
    found = {words: any(all((p + j, w) in there for j, w in enumerate(words)) for p in by_word.get(words[0], ())) for a in asked for _, words in a}
    if not any(all(found[words] != no for no, words in a) for a in asked):
        return None
    begun: dict[tuple[str, ...], int] = {}
    ends: dict[str, set[tuple[str, ...]]] = {}
    for a in asked:
        for _, words in a:
            ends.setdefault(words[-1], set()).add(words)
    inverse = [0.0]
    for _, _, weight in entries:
        inverse.append(inverse[-1] + 1 / weight)
    rank, last = None, -1
    for i, (place, word, _) in enumerate(entries):
        for words in ends.get(word, ()):
            start = place - len(words) + 1
            if all((start + j, w) in there for j, w in enumerate(words)):
                begun[words] = start
        best = -1
        for a in asked:
            begin = min(begun.get(words, -1) for no, words in a if not no)
            if begin >= 0 and not any(no and begun.get(words, -1) >= begin for no, words in a):
                best = max(best, begin)
        if best > last:
            last, first = best, bisect_left(places, best)
            noise = place - best - (i - first)
            rank = (rank or 0.0) + (i - first + 1) / (inverse[i + 1] - inverse[first]) / (1 + (noise if noise >= 0 else (i - first) // 2))
    return rank


def ranks(queries: DataFrame, chunks: DataFrame, analyse: Callable[[Column], Column], few: Callable[[DataFrame], DataFrame], key: str = "id", fields: dict[str, str] | None = None) -> DataFrame:
    """query_id, id, score of the chunks that match; fields are columns with their class, searched as one text in that order."""

    @F.arrow_udf("array<struct<alternative:int,no:boolean,text:string>>")
    def told(texts: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("alternative", pa.int32()), ("no", pa.bool_()), ("text", pa.string())]))
        return pa.array([[{"alternative": a, "no": n, "text": t} for a, n, t in parts_of(x)] for x in texts.to_pylist()], kind)

    @F.arrow_udf("double")
    def score(asked: pa.Array, entries: pa.Array) -> pa.Array:
        out = []
        for a, e in zip(asked, entries, strict=True):
            alternatives: dict[int, list[Part]] = {}
            for p in a.as_py():
                alternatives.setdefault(p["alternative"], []).append((p["no"], tuple(p["words"])))
            own = {w for parts in alternatives.values() for _, words in parts for w in words}
            out.append(density(alternatives.values(), [(x["place"], x["lexeme"], x["weight"]) for x in e.as_py() if x["lexeme"] in own]))
        return pa.array(out, pa.float64())

    parts = queries.select("query_id", F.explode(told("query")).alias("p")).select("query_id", "p.alternative", "p.no", analyse(F.col("p.text")).alias("words")).where("size(words) > 0")
    shared(queries.sparkSession)
    parts = parts.checkpoint()  # the queries: read several times below
    asked = few(parts.groupBy("query_id").agg(F.collect_list(F.struct("alternative", "no", "words")).alias("asked")))
    columns = fields or {"text": "C"}
    words = {c: analyse(F.coalesce(F.col(c), F.lit(""))) for c in columns}

    # an alternative's chunks are among those of its rarest word, so only these are looked at
    must = parts.where("not no").select("query_id", "alternative", F.explode("words").alias("lexeme")).distinct()
    held = chunks.select(F.col(key).alias("id"), F.explode(F.array_distinct(F.flatten(F.array(*words.values())))).alias("lexeme"))
    counts = held.join(few(must.select("lexeme").distinct()), "lexeme", "left_semi").groupBy("lexeme").agg(F.count("*").alias("n"))
    counted = must.join(counts, "lexeme", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    rarest = counted.groupBy("query_id", "alternative").agg(F.min(F.struct("n", "lexeme")).alias("least")).where("least.n > 0")
    rarest = rarest.select("query_id", F.col("least.lexeme").alias("lexeme")).distinct().checkpoint()
    pairs = held.join(few(rarest), "lexeme").select("query_id", "id").distinct().checkpoint()

    def placed(column: str, before: Column) -> Column:
        return F.transform(words[column], lambda w, i: F.struct((i + before).alias("place"), w.alias("lexeme"), F.lit(WEIGHTS[columns[column]]).alias("weight")))

    spots, before = [], F.lit(0)
    for c in columns:
        spots.append(placed(c, before))
        before = before + F.size(words[c])
    looked = few(parts.join(pairs.select("query_id").distinct(), "query_id", "left_semi").select(F.explode("words").alias("lexeme")).distinct())
    near = chunks.join(few(pairs.select(F.col("id").alias(key)).distinct()), key, "left_semi")
    every = near.select(F.col(key).alias("id"), F.explode(F.flatten(F.array(*spots))).alias("s")).select("id", "s.*").join(looked, "lexeme", "left_semi")
    # a chunk's places meet its queries once they are together, so they are shuffled once and not for each query
    entries = every.groupBy("id").agg(F.collect_list(F.struct("place", "lexeme", "weight")).alias("entries"))
    return pairs.join(entries, "id").join(asked, "query_id").select("query_id", "id", score("asked", "entries").alias("score")).where("score is not null")
