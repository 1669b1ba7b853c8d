"""Operator 2: byte-level BPE encoding and decoding.

The tiktoken library does the merges, from a local rank file and a pattern. Texts longer than `piece_chars` are first cut
where a character that is not white space meets one that is. No match of the pattern reaches over such a place, since white
space stands only at a match's start or in a match of its own, and the pattern looks no further back; so the parts' ids, in
order, are the text's ids, and memory follows the part.

Edge cases: a null or empty text gives no ids; a text without any such place is one part; special tokens' strings are
ordinary text; rows with equal ids or texts are each encoded; other columns of the input are left out of the result.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import rows

PIECE_CHARS = 1 << 16
#: Ids in a batch of rows that goes back to Spark.
BATCH_IDS = 1 << 19
_SAFE = regex.compile(r"(?<=\S)(?=\s)")


@functools.lru_cache(maxsize=4)
def encoding(rank_path: str, pattern: str):
    """The tiktoken encoding of a rank file, once per Python worker."""
    import tiktoken

    with open(rank_path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding(f"ranks:{rank_path}", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def parts(text: str, piece_chars: int = PIECE_CHARS) -> Iterator[str]:
    """The text in parts that can be encoded apart, each about `piece_chars` long or up to the next safe place."""
    start = 0
    while len(text) - start > piece_chars and (cut := _SAFE.search(text, start + piece_chars)):
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


def encode_text(text: str | None, rank_path: str, pattern: str, piece_chars: int = PIECE_CHARS) -> np.ndarray:
    """The ids of a text, without Python numbers in between."""
    coder = encoding(rank_path, pattern)
    each = [coder.encode_to_numpy(part, disallowed_special=()) for part in parts(text or "", piece_chars)]
    return (each[0] if len(each) == 1 else np.concatenate(each)).astype(np.int32)


def encode(docs: DataFrame, rank_path: str, pattern: str, key: str = "doc_id", text: str = "text", piece_chars: int = PIECE_CHARS) -> DataFrame:
    """key, tokens: each row's ids. One narrow pass, no shuffle."""
    out = pa.schema([("key", pa.int64()), ("tokens", pa.list_(pa.int32()))])

    def batch(keys: list, ids: list[np.ndarray]) -> pa.RecordBatch:
        ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array(keys, type=pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids)))], schema=out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, ids, size = [], [], 0
        for k, t in rows(batches, "key", "text"):
            keys.append(k)
            ids.append(encode_text(t, rank_path, pattern, piece_chars))
            size += len(ids[-1])
            if size >= BATCH_IDS:
                yield batch(keys, ids)
                keys, ids, size = [], [], 0
        if keys:
            yield batch(keys, ids)

    chosen = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    return chosen.mapInArrow(run, "key long, tokens array<int>").withColumnRenamed("key", key)


def decode(tokens: DataFrame, rank_path: str, pattern: str, column: str = "tokens") -> DataFrame:
    """The same rows with `decoded`: the raw bytes of the ids, never repaired or replaced; null ids count as none."""

    @F.arrow_udf("binary")
    def decoded(ids: pa.Array) -> pa.Array:
        join = encoding(rank_path, pattern).decode_bytes
        return pa.array((join(x.as_py() or []) for x in ids), type=pa.binary())  # a row's numbers at a time

    return tokens.withColumn("decoded", decoded(F.col(column)))
