"""From raw documents to packed training windows, in stages that each call one operator of the training-data subpackage.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns what the next one takes as docs. All but
the last return the columns of `documents`.

Stages decide about rows, not ids: rows that share an id, or have none, are told apart by numbers of their own, so that each
is kept, cut or dropped for its own text. Ids are whole numbers. Equal rows are copies of each other: the near-duplicate stage
keeps one. Texts that are null or empty go in the first stage. An empty table gives an empty table in every stage. Columns beside those
of `documents`, whatever they are called, come through unchanged until packing, which leaves them out.
"""

from __future__ import annotations

import atexit
import functools
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import packing, quality, simhash, substring, toxicity
from quern.llm.common import dropped, gone, keyed, read, written
from quern.shipping import ensure

PIECE_BPE = public_tokenizers.path("piece_bpe_32k.model")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def _sent(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """The stage, run in a session whose workers have the package."""

    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        return stage(ensure(spark), docs, sf_dir)

    return run_stage


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the fertility bands reject go."""
    rows, own = keyed(docs)
    return rows.join(quality.rate(rows, PIECE_BPE, own).where("kept").select(own), own, "left_semi").drop(own)


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go."""
    score = toxicity.scorer(docs, toxicity.fit(docs, read(spark, sf_dir, "labels")))
    scored = docs.select(F.struct("*").alias("doc"), score(F.col("text")).alias("score"))
    return scored.where(F.col("score") < toxicity.THRESHOLD).select("doc.*")


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the least id stays."""
    rows, own = keyed(docs)
    copies = simhash.near_duplicates(rows, own).where(F.col(own) != F.col("component_id")).select(own)
    return rows.join(copies, own, "left_anti").drop(own)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document holds are cut out; documents of which no word is left go."""
    rows, own = keyed(docs)
    left = substring.remove(rows, substring.passages(rows, own), own).drop(own)
    return left.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else left


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of windows of 2048 tokens with their ids."""
    return packing.pack(docs, WORD_BPE, size=2048, end_id=1)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", _sent(quality_rules)),
    ("toxicity", _sent(toxicity_filter)),
    ("simhash", _sent(simhash_dedup)),
    ("substring", _sent(substring_dedup)),
    ("packing", _sent(pack_windows)),
]

#: SQL has no tokenizers, trained classifiers or alignments; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each result is a Parquet table in the shared folder before the next stage reads it.

    A table goes when the next one is there; the last stage's input stays until the driver ends, as its result is read later.
    """
    docs, before = read(spark, sf_dir, "documents", deal=False), None
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs, path = written(docs)
            if before is not None:
                dropped(spark, before)
            before = path
    atexit.register(gone, spark, before)
    return docs
