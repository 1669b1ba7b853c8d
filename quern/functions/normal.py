"""Normal forms that the JVM has no function for, in Arrow batches."""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

_END = re.compile(r"[\s?!.]+\Z")


def question_text(question: str) -> str:
    """Compatibility form, case folded, one blank between words, no closing marks; every word stays."""
    return _END.sub("", " ".join(unicodedata.normalize("NFKC", question).casefold().split()))


def question_key(question: Column) -> Column:
    @F.arrow_udf("string")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array((None if t is None else question_text(t) for t in texts.to_pylist()), type=pa.string())

    return run(question)
