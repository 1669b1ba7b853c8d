"""Extension points: embedders, tools by name, and model calls that are given and not built in."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import vectors
from quern.operators.search import plain_lexemes

#: Texts of one call of an embedder.
BATCH = 128


def embedded(df: DataFrame, embed: Callable[[list[str]], list[list[float]]] | None = None, text: str = "text", to: str = "embedding") -> DataFrame:
    """Rows with a vector of their text. `embed` gets at most 128 texts and gives as many vectors, or it is an error; without
    one, tokens are hashed to a vector that is always the same."""
    if embed is None:
        return df.withColumn(to, vectors.hash_embedding(plain_lexemes(F.col(text))).cast("array<float>"))

    @F.arrow_udf("array<float>")
    def run(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in arrays:
            found: list[list[float]] = []
            for at in range(0, len(texts), BATCH):
                some = [t or "" for t in texts.slice(at, BATCH).to_pylist()]
                made = embed(some)
                if len(made) != len(some):
                    raise ValueError(f"{len(made)} vectors for {len(some)} texts")
                found += made
            yield pa.array(found, type=pa.list_(pa.float32()))

    return df.withColumn(to, run(F.col(text)))


@dataclass(frozen=True)
class Tool:
    """A tool: what calls (a DataFrame of its calls) give as context blocks, and how questions find it."""

    name: str
    run: Callable[[DataFrame], DataFrame]
    schema: dict[str, Any] = field(default_factory=dict)
    card: str = ""
    terms: tuple[str, ...] = ()


class Registry:
    """Tools by name."""

    def __init__(self, *tools: Tool):
        self.tools = {t.name: t for t in tools}
        if len(self.tools) != len(tools):
            raise ValueError("two tools of one name")

    def run(self, calls: DataFrame, failed: Callable[[str, Exception], None] | None = None) -> DataFrame | None:
        """The blocks of all calls (name, ...); a tool that fails gives none and is told to `failed`; unknown names give none."""
        found = None
        for name, tool in self.tools.items():
            try:
                blocks = tool.run(calls.where(F.col("name") == name))
            except Exception as e:
                if failed is None:
                    raise
                failed(name, e)
                continue
            found = blocks if found is None else found.unionByName(blocks, allowMissingColumns=True)
        return found


def called(df: DataFrame, model: Callable[[str], str], prompt: Column, to: str) -> DataFrame:
    """Rows with a given model's answer to a prompt, or the reason why there is none in `<to>_error`."""

    @F.arrow_udf("struct<answer:string,error:string>")
    def run(prompts: pa.Array) -> pa.Array:
        def one(p: str | None) -> dict[str, str | None]:
            try:
                return {"answer": None if p is None else model(p), "error": None}
            except Exception as e:
                return {"answer": None, "error": f"{type(e).__name__}: {e}"[:500]}

        return pa.array(map(one, prompts.to_pylist()), type=pa.struct([("answer", pa.string()), ("error", pa.string())]))

    return df.withColumn("_called", run(prompt)).withColumns({to: F.col("_called.answer"), f"{to}_error": F.col("_called.error")}).drop("_called")
