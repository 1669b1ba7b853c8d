"""Order-dependent folds: a state per key, moved on by each row in order. In batch and as a stateful stream.

In batch, rows are dealt by key and sorted, and a task passes over them once with one state in hand, so that a key with a
third of all rows needs no more memory than any other.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues
from pyspark.sql.types import StructField, StructType

from quern.shipping import ensure

Step = Callable[[Any, dict], tuple[Any, list[dict]]]


def fold(df: DataFrame, key: str, order: list[str], start: Callable[[], Any], step: Step, end: Callable[[Any, Any], list[dict]] | None, schema: str, names: list[str]) -> DataFrame:
    """Rows that `step` (state, row -> state, rows out) and `end` (key, state -> rows out) give for each key, in order."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, state, begun = None, None, False
        out: list[dict] = []
        for frame in frames:
            for row in frame.astype(object).where(frame.notna(), None).to_dict("records"):
                if not begun or row[key] != held:
                    if begun and end:
                        out += end(held, state)
                    held, state, begun = row[key], start(), True
                state, made = step(state, row)
                out += made
            if len(out) > 5000:
                yield pd.DataFrame(out, columns=names)
                out = []
        if begun and end:
            out += end(held, state)
        yield pd.DataFrame(out, columns=names)

    return df.repartition(key).sortWithinPartitions(key, *order).mapInPandas(run, schema)


@dataclass(frozen=True)
class Fold:
    """A fold as a stream runs it: the step, and how its state is kept.

    `pack` gives a state as rows of `entries` (a DDL), `unpack` takes it from them, and `until` tells the millisecond from
    which on the state is as good as a new one, or None if it is so already.
    """

    start: Callable[[], Any]
    step: Step
    entries: str
    pack: Callable[[Any], list[tuple]]
    unpack: Callable[[list[tuple]], Any]
    until: Callable[[Any], int | None]


class OrderedFold(StatefulProcessor):
    """Rows of a key wait in a list until the watermark has passed them, and are then folded in order, whichever micro-batches
    they came with; timers of event time call for them, and end a state when its time is over."""

    def __init__(self, fold_: Fold, columns: list[str], waiting: StructType, order: list[str], names: list[str]):
        self.fold, self.columns, self.schema, self.order, self.names = fold_, columns, waiting, order, names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.schema)
        self.state = handle.getListState("state", self.fold.entries)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        new = [tuple(r) for frame in rows for r in frame[self.columns].astype(object).where(frame[self.columns].notna(), None).itertuples(index=False)]
        if new:
            self.waiting.appendList(new)
            self.handle.registerTimer(min(r[0] for r in new))
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        rows = [dict(zip(self.columns, r, strict=True)) for r in self.waiting.get()] if self.waiting.exists() else []
        ready = sorted((r for r in rows if r[AT] <= now), key=lambda r: tuple(r[c] for c in self.order))
        state = self.fold.unpack(list(self.state.get()) if self.state.exists() else []) if ready or self.state.exists() else None
        out: list[dict] = []
        for row in ready:
            state, made = self.fold.step(state, row)
            out += made
        if ready:
            later = [tuple(r[c] for c in self.columns) for r in rows if r[AT] > now]
            if later:
                self.waiting.put(later)
                self.handle.registerTimer(min(r[0] for r in later))
            else:
                self.waiting.clear()
        if state is not None:
            until = self.fold.until(state)
            if until is None or until <= now:
                self.state.clear()
            else:
                self.state.put(self.fold.pack(state))
                self.handle.registerTimer(until)
        if out:
            yield pd.DataFrame(out, columns=self.names)


#: The event time of a waiting row, in milliseconds. Names of columns here don't begin with an underscore: such lose their names on the way.
AT = "event_ms"


def ordered_stream(df: DataFrame, key: str, order: list[str], at: Column, fold_: Fold, schema: str, names: list[str], late: str) -> DataFrame:
    """The fold over a stream: rows in order of `at` (a timestamp) and then of `order`, as far as the watermark has come.

    A row that comes more than `late` after later ones is dropped; rows without a time are too. What a row gives comes once
    the watermark has passed it, so results are those of the batch form over all rows that weren't late. Needs the RocksDB
    state store, which is set for the session.
    """
    spark = ensure(df.sparkSession)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    told = df.withColumn("event_time", at).where("event_time is not null").withColumn(AT, F.unix_millis("event_time")).withWatermark("event_time", late)
    columns = [AT, *(c for c in df.columns if c != key)]
    waiting = StructType([StructField(c, told.schema[c].dataType) for c in columns])
    processor = OrderedFold(fold_, columns, waiting, [AT, *order], names)
    return told.groupBy(key).transformWithStateInPandas(processor, schema, "append", "EventTime")
