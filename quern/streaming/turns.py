"""Folding a run's events into turns and threads, emitting them, and writing each run's ledger row once."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.sources.feeds import sse_frame
from quern.streaming.folds import AT, Fold, fold, ordered_stream

#: The events that a client knows, and the states in which a turn runs.
EVENTS = ("step", "sources", "text", "done", "error")
RUNNING = ("pending", "streaming")
_TURN = "turn_id long, status string, answer string, steps array<string>, sources int, request_id string, error string"
_NAMES = ["turn_id", "status", "answer", "steps", "sources", "request_id", "error"]


def known_events(raw: DataFrame, column: str = "event") -> DataFrame:
    return raw.where(F.col(column).isin(*EVENTS))


def new_turn() -> dict[str, Any]:
    return {"status": "pending", "answer": "", "steps": [], "sources": 0, "request_id": None, "error": None}


def _put(steps: list[dict], data: Any) -> list[dict]:
    """Steps after one more: a completed one takes the place of the first that runs."""
    running = [i for i, s in enumerate(steps) if s["status"] == "running"] if data["status"] != "running" else []
    at = running[0] if running else len(steps)
    return [*steps[:at], data, *steps[at + 1 :]]


def _completed(steps: list[dict], data: Any) -> list[dict]:
    return [s for s in steps if s["status"] == "completed"]


@dataclass(frozen=True)
class Move:
    """What an event does: the status after it, what becomes of the steps, and fields from its data and the old values."""

    status: str
    steps: Callable[[list[dict], Any], list[dict]] | None = None
    fields: dict[str, Callable[[Any, Any], Any]] = field(default_factory=dict)
    revives: bool = True  # whether it also moves a turn that has failed


_FAILED = Move("failed", _completed, {"error": lambda old, data: data.get("error")})
MOVES: dict[str, Move] = {
    "step": Move("streaming", _put),
    "sources": Move("streaming", fields={"sources": lambda old, data: len(data)}),
    "text": Move("streaming", fields={"answer": lambda old, data: old + data}),
    "done": Move("settled", fields={"request_id": lambda old, data: data.get("request_id")}, revives=False),
    "settle": Move("settled", _completed, revives=False),
    "error": _FAILED,
    "fail": _FAILED,
}


def advance(turn: dict[str, Any], event: str, data: Any) -> dict[str, Any]:
    """The turn after an event; events without a move leave it."""
    move = MOVES.get(event)
    if move is None or turn["status"] == "failed" and not move.revives:
        return turn
    changed = {name: change(turn[name], data) for name, change in move.fields.items()}
    return {**turn, **changed, "status": move.status, "steps": move.steps(turn["steps"], data) if move.steps else turn["steps"]}


def _step(turn: dict, row: dict) -> tuple[dict, list[dict]]:
    return advance(turn, row["event"], json.loads(row["data"])), []


def _end(key: Any, turn: dict) -> list[dict]:
    return [{"turn_id": key, **turn, "steps": [f"{s['step']}:{s['status']}" for s in turn["steps"]]}]


def folded_turns(events: DataFrame) -> DataFrame:
    """A row per turn from its events (turn_id, seq, event, data as JSON), in order of seq."""
    return fold(known_events(events), "turn_id", ["seq"], new_turn, _step, _end, _TURN, _NAMES)


def folded_turns_stream(events: DataFrame, at: str = "at", late: str = "1 minute", idle_seconds: int = 86_400) -> DataFrame:
    """The same over a stream of events that also have a time, in whose order (then that of seq) they are taken: the state of a
    turn after each of its events. A turn without events for `idle_seconds` is forgotten."""

    def step(held: dict, row: dict) -> tuple[dict, list[dict]]:
        turn, _ = _step(held["turn"], row)
        return {"turn": turn, "last": row[AT]}, _end(row["id"], turn)

    kept = Fold(
        lambda: {"turn": new_turn(), "last": None}, step, "turn string, last long", lambda s: [(json.dumps(s["turn"]), s["last"])],
        lambda e: {"turn": json.loads(e[0][0]), "last": e[0][1]} if e else {"turn": new_turn(), "last": None}, lambda s: None if s["last"] is None else s["last"] + 1000 * idle_seconds,
    )
    rows = known_events(events).select("turn_id", F.col("turn_id").alias("id"), "seq", "event", "data", F.col(at).alias("sent"))
    return ordered_stream(rows, "turn_id", ["seq"], F.col("sent"), kept, _TURN, _NAMES, late)


def folded_threads(actions: DataFrame) -> DataFrame:
    """tab_id, thread_id, turns, last_status from actions (tab_id, seq, action, data): the first question makes a thread, a
    failed last turn is replaced by the next question, and the server's id is learned when a run is done."""

    def step(t: dict | None, row: dict) -> tuple[dict | None, list[dict]]:
        data = json.loads(row["data"]) if row["data"] else {}
        if row["action"] == "ask":
            t = t or {"thread_id": None, "turns": []}
            turns = t["turns"][:-1] if t["turns"] and t["turns"][-1]["status"] == "failed" else t["turns"]
            return {**t, "turns": [*turns, new_turn()]}, []
        if t is None or not t["turns"]:
            return t, []
        known = data.get("thread_id") if row["action"] == "done" else t["thread_id"]
        return {"thread_id": known, "turns": [*t["turns"][:-1], advance(t["turns"][-1], row["action"], data)]}, []

    def end(key: Any, t: dict | None) -> list[dict]:
        return [] if t is None else [{"tab_id": key, "thread_id": t["thread_id"], "turns": len(t["turns"]), "last_status": t["turns"][-1]["status"]}]

    return fold(actions, "tab_id", ["seq"], lambda: None, step, end, "tab_id long, thread_id string, turns int, last_status string", ["tab_id", "thread_id", "turns", "last_status"])


def run_events(runs: DataFrame) -> DataFrame:
    """turn_id, seq, event, data of finished runs (turn_id, steps, sources, answer, request_id, error): each step as it
    starts and ends, sources once before the text, text in pieces, done or error last."""
    js = lambda c: F.to_json(c)
    event = lambda name, data: F.struct(F.lit(name).alias("event"), data.alias("data"))
    steps = F.flatten(F.transform("steps", lambda s: F.array(*(event("step", js(F.struct(s.alias("step"), F.lit(x).alias("status")))) for x in ("running", "completed")))))
    sources = F.when(F.size("sources") > 0, F.array(event("sources", js(F.col("sources"))))).otherwise(F.array().cast("array<struct<event:string,data:string>>"))
    words = F.filter(F.split(F.coalesce("answer", F.lit("")), "(?<= )"), lambda w: w != "")
    text = F.transform(words, lambda w: event("text", F.concat(F.lit('"'), F.regexp_replace(F.regexp_replace(w, r"([\\\"])", r"\\$1"), "\n", r"\\n"), F.lit('"'))))
    last = F.when(F.col("error").isNull(), event("done", js(F.struct("request_id")))).otherwise(event("error", js(F.struct("error"))))
    return runs.select("turn_id", F.posexplode(F.concat(steps, sources, text, F.array(last))).alias("seq", "e")).select("turn_id", "seq", "e.*")


def _unwritten(batch: DataFrame, path: str, number: int) -> DataFrame:
    """A batch's requests, each once, without those that earlier batches have written; the same at each attempt."""
    order = W.partitionBy("request_id").orderBy(F.xxhash64(*(F.to_json(F.struct(c)) for c in batch.columns)))
    once = batch.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")
    try:
        old = batch.sparkSession.read.parquet(path).where(F.col("batch") < number).select("request_id")
    except AnalysisException as e:  # the first batch finds no table yet
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        return once
    return once.join(old, "request_id", "left_anti")


def ledger_once(path: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch writer that leaves exactly one row per request_id, however often a batch is tried again.

    A batch's rows go to the folder of its number, which a repeated attempt overwrites.
    """

    def write(batch: DataFrame, number: int) -> None:
        _unwritten(batch, path, number).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def frames_once(path: str, ledger: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch writer of the frames of finished runs (as `run_events` takes them): turn_id, seq, event and frame, as a client
    is sent them, of requests that no earlier batch has in the ledger; a repeated attempt overwrites what it wrote."""

    def write(batch: DataFrame, number: int) -> None:
        events = run_events(_unwritten(batch, ledger, number))
        events.select("turn_id", "seq", "event", sse_frame(F.col("event"), F.col("data")).alias("frame")).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def answer_sink(frames: str, ledger: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch writer of both, frames first: a request is in the ledger only when its frames are there, and a batch that ends between
    the two is tried again as a whole."""
    first, last = frames_once(frames, ledger), ledger_once(ledger)

    def write(batch: DataFrame, number: int) -> None:
        first(batch, number)
        last(batch, number)

    return write


def sent_frames(spark: SparkSession, frames: str, ledger: str) -> DataFrame:
    """The frames of batches that have ended; what a broken attempt left isn't told."""
    ended = spark.read.parquet(ledger).select("batch").distinct()
    return spark.read.parquet(frames).join(F.broadcast(ended), "batch", "left_semi")  # a row a batch
