"""Operator 1: chat formatting with linked tool calls.

Messages are parsed for tool declarations, calls and results: a text that is a JSON object with `tools`, `tool_calls` or
`tool_call_id`, or <tool_call>{...}</tool_call> and <tool_result>{...}</tool_result> spans within a text. Calls and results
are hash-joined by conversation and identifier. An argument {"$ref": "<id>"} waits for the result of that call. Messages are
put in topological order: none before the calls and results it depends on, and else by turn. Arguments are validated
against the conversation's declared schemas, or those given, and each message becomes one line of canonical JSON (sorted
keys, no spaces, shortest numbers, no escapes but the needed ones).

The result has a row per message, so no conversation is ever gathered in one task. Orders come from the dependencies alone:
those of a conversation with at most `FEW` are sorted in one task, in one pass however long its chains are; conversations
with more go by rounds of joins, one for each step of their longest chain.

Edge cases: null ids form one conversation, null turns come first, null texts and roles stay null in the JSON; a text that
isn't such JSON is plain content, and so is one with numbers that JSON doesn't have (NaN, infinities, 1e999) or more than
`DEEP` levels; arguments of that kind count as broken; half surrogate pairs are escaped in arguments and replaced in contents, names and
identifiers; rules of a schema that aren't well formed say nothing, and a pattern that takes over a second counts as not
matched; of several calls with one identifier the first counts and the others are marked; results
without a call, and members of reference cycles and what waits for them, are marked and keep their turn's place; equal rows each keep a row; an empty table gives no rows; extra
columns are left out of the result. Conversation ids and turns are whole numbers.
"""

from __future__ import annotations

import json
import math
import re
from collections import deque
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import checkpointed, emitted, rows
from quern.llm.ranks import numbered
from quern.llm.tiles import runs

_SPAN = re.compile(r"<tool_(call|result)>(.*?)</tool_\1>", re.S)
_HALF = re.compile("[\ud800-\udfff]")
#: Dependencies of a conversation that one task sorts, and levels of JSON that are read.
FEW, DEEP = 10_000, 200
_FIRST = -(1 << 62)  # where null conversations and turns stand
_TYPES = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}


def canonical(value: Any) -> str:
    """JSON with sorted keys, without spaces; whole floats as integers, half surrogate pairs as escapes; raises ValueError on
    what JSON can't hold."""
    return _HALF.sub(lambda m: f"\\u{ord(m[0]):04x}", json.dumps(_plain(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False))


def _sound(text: str | None) -> str | None:
    """The text with half surrogate pairs replaced, as columns can't hold them."""
    return text if text is None or not _HALF.search(text) else text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def _plain(value: Any) -> Any:
    if isinstance(value, dict):
        return {str(k): _plain(v) for k, v in value.items()}
    if isinstance(value, list):
        return [_plain(v) for v in value]
    return int(value) if isinstance(value, float) and value.is_integer() and abs(value) < 1 << 53 else value


_BOUNDS = {"minimum": lambda v, x: v < x, "maximum": lambda v, x: v > x, "exclusiveMinimum": lambda v, x: v <= x, "exclusiveMaximum": lambda v, x: v >= x}
_SIZES = {"minLength": (str, lambda n, x: n < x), "maxLength": (str, lambda n, x: n > x), "minItems": (list, lambda n, x: n < x), "maxItems": (list, lambda n, x: n > x)}


def violations(value: Any, schema: Any, at: str = "$") -> list[str]:
    """What of a JSON schema a value breaks: type, enum, const, bounds, lengths, pattern, required, properties, items.

    Rules that aren't well formed say nothing.
    """
    if not isinstance(schema, dict):
        return [f"{at}: not allowed"] if schema is False else []
    kinds = schema.get("type")
    kinds = [k for k in (kinds if isinstance(kinds, list) else [kinds]) if isinstance(k, str)]
    if kinds and not any(_is(value, k) for k in kinds):
        return [f"{at}: not {' or '.join(kinds)}"]
    found = []
    if isinstance(schema.get("enum"), list) and not any(_same(value, x) for x in schema["enum"]):
        found.append(f"{at}: not in enum")
    if "const" in schema and not _same(value, schema["const"]):
        found.append(f"{at}: not const")
    if _is(value, "number"):
        found += [f"{at}: {rule}" for rule, broken in _BOUNDS.items() if _is(x := schema.get(rule), "number") and broken(value, x)]
    found += [f"{at}: {rule}" for rule, (kind, broken) in _SIZES.items() if isinstance(value, kind) and _is(x := schema.get(rule), "number") and broken(len(value), x)]
    if isinstance(value, str) and isinstance(schema.get("pattern"), str) and not _found(schema["pattern"], value):
        found.append(f"{at}: pattern")
    if isinstance(value, list):
        for i, v in enumerate(value):
            found += violations(v, schema.get("items"), f"{at}[{i}]")
    if isinstance(value, dict):
        own = schema["properties"] if isinstance(schema.get("properties"), dict) else {}
        needed = schema["required"] if isinstance(schema.get("required"), list) else []
        found += [f"{at}.{k}: missing" for k in needed if isinstance(k, str) and k not in value]
        for k, v in value.items():
            if not (isinstance(v, dict) and set(v) == {"$ref"}):  # filled in by another call's result
                found += violations(v, own[k] if k in own else schema.get("additionalProperties"), f"{at}.{k}")
    return found


def _found(pattern: str, value: str) -> bool:
    try:
        return regex.search(pattern, value, timeout=1.0) is not None
    except TimeoutError:
        return False
    except (regex.error, ValueError, RecursionError, OverflowError):
        return True


def _same(a: Any, b: Any) -> bool:
    return canonical(a) == canonical(b)


def _is(value: Any, kind: str) -> bool:
    if kind == "integer":
        return isinstance(value, int) and not isinstance(value, bool) or isinstance(value, float) and value.is_integer()
    if kind == "number":
        return isinstance(value, (int, float)) and not isinstance(value, bool)
    return isinstance(value, _TYPES.get(kind, object))


def _number(text: str) -> float:
    if not math.isfinite(x := float(text)):
        raise ValueError(text)
    return x


def _no_constant(name: str) -> None:
    raise ValueError(name)


def _loads(text: str) -> Any:
    """The JSON of a text, or None if it is none: no more than `DEEP` levels, and only numbers that JSON has."""
    try:
        found = json.loads(text, parse_float=_number, parse_constant=_no_constant)
    except (ValueError, RecursionError):
        return None
    level, depth = [found], 0
    while level := [y for x in level if isinstance(x, (dict, list)) for y in (x.values() if isinstance(x, dict) else x)]:
        depth += 1
        if depth > DEEP:
            return None
    return found


def _call(x: Any) -> dict | None:
    """id, name, arguments of a call in either of two common shapes; None if it names nothing."""
    if not isinstance(x, dict):
        return None
    inner = x["function"] if isinstance(x.get("function"), dict) else x
    if not isinstance(inner.get("name"), str):
        return None
    arguments = inner.get("arguments", {})
    broken = False
    if isinstance(arguments, str):
        given, arguments = arguments, _loads(arguments)
        if arguments is None and given.strip() != "null":
            arguments, broken = given, True
    return {"id": None if x.get("id") is None else _sound(str(x["id"])), "name": _sound(inner["name"]), "arguments": arguments, "broken": broken}


def parse(text: str | None) -> tuple[str | None, list[dict], list[str], list[tuple[str, Any]]]:
    """content, calls, the identifiers that the message answers, each once, declared (name, schema) pairs."""
    if not text or "{" not in text:
        return text, [], [], []
    whole = _loads(text) if text.lstrip().startswith("{") else None
    if isinstance(whole, dict) and not whole.keys().isdisjoint(("tools", "tool_calls", "tool_call_id")):
        calls = [c for x in whole.get("tool_calls") or [] if (c := _call(x))] if isinstance(whole.get("tool_calls", []), list) else []
        tools = []
        for t in whole.get("tools") or [] if isinstance(whole.get("tools", []), list) else []:
            t = t["function"] if isinstance(t, dict) and isinstance(t.get("function"), dict) else t
            if isinstance(t, dict) and isinstance(t.get("name"), str):
                tools.append((_sound(t["name"]), t.get("parameters", {})))
        answer = whole.get("tool_call_id")
        content = whole.get("content")
        return _sound(content if content is None or isinstance(content, str) else canonical(content)), calls, [] if answer is None else [_sound(str(answer))], tools
    calls, answers = [], []
    for m in _SPAN.finditer(text):
        x = _loads(m[2])
        if m[1] == "call" and (c := _call(x)):
            calls.append(c)
        elif m[1] == "result" and isinstance(x, dict) and x.get("id") is not None:
            answers.append(_sound(str(x["id"])))
    return (_SPAN.sub("", text).strip() if calls else text), calls, list(dict.fromkeys(answers)), []


def _references(value: Any) -> Iterator[str]:
    if isinstance(value, dict):
        if set(value) == {"$ref"} and isinstance(value["$ref"], str):
            yield _sound(value["$ref"])
        else:
            for v in value.values():
                yield from _references(v)
    elif isinstance(value, list):
        for v in value:
            yield from _references(v)


_PARSED = "conv long, turn long, seq long, role string, content string, calls array<struct<id:string,name:string,arguments:string,refs:array<string>,broken:boolean>>, answers array<string>, tools array<struct<name:string,schema:string>>"


def parsed(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """A row per message with its calls, what it answers and what it declares; seq tells rows apart."""
    call = pa.struct([("id", pa.string()), ("name", pa.string()), ("arguments", pa.string()), ("refs", pa.list_(pa.string())), ("broken", pa.bool_())])
    out = pa.schema([("conv", pa.int64()), ("turn", pa.int64()), ("seq", pa.int64()), ("role", pa.string()), ("content", pa.string()), ("calls", pa.list_(call)), ("answers", pa.list_(pa.string())), ("tools", pa.list_(pa.struct([("name", pa.string()), ("schema", pa.string())])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 33

        def found() -> Iterator[tuple]:
            for n, (c, t, r, x) in enumerate(rows(batches, "conv", "turn", "role", "text")):
                content, calls, answers, tools = parse(x)
                yield c, t, first + n, r, content, [{"id": k["id"], "name": k["name"], "arguments": json.dumps(k["arguments"]), "refs": list(_references(k["arguments"])), "broken": k["broken"]} for k in calls], answers, [{"name": a, "schema": json.dumps(b)} for a, b in tools]

        return emitted(found(), out, weight=lambda r: len(r[4] or ""))

    chosen = messages.select(F.col(conv).cast("long").alias("conv"), F.col(turn).cast("long").alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    return chosen.mapInArrow(run, _PARSED)


def sorted_out(edges: list[tuple[int, int]], turns: dict[int, int]) -> dict[int, tuple[int, int, bool]]:
    """For each message of (message, what it needs) edges: the turn it must not precede, its depth, whether it is in a cycle
    or waits for one. Depth is the longest chain of needs; so (turn, depth) rises along every edge."""
    needs: dict[int, int] = {}
    users: dict[int, list[int]] = {}
    for m, n in edges:
        needs[m] = needs.get(m, 0) + 1
        needs.setdefault(n, 0)
        users.setdefault(n, []).append(m)
    at, depth = dict(turns), dict.fromkeys(needs, 0)
    ready = deque(m for m, k in needs.items() if not k)
    done = set()
    while ready:
        n = ready.popleft()
        done.add(n)
        for m in users.get(n, ()):
            at[m], depth[m] = max(at[m], at[n]), max(depth[m], depth[n] + 1)
            needs[m] -= 1
            if not needs[m]:
                ready.append(m)
    return {m: (at[m], depth[m], False) if m in done else (turns[m], 0, True) for m in needs}


def _order(messages: DataFrame, calls: DataFrame, results: DataFrame, few: int = FEW) -> DataFrame | None:
    """seq, at (the turn it must not precede), depth, cyclic of the messages that depend on others or that others need."""
    by_id = ["conv", "id"]
    answer = results.join(calls.where("first").select(*by_id, F.col("seq").alias("needs")), by_id).select("conv", "seq", "needs")
    waiting = calls.select("conv", "seq", F.explode("refs").alias("id")).join(results.groupBy(*by_id).agg(F.min("seq").alias("needs")), by_id).select("conv", "seq", "needs")
    edges = checkpointed(answer.unionByName(waiting).distinct())
    if edges.isEmpty():
        return None
    turns = messages.select("seq", F.coalesce("turn", F.lit(_FIRST)).alias("turn"))
    many = checkpointed(edges.groupBy("conv").agg(F.count("*").alias("n")).where(F.col("n") > few).select("conv"))
    none = many.isEmpty()
    light = edges if none else edges.join(many, "conv", "left_anti")
    told = light.join(turns, "seq").join(turns.select(F.col("seq").alias("needs"), F.col("turn").alias("then")), "needs")
    out = pa.schema([("seq", pa.int64()), ("at", pa.int64()), ("depth", pa.int32()), ("cyclic", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[tuple]:
            for _, part in runs(batches, ["conv"]):
                seq, needs, turn, then = (part.column(c).to_pylist() for c in ("seq", "needs", "turn", "then"))
                own = dict(zip(needs, then, strict=True)) | dict(zip(seq, turn, strict=True))
                yield from ((m, *x) for m, x in sorted_out(list(zip(seq, needs, strict=True)), own).items())

        return emitted(found(), out)

    order = told.repartition("conv").sortWithinPartitions("conv").mapInArrow(run, "seq long, at long, depth int, cyclic boolean")
    return checkpointed(order if none else order.unionByName(_by_rounds(edges.join(many, "conv").select("seq", "needs"), turns)))


def _by_rounds(needs: DataFrame, turns: DataFrame) -> DataFrame:
    """The same for conversations of any size: in each round messages whose needs are all placed are placed."""
    needs = checkpointed(needs)
    nodes = needs.select("seq").unionByName(needs.select(F.col("needs").alias("seq"))).distinct()
    free = nodes.join(needs.select("seq").distinct(), "seq", "left_anti")
    done = checkpointed(free.join(turns, "seq").select("seq", F.col("turn").alias("at"), F.lit(0).alias("depth"), F.lit(False).alias("cyclic")))
    while not needs.isEmpty():
        state = needs.join(done.select(F.col("seq").alias("needs"), "at", "depth"), "needs", "left")
        ready = state.groupBy("seq").agg(F.count("*").alias("n"), F.count("at").alias("k"), F.max("at").alias("at"), F.max("depth").alias("depth")).where("n = k")
        ready = checkpointed(ready.join(turns, "seq").select("seq", F.greatest("turn", "at").alias("at"), (F.col("depth") + 1).alias("depth"), F.lit(False).alias("cyclic")))
        if ready.isEmpty():
            stuck = needs.select("seq").distinct().join(turns, "seq").select("seq", F.col("turn").alias("at"), F.lit(0).alias("depth"), F.lit(True).alias("cyclic"))
            return done.unionByName(stuck)
        done = checkpointed(done.unionByName(ready))
        needs = checkpointed(needs.join(ready.select("seq"), "seq", "left_anti"))
    return done


def format_conversations(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", schemas: dict[str, dict] | None = None, few: int = FEW) -> DataFrame:
    """conv_id, turn, position, role, n_calls, n_invalid, linked, cyclic, message (canonical JSON), a row per message.

    linked: for a message that answers calls, whether all of them are there; null for others. n_invalid: calls with broken
    arguments, arguments that break the schema, or a repeated identifier.
    """
    all_rows = checkpointed(parsed(messages, conv, turn, role, text))
    known = {name: json.dumps(s) for name, s in (schemas or {}).items()}
    calls = all_rows.where(F.size("calls") > 0).select("conv", "turn", "seq", F.posexplode("calls").alias("n", "c")).select(F.coalesce("conv", F.lit(_FIRST)).alias("conv"), "turn", "seq", "n", "c.*")
    firsts = calls.where("id is not null").groupBy("conv", "id").agg(F.min(F.struct(F.coalesce("turn", F.lit(_FIRST)), "seq", "n")).alias("f")).select("conv", "id", F.col("f.seq").alias("f_seq"), F.col("f.n").alias("f_n"))
    declared = all_rows.where(F.size("tools") > 0).select(F.coalesce("conv", F.lit(_FIRST)).alias("conv"), "seq", F.explode("tools").alias("t")).groupBy("conv", F.col("t.name").alias("name")).agg(F.min_by("t.schema", "seq").alias("schema"))
    calls = calls.join(firsts, ["conv", "id"], "left").withColumn("first", F.coalesce((F.col("seq") == F.col("f_seq")) & (F.col("n") == F.col("f_n")), F.lit(False))).join(declared, ["conv", "name"], "left")

    @F.arrow_udf("array<string>")
    def broken(names: pa.Array, arguments: pa.Array, schema: pa.Array) -> pa.Array:
        return pa.array([[_sound(x) for x in violations(json.loads(a), json.loads(s or known.get(n, "{}")))] for n, a, s in zip(names.to_pylist(), arguments.to_pylist(), schema.to_pylist(), strict=True)], type=pa.list_(pa.string()))

    calls = checkpointed(calls.withColumn("errors", broken("name", "arguments", "schema")).withColumn("valid", ~F.col("broken") & (F.size("errors") == 0) & (F.col("first") | F.col("id").isNull())))
    results = all_rows.where(F.size("answers") > 0).select(F.coalesce("conv", F.lit(_FIRST)).alias("conv"), "seq", F.explode("answers").alias("id"))
    order = _order(all_rows, calls, results, few)
    told = all_rows.withColumn("key", F.coalesce("turn", F.lit(_FIRST)))
    if order is None:
        told = told.withColumns({"depth": F.lit(0), "cyclic": F.lit(False)})
    else:
        told = told.join(order.withColumnRenamed("at", "later"), "seq", "left").withColumns({"key": F.coalesce("later", "key"), "depth": F.coalesce("depth", F.lit(0)), "cyclic": F.coalesce("cyclic", F.lit(False))}).drop("later")
    counted = calls.groupBy("seq").agg(F.count_if(~F.col("valid")).alias("n_invalid"))
    known_calls = calls.where("first").select("conv", "id", F.lit(True).alias("there")).distinct()
    answered = results.join(known_calls, ["conv", "id"], "left").groupBy("seq").agg(F.bool_and(F.coalesce("there", F.lit(False))).alias("found"))
    told = told.join(counted, "seq", "left").join(answered, "seq", "left")
    placed = numbered(told, "conv", ["key", "depth", "turn", "seq"])

    @F.arrow_udf("string")
    def line(roles: pa.Array, contents: pa.Array, called: pa.Array, answers: pa.Array) -> pa.Array:
        def one(r: str | None, c: str | None, cs: list[dict] | None, a: list[str]) -> str:
            message: dict[str, Any] = {"role": r, "content": c}
            if cs:
                message["tool_calls"] = [{"id": x["id"], "name": x["name"], "arguments": json.loads(x["arguments"])} for x in cs]
            if a:
                message["tool_call_id" if len(a) == 1 else "tool_call_ids"] = a[0] if len(a) == 1 else a
            return canonical(message)

        return pa.array(map(one, roles.to_pylist(), contents.to_pylist(), called.to_pylist(), answers.to_pylist()), type=pa.string())

    return placed.select(
        F.col("conv").alias(conv), F.col("turn").alias(turn), "position", F.col("role").alias(role), F.size("calls").cast("long").alias("n_calls"), F.coalesce("n_invalid", F.lit(0)).cast("long").alias("n_invalid"),
        F.when(F.size("answers") > 0, F.coalesce("found", F.lit(False))).alias("linked"), "cyclic", line("role", "content", "calls", "answers").alias("message"),
    )
