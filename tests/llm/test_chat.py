"""Tool-call linking on small conversations, and the whole table against DuckDB."""

import json
import random

import duckdb

from quern.llm import chat
from quern.llm.queries import ORACLES, QUERIES

TOOLS = {"tools": [{"name": "add", "parameters": {"type": "object", "required": ["a"], "properties": {"a": {"type": "integer"}, "b": {"enum": [1, 2]}}, "additionalProperties": False}}]}


def call(i, name="add", **arguments):
    return json.dumps({"tool_calls": [{"id": i, "type": "function", "function": {"name": name, "arguments": json.dumps(arguments)}}], "content": None})


def answer(i, content="3"):
    return json.dumps({"tool_call_id": i, "content": content})


def test_linking_order_and_validation(spark):
    rows = [
        (1, 0, "system", json.dumps(TOOLS)),
        (1, 1, "tool", answer("c1")),  # comes before its call
        (1, 2, "assistant", call("c1", a=1)),
        (1, 3, "assistant", call("c2", a={"$ref": "c3"})),  # waits for a later result
        (1, 4, "assistant", 'so <tool_call>{"id": "c3", "name": "add", "arguments": {"a": "x", "b": 3, "z": 1}}</tool_call>'),
        (1, 5, "tool", answer("c3")),
        (1, 6, "tool", answer("nobody")),
        (1, 7, "assistant", call("c1", a=2)),
        (2, 0, "assistant", call("x", a={"$ref": "y"})),
        (2, 1, "assistant", call("y", a={"$ref": "x"})),
        (2, 2, "tool", answer("x")),
        (2, 3, "tool", answer("y")),
        (None, None, None, None),
        (None, 1, "user", ""),
        (3, 0, "user", "{not json"),
        (3, 0, "user", "{not json"),
    ]
    got = chat.format_conversations(spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, seq string")).collect()
    assert len(got) == len(rows)
    one = sorted((r for r in got if r.conv_id == 1), key=lambda r: r.position)
    assert [r.position for r in one] == list(range(8))
    assert [r.turn for r in one] == [0, 2, 1, 4, 5, 3, 6, 7]
    at = {r.turn: r for r in one}
    assert [at[t].linked for t in (1, 5, 6, 2)] == [True, True, False, None]
    assert [at[t].n_invalid for t in (2, 3, 4, 7)] == [0, 0, 1, 1]
    assert at[4].message == '{"content":"so","role":"assistant","tool_calls":[{"arguments":{"a":"x","b":3,"z":1},"id":"c3","name":"add"}]}'
    two = {r.turn: r for r in got if r.conv_id == 2}
    assert all(r.cyclic for r in two.values()) and [two[t].position for t in range(4)] == [0, 1, 2, 3]
    nobody = sorted((r for r in got if r.conv_id is None), key=lambda r: r.position)
    assert [r.turn for r in nobody] == [None, 1] and nobody[0].message == '{"content":null,"role":null}'
    assert chat.format_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_canonical_json():
    assert chat.canonical({"b": [1.0, 2.5, None], "a": {"é": "\n\""}}) == '{"a":{"é":"\\n\\""},"b":[1,2.5,null]}'
    assert chat.violations({"a": True}, TOOLS["tools"][0]["parameters"]) == ["$.a: not integer"]
    assert chat.violations({"b": 3}, TOOLS["tools"][0]["parameters"]) == ["$.a: missing", "$.b: not in enum"]


def test_table(spark):
    at = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{at}/conversations.parquet'")
    df = QUERIES["op1_chat_tool_calls"](spark, at)
    want = con.execute(f"select {', '.join(df.columns)} from ({ORACLES['op1_chat_tool_calls']})").fetchall()
    assert sorted(map(tuple, df.collect()), key=str) == sorted(want, key=str)


def test_several_results_in_one_message(spark):
    result = lambda *ids: " ".join(f'<tool_result>{{"id": "{i}", "content": 1}}</tool_result>' for i in ids)
    rows = [
        (1, 0, "assistant", call("late", a={"$ref": "a"})),  # waits for the first of two results
        (1, 1, "assistant", call("a", a=1)),
        (1, 2, "assistant", call("b", a=1)),
        (1, 3, "tool", result("a", "b", "a")),
        (1, 4, "tool", result("nobody", "b")),
    ]
    got = sorted(chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect(), key=lambda r: r.position)
    assert len(got) == 5 and [r.turn for r in got] == [1, 2, 3, 0, 4]
    at = {r.turn: r for r in got}
    assert [at[t].linked for t in (3, 4, 0)] == [True, False, None]
    assert json.loads(at[3].message)["tool_call_ids"] == ["a", "b"]


COLUMNS = "conv_id long, turn long, role string, text string"


def test_strange_json_crashes_nothing(spark):
    raw = lambda arguments: '{"tool_calls": [{"id": "i", "name": "add", "arguments": %s}]}' % arguments
    deep = "[" * 5000 + "]" * 5000
    texts = [raw('{"a": NaN}'), raw('{"a": Infinity}'), raw('{"a": 1e999}'), raw('{"a": "\\ud800"}'), raw('"{\\"a\\": NaN}"'), raw(deep), raw('{"a": %s}' % ("9" * 6000)), '{"tool_call_id": "\\udfff", "content": "\\ud800x"}', raw("null"), raw('"null"'), '{"tools": 3, "tool_calls": 4}', "{", "[1]", '<tool_call>{"name": 1}</tool_call><tool_result>[]</tool_result>']
    got = sorted(chat.format_conversations(spark.createDataFrame([(1, i, "r", t) for i, t in enumerate(texts)], COLUMNS)).collect(), key=lambda r: r.turn)
    assert [r.n_calls for r in got] == [0, 0, 0, 1, 1, 0, 0, 0, 1, 1, 0, 0, 0, 0]
    assert [r.n_invalid for r in got] == [0, 0, 0, 0, 1, 0, 0, 0, 1, 1, 0, 0, 0, 0]  # null arguments follow earlier calls of the same id
    assert json.loads(got[3].message)["tool_calls"][0]["arguments"] == {"a": "\ud800"}
    assert json.loads(got[7].message)["content"] == "\ufffdx"
    assert all(json.loads(r.message) for r in got)


def test_rules_that_are_not_well_formed_say_nothing():
    bad = [{"pattern": "("}, {"minLength": "3"}, {"minimum": "x"}, {"enum": 3}, {"required": None}, {"required": [3]}, {"type": {}}, {"type": [3]}, {"properties": []}, {"items": 3}, {"maxItems": None}, 3, "x", None, True, []]
    for schema in bad:
        for value in ("abc", 3, 2.5, None, True, [1], {"a": 1}):
            assert chat.violations(value, schema) == []
    assert chat.violations(1, False) and chat.violations(True, {"enum": [1]}) and chat.violations(1.0, {"enum": [1]}) == []
    assert chat.violations("a" * 40 + "!", {"pattern": "^(a|aa|a*a*)+$"}) == ["$: pattern"]


def test_long_chains_and_both_ways_of_ordering(spark):
    n = 600
    chain = [(1, n - 1 - i, "assistant", call(f"c{i}", a={"$ref": f"c{i - 1}"} if i else 1)) for i in range(n)] + [(1, n + i, "tool", answer(f"c{i}")) for i in range(n)]
    got = sorted(chat.format_conversations(spark.createDataFrame(chain, COLUMNS)).collect(), key=lambda r: r.position)
    place = {r.turn: r.position for r in got}
    assert len(got) == 2 * n and not any(r.cyclic for r in got)
    for i in range(n):
        assert place[n - 1 - i] < place[n + i] and (not i or place[n + i - 1] < place[n - 1 - i])
    rng = random.Random(5)
    rows = []
    for c in range(6):
        ids = [f"t{i}" for i in range(8)]
        said = [("assistant", call(i, a={"$ref": rng.choice(ids)} if rng.random() < 0.6 else 1)) for i in ids] + [("tool", answer(i)) for i in ids]
        rng.shuffle(said)
        rows += [(c, t, *x) for t, x in enumerate(said)]
    df = spark.createDataFrame(rows, COLUMNS)
    one = sorted(map(tuple, chat.format_conversations(df).collect()))
    assert one == sorted(map(tuple, chat.format_conversations(df, few=3).collect()))
    assert any(r[7] for r in one) and not all(r[7] for r in one)


def test_a_made_up_table_against_plain_linking(spark):
    rng = random.Random(9)
    rows, calls, results = [], {}, []
    for c in range(40):
        turn = 0
        for _ in range(rng.randint(1, 12)):
            kind = rng.random()
            i = f"k{rng.randint(0, 5)}"
            if kind < 0.4:
                rows.append((c, turn, "assistant", call(i, a=rng.choice([1, "x"]))))
                calls.setdefault((c, i), []).append((turn, rows[-1]))
            elif kind < 0.8:
                rows.append((c, turn, "tool", answer(i)))
                results.append((c, turn, i))
            else:
                rows.append((c, turn, "user", f"hello {i} {{"))
            turn += 1
    got = {(r.conv_id, r.turn): r for r in chat.format_conversations(spark.createDataFrame(rows, COLUMNS), schemas={"add": TOOLS["tools"][0]["parameters"]}).collect()}
    assert len(got) == len(rows)
    for c, t, i in results:
        r = got[c, t]
        assert r.linked == ((c, i) in calls)
        if r.linked:
            assert r.position > got[c, calls[c, i][0][0]].position
    for of in calls.values():
        for k, (t, row) in enumerate(of):
            assert got[row[0], t].n_invalid == int(k > 0 or '\\"x\\"' in row[3])
    for c in range(40):
        mine = [r for r in got.values() if r.conv_id == c]
        assert sorted(r.position for r in mine) == list(range(len(mine)))
