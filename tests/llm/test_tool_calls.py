from __future__ import annotations

import json
import random

import pytest

from cropwind.llm import queries
from cropwind.llm import tool_calls as tc

SCHEMAS = {"add": {"type": "object", "properties": {"a": {"type": "number"}, "b": {"type": "integer", "maximum": 9}, "t": {"type": "array", "items": {"enum": ["x"]}}}, "required": ["a"], "additionalProperties": False}}
SCHEMA = "conv_id long, turn long, role string, text string, status int"


def call(i, after=(), name="add", **arguments):
    return {"id": i, "name": name, "arguments": arguments, "after": list(after)}


def test_links_levels_and_validation(spark):
    rows = [
        (1, 0, "user", "hi", 0), (1, 1, "assistant", json.dumps({"content": None, "tool_calls": [call("a", a=1.0), call("b", ["a"], a=2, b=3), call("c", ["b", "nowhere"], a="x"), call("d", a=1)]}), 0),
        (1, 2, "tool", '{"tool_call_id": "a", "content": {"z": 1.50, "y": [1.0]}}', 0), (1, 3, "tool", '{"tool_call_id": "c", "content": "é"}', 0), (1, 4, "tool", '{"tool_call_id": "a", "content": 2}', 0),
        (1, 5, "tool", '{"tool_call_id": "q", "content": 2}', 0), (1, 6, "assistant", json.dumps({"tool_calls": [call("a", a=9), call("x", ["y"], a=1), call("y", ["x"], a=1), call(None, a=1)]}), 0),
        (2, 0, "assistant", '{"tool_calls": [{"id": "a", "name": "add", "arguments": "{\\"a\\": 1, \\"t\\": [\\"x\\", \\"w\\"]}"}, 5]}', 0), (2, 1, "user", "{broken", 0), (3, None, None, None, 0), (None, 1, "tool", '{"tool_call_id": "a"}', 0),
    ]
    out = {(r.conv_id, r.turn, r.part): r for r in tc.link(spark.createDataFrame(rows, SCHEMA), SCHEMAS).collect()}
    assert len(out) == len(rows) + 4 + 4 + 2
    got = {k: (r.kind, r.status, r.level) for k, r in out.items() if r.kind != "text"}
    assert got == {
        (1, 1, 1): ("call", "linked", 0), (1, 1, 2): ("call", "open", 1), (1, 1, 3): ("call", "linked", 2), (1, 1, 4): ("call", "open", 0), (1, 2, 0): ("result", "linked", 1), (1, 3, 0): ("result", "linked", 3),
        (1, 4, 0): ("result", "duplicate", 1), (1, 5, 0): ("result", "orphan", None), (1, 6, 1): ("call", "duplicate", 0), (1, 6, 2): ("call", "open", None), (1, 6, 3): ("call", "open", None), (1, 6, 4): ("call", "open", None),
        (2, 0, 1): ("call", "open", 0), (2, 0, 2): ("call", "open", None), (None, 1, 0): ("result", "orphan", None),
    }
    assert out[1, 2, 0].body == '{"content":{"y":[1],"z":1.5},"role":"tool","tool_call_id":"a"}'
    assert out[1, 1, 3].error == "$.a: not number" and out[2, 0, 1].error == "$.t[1]: not in enum" and out[2, 0, 2].error == "unknown tool None" and out[1, 1, 2].valid
    assert out[2, 1, 0].body == '{"content":"{broken","role":"user"}' and out[3, None, 0].body == '{"content":"","role":null}'
    assert tc.link(spark.createDataFrame([], SCHEMA), SCHEMAS).count() == 0


@pytest.mark.parametrize("value, schema, error", [
    (True, {"type": "integer"}, "$: not integer"), (2.0, {"type": "integer"}, None), ({"a": 1}, {"additionalProperties": False}, "$.a: unknown"), ("", {"minLength": 1}, "$: length"), (5, {"maximum": 4}, "$: out of range"), (None, {"type": ["string", "null"]}, None),
])
def test_violations(value, schema, error):
    assert tc.violation(value, schema) == error


def test_exchanges_leave_tool_calls_as_they_are(spark):
    held = json.dumps({"tool_calls": [{"id": "look", "name": "answer", "arguments": {"question": "", "turn": 1}, "after": ["0"]}]})
    rows = [
        (1, 0, "user", "q", 0), (1, 1, "assistant", held, 0), (1, 2, "tool", '{"tool_call_id": "look", "content": 5}', 0), (1, 3, "assistant", '{"tool_call_id": "0", "content": "a"}', 0),
        (2, 0, "user", '{"tool_calls": 1}', 0), (2, 1, "assistant", "{broken", 0), (3, 0, "user", None, 0),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    out = tc.link(tc.exchanges(df), tc.ANSWER).where("kind <> 'text'").collect()
    assert sorted((r.conv_id, r.turn, r.kind, r.call_id, r.status, r.level, r.error) for r in out) == [
        (1, 0, "call", "0", "linked", 0, None), (1, 1, "call", "look", "linked", 1, "$.question: length"), (1, 2, "result", "look", "linked", 2, None), (1, 3, "result", "0", "linked", 1, None),
        (2, 0, "call", "0", "linked", 0, None), (2, 1, "result", "0", "linked", 1, None), (3, 0, "call", "0", "open", 0, "$.question: length"),
    ]
    assert tc.exchanges(df.where("false")).count() == 0


def test_query_over_the_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = queries.table(spark, sf, "conversations").collect()
    users = {(r.conv_id, r.turn): r.text for r in rows if r.role == "user"}
    answers = {(r.conv_id, r.turn - 1) for r in rows if r.role == "assistant"}
    want = []

    def level(conv, turn):
        return 0 if (conv, turn - 2) not in users else 1 + level(conv, turn - 2)

    dump = lambda x: json.dumps(x, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    for r in rows:
        if r.role == "user":
            want.append((r.conv_id, r.turn, 0, "text", None, dump({"role": r.role, "content": ""})))
            want.append((r.conv_id, r.turn, 1, "linked" if (r.conv_id, r.turn) in answers else "open", level(r.conv_id, r.turn), dump({"id": str(r.turn), "name": "answer", "arguments": {"question": r.text, "turn": r.turn}})))
        elif r.role == "assistant":
            known = (r.conv_id, r.turn - 1) in users
            want.append((r.conv_id, r.turn, 0, "linked" if known else "orphan", level(r.conv_id, r.turn - 1) + 1 if known else None, dump({"role": r.role, "tool_call_id": str(r.turn - 1), "content": r.text})))
        else:
            want.append((r.conv_id, r.turn, 0, "text", None, dump({"role": r.role, "content": r.text})))
    out = queries.op7_tool_calls(spark, sf).collect()
    assert sorted((r.conv_id, r.turn, r.part, r.status, r.level, r.body) for r in out) == sorted(want)
    calls = [r for r in out if r.kind == "call"]
    assert all(r.valid == (1 <= len(users[r.conv_id, r.turn]) <= tc.MAX_QUESTION) and (r.error is None) == r.valid for r in calls)
    # Order and validation show in the table.
    assert {r.level for r in calls} >= {0, 1, 2} and {r.valid for r in calls} == {True, False}


CALLS = "conv_id long, call_id string, after array<string>"


def longest(calls):
    """Level of each call by repeated passes over the whole list; calls on or behind a cycle have none."""
    known, left = {}, {(c, i): {a for a in after if any(a == j and c == d for d, j, _ in calls)} for c, i, after in calls}
    while True:
        ready = {k: max((known[k[0], a] + 1 for a in cited), default=0) for k, cited in left.items() if all((k[0], a) in known for a in cited)}
        if not ready:
            return known
        known |= ready
        left = {k: v for k, v in left.items() if k not in ready}


@pytest.mark.parametrize("seed", range(3))
def test_levels_equal_brute_force(spark, seed):
    r = random.Random(seed)
    calls = []
    for conv in range(8):
        for i in range(25):
            # Mostly earlier calls are cited, now and then a later one, which may close a cycle, or itself.
            pool = range(25) if r.random() < 0.04 else range(max(i, 1))
            calls.append((conv, str(i), [str(r.choice(pool)) for _ in range(r.choice([0, 1, 1, 1, 2, 3]))] if i else []))
    got = {(x.conv_id, x.call_id): x.level for x in tc.levels(spark.createDataFrame(calls, CALLS)).collect()}
    assert got == longest(calls)


def test_a_long_chain_is_halved_by_each_round(spark, monkeypatch):
    rounds = []
    kept = tc.written
    monkeypatch.setattr(tc, "written", lambda df, name: rounds.append(name) or kept(df, name))
    calls = [(1, str(i), [str(i - 1)] if i else []) for i in range(1000)] + [(2, "a", ["b"]), (2, "b", ["a"]), (2, "c", ["a"]), (2, "d", ["d"])]
    got = {(x.conv_id, x.call_id): x.level for x in tc.levels(spark.createDataFrame(calls, CALLS)).collect()}
    assert got == {(1, str(i)): i for i in range(1000)} and rounds.count("calls-chains") <= 2 * 12
    assert tc.levels(spark.createDataFrame([], CALLS)).count() == 0
