"""Chat formatting with linked tool calls.

A message is plain text, or JSON as chat interfaces exchange it: an assistant's
``{"content", "tool_calls": [{"id", "name", "arguments", "after"}]}`` or a tool's
``{"tool_call_id", "content"}``. One pass reads the texts, validates each call's arguments against
its tool's schema and writes every part as canonical JSON (sorted keys, no spaces, one number form).
Calls and results are then hash-joined by conversation and identifier, and calls that cite others in
``after`` are put in topological order: chains of calls that cite one call each are halved by every round,
only calls that cite several wait for one another, and no conversation is ever held in one place.

Defined results: every message gives one row, and each call of a message one more. Identifiers that
repeat within a conversation belong to their first call; later ones are ``duplicate``, as are further
results of one call. ``status`` is ``text``, ``linked``, ``open`` (a call without result), ``orphan``
(a result without call) or ``duplicate``. ``level`` counts citations before a call, is one more for its
result's, and null for calls in a cycle, for orphans and for plain text. A null text is an empty
message; broken JSON is plain text; null ids take no part in links; rows that repeat are rows of their
own; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator, Mapping
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cropwind.sources.paths import written

_PART = pa.schema([
    ("conv_id", pa.int64()), ("turn", pa.int64()), ("part", pa.int32()), ("role", pa.string()), ("kind", pa.string()), ("call_id", pa.string()),
    ("after", pa.list_(pa.string())), ("valid", pa.bool_()), ("error", pa.string()), ("body", pa.string()),
])
_PART_SQL = "conv_id long, turn long, part int, role string, kind string, call_id string, after array<string>, valid boolean, error string, body string"
_TYPES: dict[str, Any] = {"string": str, "object": dict, "array": list, "boolean": bool, "null": type(None)}


def canonical(value: Any) -> str:
    """Sorted keys, no white space, integral numbers without a fraction."""
    def plain(x: Any) -> Any:
        if isinstance(x, dict):
            return {str(k): plain(v) for k, v in x.items()}
        if isinstance(x, list):
            return [plain(v) for v in x]
        if isinstance(x, float):
            if not math.isfinite(x):
                return None
            return int(x) if x.is_integer() and abs(x) < 2**53 else x
        return x

    return json.dumps(plain(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def violation(value: Any, schema: Mapping[str, Any], path: str = "$") -> str | None:
    """The first place where a value breaks its schema: type, enum, required, properties, items, bounds."""
    kinds = schema.get("type")
    if kinds is not None and not any(_is(value, k) for k in ([kinds] if isinstance(kinds, str) else kinds)):
        return f"{path}: not {kinds if isinstance(kinds, str) else ' or '.join(kinds)}"
    if "enum" in schema and value not in schema["enum"]:
        return f"{path}: not in enum"
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        if value < schema.get("minimum", value) or value > schema.get("maximum", value):
            return f"{path}: out of range"
    if isinstance(value, str) and not schema.get("minLength", 0) <= len(value) <= schema.get("maxLength", len(value)):
        return f"{path}: length"
    if isinstance(value, dict):
        known = schema.get("properties", {})
        for key in schema.get("required", ()):
            if key not in value:
                return f"{path}.{key}: missing"
        for key in sorted(value):
            if key in known:
                found = violation(value[key], known[key], f"{path}.{key}")
            else:
                found = f"{path}.{key}: unknown" if schema.get("additionalProperties") is False else None
            if found:
                return found
    if isinstance(value, list) and "items" in schema:
        for i, item in enumerate(value):
            if found := violation(item, schema["items"], f"{path}[{i}]"):
                return found
    return None


def _is(value: Any, kind: str) -> bool:
    if kind in ("integer", "number"):
        return isinstance(value, (int, float)) and not isinstance(value, bool) and (kind == "number" or float(value).is_integer())
    return isinstance(value, _TYPES[kind])


def tool_json(text: str | None) -> dict | None:
    """What a message in one of the JSON forms holds; None for plain text."""
    if not text or text.lstrip()[:1] != "{":
        return None
    try:
        found = json.loads(text)
    except (ValueError, RecursionError):
        return None
    return found if isinstance(found, dict) and (isinstance(found.get("tool_calls"), list) or found.get("tool_call_id") is not None) else None


def message_parts(role: str | None, text: str | None, schemas: Mapping[str, Mapping[str, Any]]) -> list[tuple]:
    """(part, kind, call_id, after, valid, error, body) of one message."""
    found = tool_json(text)
    if found is not None and isinstance(found.get("tool_calls"), list):
        out = [(0, "text", None, None, None, None, canonical({"role": role, "content": found.get("content")}))]
        for n, call in enumerate(found["tool_calls"], 1):
            call = call if isinstance(call, dict) else {}
            name, arguments = call.get("name"), call.get("arguments")
            if isinstance(arguments, str):
                try:
                    arguments = json.loads(arguments)
                except (ValueError, RecursionError):
                    pass
            schema = schemas.get(name) if isinstance(name, str) else None
            error = f"unknown tool {name}" if schema is None else violation(arguments, schema)
            after = [str(a) for a in call.get("after") or [] if a is not None] if isinstance(call.get("after") or [], list) else []
            call_id = None if call.get("id") is None else str(call["id"])
            out.append((n, "call", call_id, after, error is None, error, canonical({"id": call_id, "name": name, "arguments": arguments})))
        return out
    if found is not None:
        return [(0, "result", str(found["tool_call_id"]), None, None, None, canonical({"role": role, "tool_call_id": str(found["tool_call_id"]), "content": found.get("content")}))]
    return [(0, "text", None, None, None, None, canonical({"role": role, "content": text or ""}))]


def parts(messages: DataFrame, schemas: Mapping[str, Mapping[str, Any]]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), 1000):
                part = batch.slice(lo, 1000)
                rows = [
                    (c, t, p[0], r, *p[1:])
                    for c, t, r, x in zip(*(part.column(n).to_pylist() for n in ("conv_id", "turn", "role", "text")), strict=True)
                    for p in message_parts(r, x, schemas)
                ]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _PART.types, strict=True)], schema=_PART)

    return messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text").mapInArrow(run, _PART_SQL)


def _chains(single: DataFrame) -> DataFrame:
    """``conv_id, call_id, anchor, steps``: where the chain of a call that cites one call ends, and how far that is.

    Every round doubles the steps that a pointer goes. A round in which none arrives leaves only calls
    on a cycle or before one; they are not in the result.
    """
    key = ["conv_id", "call_id"]
    further = single.select("conv_id", F.col("call_id").alias("anchor"), F.lit(False).alias("arrived"))
    chains = single.select(*key, F.col("cited").alias("anchor"), F.lit(1).cast("long").alias("steps")).join(further, ["conv_id", "anchor"], "left")
    chains = written(chains.withColumn("arrived", F.coalesce("arrived", F.lit(True))), "calls-chains")
    while True:
        ahead = chains.select("conv_id", F.col("call_id").alias("anchor"), F.col("anchor").alias("next"), F.col("steps").alias("more"), F.col("arrived").alias("there"))
        moved = chains.where("NOT arrived").join(ahead, ["conv_id", "anchor"]).select(*key, F.col("next").alias("anchor"), (F.col("steps") + F.col("more")).alias("steps"), F.col("there").alias("arrived"))
        moved = written(moved, "calls-chains")
        if moved.where("arrived").isEmpty():
            return chains.where("arrived").drop("arrived")
        chains = written(chains.where("arrived").unionByName(moved), "calls-chains")


def levels(calls: DataFrame) -> DataFrame:
    """``conv_id, call_id, level`` of the calls outside cycles; ``calls`` has one row an identifier, with ``after``."""
    key = ["conv_id", "call_id"]
    ids = calls.select(*key)
    cited = calls.select(*key, F.explode("after").alias("cited")).distinct()
    # A citation of what is no call of the conversation binds nothing.
    bound = written(cited.join(ids.withColumnRenamed("call_id", "cited"), ["conv_id", "cited"]).select(*key, "cited"), "calls-cited")
    number = written(bound.groupBy(*key).agg(F.count("*").alias("n"), F.min("cited").alias("cited")), "calls-number")
    roots = ids.join(number.select(*key), key, "left_anti").withColumn("level", F.lit(0).cast("long"))
    done = written(roots, "calls-level")
    chains = _chains(number.where("n = 1"))
    several = number.where("n > 1").select(*key)
    if not several.isEmpty():
        # Citations of calls that cite several, each moved to the end of its chain; none has an end on a cycle.
        ends = chains.unionByName(number.where("n > 1").select(*key, F.col("call_id").alias("anchor"), F.lit(0).cast("long").alias("steps")))
        ends = ends.unionByName(done.select(*key, F.col("call_id").alias("anchor"), F.lit(0).cast("long").alias("steps")))
        ends = ends.withColumnRenamed("call_id", "cited")
        open_ = written(bound.join(several, key).join(ends, ["conv_id", "cited"], "left").select(*key, "anchor", (F.col("steps") + 1).alias("steps")), "calls-open")
        waiting, fresh, reached = written(several, "calls-waiting"), done, None
        while True:
            arrived = open_.join(fresh.withColumnRenamed("call_id", "anchor"), ["conv_id", "anchor"]).select(*key, (F.col("level") + F.col("steps")).alias("level"))
            reached = written((arrived if reached is None else reached.unionByName(arrived)).groupBy(*key).agg(F.max("level").alias("level")), "calls-reached")
            open_ = written(open_.join(fresh.select("conv_id", F.col("call_id").alias("anchor")), ["conv_id", "anchor"], "left_anti").select(*key, "anchor", "steps"), "calls-open")
            fresh = written(waiting.join(open_.select(*key).distinct(), key, "left_anti").join(reached, key), "calls-level")
            if fresh.isEmpty():
                break
            done, waiting = done.unionByName(fresh), written(waiting.join(fresh.select(*key), key, "left_anti"), "calls-waiting")
    at_end = done.withColumnRenamed("call_id", "anchor")
    behind = chains.join(at_end, ["conv_id", "anchor"]).select(*key, (F.col("level") + F.col("steps")).alias("level"))
    return done.unionByName(behind).withColumn("level", F.col("level").cast("int"))


def link(messages: DataFrame, schemas: Mapping[str, Mapping[str, Any]]) -> DataFrame:
    """``conv_id, turn, part, role, kind, call_id, status, level, valid, error, body`` of every part."""
    rows = written(parts(messages, schemas), "calls-parts")
    keys, columns = ["conv_id", "call_id"], ["conv_id", "turn", "part", "role", "kind", "call_id", "status", "level", "valid", "error", "body"]
    named = rows.where("conv_id IS NOT NULL AND call_id IS NOT NULL")
    place = F.struct(F.col("turn").isNull(), "turn", "part", F.xxhash64("body"))
    # One row an identifier: its first call, and whether it has a result; combined before the shuffle.
    calls = written(named.where("kind = 'call'").groupBy(*keys).agg(F.min(place).alias("first_call"), F.min_by("after", place).alias("after")), "calls-first")
    results = written(named.where("kind = 'result'").groupBy(*keys).agg(F.min(place).alias("first_result")), "calls-results")
    known = calls.select(*keys, "first_call").join(levels(calls), keys, "left").join(results.hint("shuffle_hash"), keys, "full_outer")
    known = written(known, "calls-linked")
    seen = named.join(known, keys).withColumn("place", place)
    first = F.when(F.col("kind") == "call", F.col("place") == F.col("first_call")).otherwise(F.col("place") == F.col("first_result"))
    other = F.when(F.col("kind") == "call", F.col("first_result").isNotNull()).otherwise(F.col("first_call").isNotNull())
    status = F.when(~first, "duplicate").when(other, "linked").when(F.col("kind") == "call", "open").otherwise("orphan")
    seen = seen.withColumns({"status": status, "level": F.when(F.col("kind") == "call", F.col("level")).otherwise(F.col("level") + 1)})
    plain = rows.where("conv_id IS NULL OR call_id IS NULL")
    unnamed = F.when(F.col("kind") == "text", "text").when(F.col("kind") == "call", "open").otherwise("orphan")
    plain = plain.withColumns({"status": unnamed, "level": F.lit(None).cast("int")})
    return seen.select(*columns).unionByName(plain.select(*columns))


#: The longest question that ``answer`` takes, in characters.
MAX_QUESTION = 300
#: The tool that ``exchanges`` calls.
ANSWER = {"answer": {"type": "object", "properties": {"question": {"type": "string", "minLength": 1, "maxLength": MAX_QUESTION}, "turn": {"type": "integer", "minimum": 0}}, "required": ["question", "turn"], "additionalProperties": False}}


def exchanges(conversations: DataFrame) -> DataFrame:
    """Conversations without tools in the JSON form: each user's turn calls ``answer``, the next turn is its result.

    A call cites the call two turns before it, where there is one. Messages that are no user's or
    assistant's stay as they are, and so do those in the JSON form already.
    """
    held = F.pandas_udf(lambda texts: texts.map(lambda t: tool_json(t) is not None).astype(bool), "boolean")
    text, turn = F.coalesce("text", F.lit("")), F.col("turn")
    before = F.when(turn >= 2, F.array((turn - 2).cast("string"))).otherwise(F.array().cast("array<string>"))
    call = F.struct(turn.cast("string").alias("id"), F.lit("answer").alias("name"), F.struct(text.alias("question"), "turn").alias("arguments"), before.alias("after"))
    asked = F.to_json(F.struct(F.lit("").alias("content"), F.array(call).alias("tool_calls")))
    answered = F.to_json(F.struct((turn - 1).cast("string").alias("tool_call_id"), text.alias("content")))
    return conversations.select("conv_id", "turn", "role", F.when(held("text"), F.col("text")).when(F.col("role") == "user", asked).when(F.col("role") == "assistant", answered).otherwise(F.col("text")).alias("text"))
