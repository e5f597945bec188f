"""Operator 7: linking tool calls to their results in chats.

Calls and results meet in a hash join on (conversation, call identifier).
Calls stand in topological order of what they need: a call's level is its
longest chain of needs, in every conversation, and cycles are flagged.
Arguments are validated against the tool's schema, and each call is serialised
as canonical JSON.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialise

CALLS = "array<struct<id string, name string, arguments string, needs array<string>>>"
#: Needs of a conversation that are ordered in one row; conversations with more are ordered in rounds over joins.
GROUP_EDGES = 20_000
TYPES = {"string": str, "integer": int, "number": (int, float), "boolean": bool, "array": list, "object": dict}
#: The schemas of the tools that plain two-sided chats are read as calls of: a question must be an ordinary message, a statement must have some text.
REPLY_SCHEMAS = {
    "ask": {
        "type": "object",
        "properties": {"question": {"type": "string", "minLength": 2, "maxLength": 2000}, "turn": {"type": "integer", "minimum": 0}},
        "required": ["question", "turn"],
        "additionalProperties": False,
    },
    "tell": {
        "type": "object",
        "properties": {"statement": {"type": "string", "minLength": 1, "maxLength": 20000}, "turn": {"type": "integer", "minimum": 0}},
        "required": ["statement", "turn"],
        "additionalProperties": False,
    },
}


def problems(value, schema: dict, at: str = "$") -> list[str]:
    """What of a value breaks a JSON schema of the keywords type, enum, minimum, maximum, minLength, maxLength, properties, required, additionalProperties and items."""
    kind = schema.get("type")
    if kind and (not isinstance(value, TYPES[kind]) or isinstance(value, bool) and kind in ("integer", "number")):
        return [f"{at}: not {kind}"]
    out = []
    if "enum" in schema and value not in schema["enum"]:
        out.append(f"{at}: not in enum")
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        out += [f"{at}: below minimum"] * (value < schema.get("minimum", value)) + [f"{at}: above maximum"] * (value > schema.get("maximum", value))
    if isinstance(value, str):
        out += [f"{at}: too short"] * (len(value) < schema.get("minLength", 0)) + [f"{at}: too long"] * (len(value) > schema.get("maxLength", len(value)))
    if isinstance(value, dict):
        known = schema.get("properties", {})
        out += [f"{at}.{k}: missing" for k in schema.get("required", []) if k not in value]
        if schema.get("additionalProperties") is False:
            out += [f"{at}.{k}: unknown" for k in sorted(value) if k not in known]
        for k in sorted(value):
            if k in known:
                out += problems(value[k], known[k], f"{at}.{k}")
    if isinstance(value, list) and "items" in schema:
        for i, x in enumerate(value):
            out += problems(x, schema["items"], f"{at}[{i}]")
    return out


def canonical(value) -> str:
    """JSON with sorted keys, no spaces and no escapes beyond the needed ones."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def _parsed(arguments: str | None):
    """(value, errors) of a call's arguments; what has no canonical JSON (NaN, infinities, lone surrogates, bottomless nesting) is an error."""
    try:
        value = json.loads(arguments or "null", parse_constant=_refuse)
        canonical(value).encode()
    except RecursionError:
        return None, ["arguments: nested too deeply"]
    except UnicodeEncodeError:
        return None, ["arguments: no Unicode text"]
    except ValueError:
        return None, ["arguments: no JSON"]
    return value, []


def _refuse(constant: str):
    raise ValueError(constant)


def ordered(edges: list[tuple[str, str]]) -> list[tuple[str, int, bool]]:
    """(call, level, cyclic) of the calls that need others: level is the longest chain of needs below a call.

    Calls on a cycle, or needing one, are cyclic and stand one level above all others.
    """
    needs, users = {}, {}
    for call, need in edges:
        needs.setdefault(call, set()).add(need)
        users.setdefault(need, set()).add(call)
    waiting, levels = {c: len(n) for c, n in needs.items()}, {}
    ready, level = [n for n in users if n not in needs], 0
    while ready:
        level, taken, ready = level + 1, ready, []
        for need in taken:
            for call in users.get(need, ()):
                waiting[call] -= 1
                if not waiting[call]:
                    levels[call] = level
                    ready.append(call)
    top = max(levels.values(), default=0) + 1
    return [(c, levels.get(c, top), c not in levels) for c in sorted(needs)]


def _levels_by_group(edges: DataFrame) -> DataFrame:
    """Levels where each conversation's edges fit in one row."""
    kind = dict(edges.dtypes)["conv_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, found = [], []
            for i, pairs in enumerate(batch.column(1).to_pylist()):
                rows = ordered([(x["call_id"], x["need"]) for x in pairs])
                at += [i] * len(rows)
                found += rows
            call, level, cyclic = zip(*found) if found else ((), (), ())
            columns = [batch.column(0).take(pa.array(at, pa.int64())), pa.array(call, pa.string()), pa.array(level, pa.int64()), pa.array(cyclic, pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, names=["conv_id", "call_id", "level", "cyclic"])

    grouped = edges.groupBy("conv_id").agg(F.collect_list(F.struct("call_id", "need")).alias("edges"))
    return grouped.mapInArrow(run, f"conv_id {kind}, call_id string, level long, cyclic boolean")


def _levels_by_rounds(edges: DataFrame) -> DataFrame:
    """The same levels for conversations of any size: each round is a join that takes the calls whose needs are all taken."""
    key = ["conv_id", "call_id"]
    left = materialise(edges.select(key).distinct())
    taken, level = left.limit(0).withColumn("level", F.lit(0).cast("long")), 0
    while not left.isEmpty():
        waits = edges.join(left.withColumnRenamed("call_id", "need"), ["conv_id", "need"], "left_semi").select(key).distinct()
        ready = materialise(left.join(waits, key, "left_anti"))
        if ready.isEmpty():
            break
        level += 1
        taken = taken.unionByName(ready.withColumn("level", F.lit(level).cast("long")))
        left = materialise(left.join(ready, key, "left_anti"))
    top = taken.groupBy("conv_id").agg(F.max("level").alias("top"))
    rest = left.join(top, "conv_id", "left").select(*key, (F.coalesce("top", F.lit(0)) + 1).cast("long").alias("level"), F.lit(True).alias("cyclic"))
    return taken.withColumn("cyclic", F.lit(False)).unionByName(rest)


def _levels(calls: DataFrame, group_edges: int = GROUP_EDGES) -> DataFrame:
    """(conv_id, call_id, level, cyclic) of the calls that need known calls.

    Conversations of up to group_edges needs are ordered each in one row,
    larger ones in rounds over joins; both give the same levels.
    """
    known = calls.select("conv_id", F.col("call_id").alias("need")).distinct()
    edges = calls.select("conv_id", "call_id", F.explode("needs").alias("need")).where("call_id IS NOT NULL").distinct()
    edges = materialise(edges.join(known, ["conv_id", "need"]).select("conv_id", "call_id", "need"))
    large = materialise(edges.groupBy("conv_id").count().where(F.col("count") > group_edges).select("conv_id"))
    if large.isEmpty():
        return _levels_by_group(edges)
    return _levels_by_group(edges.join(large, "conv_id", "left_anti")).unionByName(_levels_by_rounds(materialise(edges.join(large, "conv_id", "left_semi"))))


def link(messages: DataFrame, schemas: dict[str, dict], group_edges: int = GROUP_EDGES) -> DataFrame:
    """One row for each call, and one for each result without a call.

    messages: conv_id, turn, text, tool_calls (CALLS) and tool_call_id; a row
    may have calls, be a result, both or neither. Output: conv_id, turn, nth
    (of the call in its message), call_id, name, level (0 for a call without
    known needs, else one above the highest that it needs), status (linked, no_result, no_call, cyclic), n_results,
    result_turn, valid, errors, canonical. Order by (conv_id, level, turn, nth)
    is topological.

    Nulls: calls without an id are kept as no_result, results with a null
    tool_call_id aren't results, null needs are none and a need of an unknown
    call is an error. A call that repeats an identifier of its conversation is
    an error on each of its rows, which share the needs of all; of several results the one of least (turn,
    text) is linked, n_results counts all. Arguments that are no JSON object,
    that hold NaN, infinities, lone surrogates or nesting beyond Python's
    limit, or of a tool without a schema are errors. Empty tables give no rows.
    """
    calls = (
        messages.select("conv_id", "turn", F.posexplode("tool_calls").alias("nth", "call"))
        .select("conv_id", "turn", "nth", F.col("call.id").alias("call_id"), F.col("call.name").alias("name"), F.col("call.arguments").alias("arguments"), F.array_distinct(F.coalesce("call.needs", F.array().cast("array<string>"))).alias("needs"))
    )
    key = ["conv_id", "call_id"]
    results = (
        messages.where(F.col("tool_call_id").isNotNull())
        .groupBy("conv_id", F.col("tool_call_id").alias("call_id"))
        .agg(F.count("*").alias("n_results"), F.min(F.struct("turn", "text")).alias("result"))
    )
    seen = calls.groupBy(key).agg(F.count("*").alias("n_calls"))
    needed = calls.select("conv_id", "call_id", F.explode("needs").alias("need")).join(seen.select("conv_id", F.col("call_id").alias("need"), F.lit(True).alias("known")), ["conv_id", "need"], "left")
    unknown = needed.where(F.col("known").isNull()).groupBy(key).agg(F.array_sort(F.collect_set("need")).alias("unknown_needs"))
    linked = calls.join(seen, key, "left").join(unknown, key, "left").join(results, key, "full_outer")
    linked = linked.join(_levels(calls, group_edges), key, "left")
    status = F.when(F.col("turn").isNull(), "no_call").when(F.coalesce("cyclic", F.lit(False)), "cyclic").when(F.col("result").isNull(), "no_result").otherwise("linked")
    names = ["conv_id", "turn", "nth", "call_id", "name", "level", "status", "n_results", "result_turn", "valid", "errors", "canonical"]
    flat = linked.select(
        "conv_id", "turn", "nth", "call_id", "name", F.coalesce("level", F.lit(0)).cast("long").alias("level"), status.alias("status"),
        F.coalesce("n_results", F.lit(0)).cast("long").alias("n_results"), F.col("result.turn").alias("result_turn"),
        "arguments", "needs", "n_calls", "unknown_needs", F.col("result.text").alias("result_text"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            valid, errors, text = [], [], []
            for r in batch.to_pylist():
                found, args = [], None
                if r["status"] != "no_call":
                    args, found = _parsed(r["arguments"])
                    if not found:
                        found += problems(args, {"type": "object"} | schemas[r["name"]]) if r["name"] in schemas else ["name: no schema"]
                    found += ["id: missing"] * (r["call_id"] is None) + ["id: repeated"] * ((r["n_calls"] or 1) > 1)
                    found += [f"needs {x}: unknown" for x in r["unknown_needs"] or []]
                valid.append(not found and r["status"] != "no_call")
                errors.append(found)
                text.append(canonical({"id": r["call_id"], "name": r["name"], "arguments": args, "needs": sorted(x for x in r["needs"] or [] if x is not None), "result": r["result_text"]}))
            kept = [batch.column(n) for n in names[:9]]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(valid, pa.bool_()), pa.array(errors, pa.list_(pa.string())), pa.array(text, pa.string())], names=names)

    kinds = dict(flat.dtypes)
    return flat.mapInArrow(run, ", ".join(f"{n} {kinds[n]}" for n in names[:9]) + ", valid boolean, errors array<string>, canonical string")


def as_tool_messages(conversations: DataFrame) -> DataFrame:
    """Two-sided chats as calls and results: each user turn calls ``ask`` (a text that ends in a question mark) or
    ``tell``, needing the call two turns before where that is a user turn as well, and the assistant's next turn is the
    result. Other rows pass as text. A null text gives a call without its argument, which its schema refuses; rows of
    null conv_id or turn have calls without an identifier; a repeated user turn repeats its call's identifier."""
    ident = lambda turn: F.concat(F.lit("call-"), F.col("conv_id").cast("string"), F.lit("-"), turn.cast("string"))
    users = conversations.where(F.col("role") == "user").select("conv_id", (F.col("turn") + 2).alias("turn"), F.lit(True).alias("asked")).distinct()
    asks = F.coalesce(F.col("text").rlike(r"\?\s*$"), F.lit(False))
    args = F.when(asks, F.to_json(F.struct(F.col("text").alias("question"), "turn"))).otherwise(F.to_json(F.struct(F.col("text").alias("statement"), "turn")))
    needs = F.when(F.col("asked"), F.array(ident(F.col("turn") - 2))).otherwise(F.array().cast("array<string>"))
    call = F.struct(ident(F.col("turn")).alias("id"), F.when(asks, "ask").otherwise("tell").alias("name"), args.alias("arguments"), needs.alias("needs"))
    return conversations.join(users, ["conv_id", "turn"], "left").select(
        "conv_id", "turn", "text",
        F.when(F.col("role") == "user", F.array(call)).otherwise(F.array().cast(CALLS)).alias("tool_calls"),
        F.when(F.col("role") == "assistant", ident(F.col("turn") - 1)).alias("tool_call_id"),
    )
