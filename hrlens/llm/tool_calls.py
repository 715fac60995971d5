"""Operator 8: linking tool calls with their results for chat training data.

Calls and results are hash-joined on (conversation, identifier).  A call's arguments are validated
against its tool's schema; ``{"$ref": "<call id>"}`` anywhere in them means that the call uses
another call's result.  Calls are ordered topologically: ``step`` is the recorded turn, or one more
than the last step of the calls it uses if that is later.

Conversations of up to ``GROUP_ITEMS`` calls and references (all but few) are ordered one row each:
calls whose used calls are all placed are placed, and what can't be placed is on a cycle or behind
one.  Longer ones are never gathered in one task: ``step`` starts as the turn and a call recorded at
or before one it uses is pushed behind it.  Only calls that moved in the last round push others, and
each round writes the calls that moved so far, so the rounds follow the longest run of disorder in
one conversation.  A conversation that is pushed for more rounds than calls moved in it has a cycle
and leaves the rounds; all conversations share them.

Each row carries the exchange as canonical JSON: sorted keys, no spaces, no escapes beyond JSON's.

Defined cases: repeated identifiers keep the earliest record (by turn, then content); calls without
result are ``pending``, results without call ``orphan``; records with a null conversation or
identifier are returned one by one and never linked; null or broken arguments, unknown tools and
unknown references are errors of the call; a call on or behind a cycle is ``cyclic``, keeps its
turn as step and sorts behind the others; a call that uses itself is a cycle; a call without a turn
is placed as if recorded at turn 0; empty tables give no rows.  Only the named columns are read.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hrlens.llm.store import staged

#: calls and references of a conversation that one task orders at once; a bound on memory, not on results
GROUP_ITEMS = 20_000

_TYPES = {"string": str, "boolean": bool, "object": dict, "array": list, "null": type(None)}


def canonical(value: Any) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def _is(value: Any, kind: str) -> bool:
    if kind in ("integer", "number"):
        whole = isinstance(value, int) or isinstance(value, float) and value.is_integer()
        return not isinstance(value, bool) and (whole if kind == "integer" else isinstance(value, (int, float)))
    return kind in _TYPES and isinstance(value, _TYPES[kind])


def violations(value: Any, schema: dict, at: str = "$") -> list[str]:
    """Where ``value`` breaks the schema (type, enum, bounds, lengths, required, properties, items).
    A reference to another call fits any type."""
    if isinstance(value, dict) and set(value) == {"$ref"}:
        return []
    kind = schema.get("type")
    if kind and not _is(value, kind):
        return [f"{at}: not {kind}"]
    found = []
    if "enum" in schema and value not in schema["enum"]:
        found.append(f"{at}: not in enum")
    if _is(value, "number"):
        if value < schema.get("minimum", value):
            found.append(f"{at}: below minimum")
        if value > schema.get("maximum", value):
            found.append(f"{at}: above maximum")
    if isinstance(value, str):
        if len(value) < schema.get("minLength", 0):
            found.append(f"{at}: too short")
        if len(value) > schema.get("maxLength", len(value)):
            found.append(f"{at}: too long")
    if isinstance(value, dict):
        known = schema.get("properties", {})
        found += [f"{at}.{k}: missing" for k in schema.get("required", []) if k not in value]
        for k, v in value.items():
            if k in known:
                found += violations(v, known[k], f"{at}.{k}")
            elif schema.get("additionalProperties", True) is False:
                found.append(f"{at}.{k}: unknown")
    if isinstance(value, list) and "items" in schema:
        for i, v in enumerate(value):
            found += violations(v, schema["items"], f"{at}[{i}]")
    return found


def references(value: Any) -> list[str]:
    """Identifiers of the calls that an argument value uses."""
    found, todo = set(), [value]
    while todo:
        x = todo.pop()
        if isinstance(x, dict):
            if set(x) == {"$ref"} and isinstance(x["$ref"], str):
                found.add(x["$ref"])
            todo += x.values()
        elif isinstance(x, list):
            todo += x
    return sorted(found)


def _parse(schemas: dict[str, dict]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for name, raw in zip(batch["name"].to_pylist(), batch["arguments"].to_pylist()):
                errors, args, refs = [], None, []
                try:
                    value = json.loads(raw) if raw is not None else None
                except (ValueError, RecursionError):
                    errors.append("$: not JSON")
                else:
                    args, refs = canonical(value), references(value)
                    if raw is None:
                        errors.append("$: no arguments")
                    elif name in schemas:
                        errors += violations(value, schemas[name])
                if name not in schemas:
                    errors.append("unknown tool")
                out.append((args, sorted(errors), refs))
            args, errors, refs = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [*(batch[c] for c in ("conv_id", "call_id", "turn", "name")), pa.array(args, pa.string()),
                 pa.array(errors, pa.list_(pa.string())), pa.array(refs, pa.list_(pa.string()))],
                names=["conv_id", "call_id", "turn", "name", "args", "errors", "refs"])
    return run


_OUT = ["conv_id", "call_id", "turn", "step", "name", "status", "valid", "cyclic", "errors", "message"]


def _serialise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        messages = []
        for r in batch.select(["call_id", "name", "args", "status", "content"]).to_pylist():
            out = {"id": r["call_id"], "status": r["status"]}
            if r["status"] != "orphan":
                out |= {"name": r["name"], "arguments": json.loads(r["args"]) if r["args"] is not None else None}
            if r["status"] != "pending":
                out["result"] = r["content"]
            messages.append(canonical(out))
        yield pa.RecordBatch.from_arrays([*(batch[c] for c in _OUT[:-1]), pa.array(messages, pa.string())], names=_OUT)


def _earliest(rows: DataFrame, names: list[str]) -> DataFrame:
    """One record per identifier; records without one stay as they are."""
    named = F.col("conv_id").isNotNull() & F.col("call_id").isNotNull()
    best = (rows.filter(named).groupBy("conv_id", "call_id").agg(F.min(F.struct(*names)).alias("r"))
            .select("conv_id", "call_id", *[F.col("r")[c].alias(c) for c in names]))
    return best.unionByName(rows.filter(~named).select("conv_id", "call_id", *names))


def _place(ids: list[str], turns: list[int], refs: list[list[str]]) -> tuple[list[int], list[bool]]:
    """(step, on or behind a cycle) of one conversation's calls; unknown references don't count."""
    at = {x: i for i, x in enumerate(ids)}
    used = [{at[r] for r in rs if r in at} for rs in refs]
    users: list[list[int]] = [[] for _ in ids]
    for i, parents in enumerate(used):
        for p in parents:
            users[p].append(i)
    steps, left = list(turns), [len(p) for p in used]
    ready = [i for i, n in enumerate(left) if not n]
    for i in ready:  # grows while calls become free
        for j in users[i]:
            steps[j] = max(steps[j], steps[i] + 1)
            left[j] -= 1
            if not left[j]:
                ready.append(j)
    return steps, [n > 0 for n in left]


def _place_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        conv, ids, step, cyclic = [], [], [], []
        for conv_id, listed in zip(batch["conv_id"], batch["calls"]):
            calls = listed.as_py()  # one conversation at a time
            names = [c["call_id"] for c in calls]
            steps, bad = _place(names, [c["turn"] for c in calls], [c["refs"] or [] for c in calls])
            conv += [conv_id.as_py()] * len(names)
            ids += names
            step += steps
            cyclic += bad
        yield pa.RecordBatch.from_arrays([pa.array(conv, pa.int64()), pa.array(ids, pa.string()), pa.array(step, pa.int64()),
                                          pa.array(cyclic, pa.bool_())], names=["conv_id", "call_id", "step", "cyclic"])


def _push(calls: DataFrame, edges: DataFrame) -> DataFrame:
    """``conv_id, call_id, step, cyclic`` of long conversations, by joins in rounds."""
    key = ["conv_id", "call_id"]
    base = staged(calls.select(*key, F.col("turn").alias("step")), "tool-base")
    edges = staged(edges, "tool-edges")
    none = base.limit(0)
    late, stuck, front, rounds = none, none.select(*key), base, 0
    while True:
        need = (edges.join(front.select("conv_id", F.col("call_id").alias("parent"), F.col("step").alias("ps")), ["conv_id", "parent"])
                .groupBy("conv_id", F.col("child").alias("call_id")).agg((F.max("ps") + 1).alias("need")))
        now = need.join(base, key).join(late.withColumnRenamed("step", "later"), key, "left")
        front = staged(now.filter(F.col("need") > F.coalesce("later", "step")).select(*key, F.col("need").alias("step")), "tool-front")
        if front.isEmpty():
            break
        rounds += 1
        late = staged(late.unionByName(front).groupBy(*key).agg(F.max("step").alias("step")), "tool-late")
        # a chain of pushes without a cycle can't be longer than the calls it moved; every cycle has a call in the front
        turning = staged(front.join(late.groupBy("conv_id").count().filter(F.col("count") < rounds), "conv_id", "left_semi"), "tool-turning")
        if not turning.isEmpty():
            stuck = staged(stuck.unionByName(turning.select(*key)), "tool-stuck")
            front = front.join(turning.select("conv_id").distinct(), "conv_id", "left_anti")
    more = stuck
    while not more.isEmpty():  # what such a call leads to is on the cycle or behind it
        more = staged(edges.join(more.select("conv_id", F.col("call_id").alias("parent")), ["conv_id", "parent"], "left_semi")
                      .select("conv_id", F.col("child").alias("call_id")).distinct().join(stuck, key, "left_anti"), "tool-behind")
        stuck = staged(stuck.unionByName(more), "tool-stuck")
    return (base.join(late.withColumnRenamed("step", "later"), key, "left").join(stuck.withColumn("c", F.lit(True)), key, "left")
            .select(*key, F.coalesce("later", "step").alias("step"), F.coalesce("c", F.lit(False)).alias("cyclic")))


def _steps(calls: DataFrame, edges: DataFrame, group_items: int) -> DataFrame:
    """``conv_id, call_id, step, cyclic`` of the identified calls."""
    calls = (calls.filter("conv_id is not null and call_id is not null")
             .select("conv_id", "call_id", F.coalesce("turn", F.lit(0)).alias("turn"), "refs"))
    long = staged(calls.groupBy("conv_id").agg(F.sum(1 + F.size("refs")).alias("items")).filter(F.col("items") > group_items)
                  .select("conv_id"), "tool-long")
    some = not long.isEmpty()
    short = calls.join(long, "conv_id", "left_anti") if some else calls
    placed = (short.groupBy("conv_id").agg(F.collect_list(F.struct("call_id", "turn", "refs")).alias("calls"))
              .mapInArrow(_place_all, "conv_id long, call_id string, step long, cyclic boolean"))
    if not some:
        return placed
    return placed.unionByName(_push(calls.join(long, "conv_id", "left_semi"), edges.join(long, "conv_id", "left_semi")))


def link(calls: DataFrame, results: DataFrame, schemas: dict[str, dict], group_items: int = GROUP_ITEMS) -> DataFrame:
    """One row per identified call or orphan result.

    ``calls``: conv_id, call_id, turn, name, arguments (JSON); ``results``: conv_id, call_id, turn,
    content.  Within a conversation, (cyclic, step, turn, call_id) is a topological order.
    """
    text = lambda c: F.col(c).cast("string").alias(c)
    number = lambda c: F.col(c).cast("long").alias(c)
    asked = _earliest(calls.select(number("conv_id"), text("call_id"), number("turn"), text("name"), text("arguments")),
                      ["turn", "name", "arguments"])
    parsed = staged(asked.mapInArrow(
        _parse(schemas), "conv_id long, call_id string, turn long, name string, args string, errors array<string>, refs array<string>"),
        "tool-calls")
    answers = _earliest(results.select(number("conv_id"), text("call_id"), number("turn"), text("content")), ["turn", "content"])
    known = parsed.filter("conv_id is not null and call_id is not null").select("conv_id", F.col("call_id").alias("parent"))
    wanted = parsed.filter("conv_id is not null and call_id is not null").select(
        "conv_id", F.col("call_id").alias("child"), F.explode("refs").alias("parent"))
    steps = _steps(parsed, wanted.join(known, ["conv_id", "parent"]), group_items)
    lost = (wanted.join(known, ["conv_id", "parent"], "left_anti").groupBy("conv_id", F.col("child").alias("call_id"))
            .agg(F.collect_set(F.concat(F.lit("unknown reference "), "parent")).alias("lost")))
    key = ["conv_id", "call_id"]
    none = F.array().cast("array<string>")
    rows = (parsed.withColumn("is_call", F.lit(True))
            .join(answers.select(*key, F.col("turn").alias("answer_turn"), "content").withColumn("is_result", F.lit(True)), key, "full")
            .join(steps, key, "left").join(lost, key, "left"))
    status: Column = (F.when(F.col("is_call").isNull(), "orphan").when(F.col("is_result").isNull(), "pending").otherwise("linked"))
    errors = F.array_sort(F.concat(F.coalesce("errors", none), F.coalesce("lost", none)))
    rows = rows.select(
        *key, F.coalesce("turn", "answer_turn").alias("turn"),
        F.when(F.coalesce("cyclic", F.lit(False)), F.col("turn")).otherwise(F.coalesce("step", "turn", "answer_turn")).alias("step"),
        "name", status.alias("status"), (F.col("is_call").isNotNull() & (F.size(errors) == 0)).alias("valid"),
        F.coalesce("cyclic", F.lit(False)).alias("cyclic"), errors.alias("errors"), "args", "content")
    return rows.mapInArrow(_serialise, "conv_id long, call_id string, turn long, step long, name string, status string, "
                                       "valid boolean, cyclic boolean, errors array<string>, message string")
