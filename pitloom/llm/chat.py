"""Tool calls and their results: linked by id, ordered, validated and written as canonical JSON."""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranks import numbered
from .schemas import checked, problems
from .session import checkpointed

def canonical(value: object) -> str:
    """Sorted keys, no spaces; half surrogate pairs, which UTF-8 can't hold, stay escaped."""
    out = json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)
    return out if out.isprintable() or not _HALF.search(out) else _HALF.sub(lambda m: f"\\u{ord(m[0]):04x}", out)


_HALF = re.compile("[\ud800-\udfff]")


def _no_constant(x: str):
    raise ValueError(x)


def _finite(x: str) -> float:
    if math.isinf(value := float(x)):
        raise ValueError(x)
    return value


def _members(pairs: list[tuple[str, object]]) -> dict:
    if len(members := dict(pairs)) < len(pairs):
        raise ValueError("repeated key")
    return members


def parsed(arguments: str | None) -> object:
    """The value of JSON that canonical can write again; ValueError for anything else, repeated keys, infinite numbers and nesting too deep included."""
    try:
        value = json.loads(arguments or "", parse_constant=_no_constant, parse_float=_finite, object_pairs_hook=_members)
        canonical(value)
        return value
    except RecursionError as e:
        raise ValueError("nested too deep") from e


def _written(schemas: dict[str, dict]):
    names = ["conv_id", "turn", "kind", "call_id", "status", "step", "errors", "json"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                errors, kind = [], r["kind"]
                if kind == "call":
                    value, good = None, False
                    try:
                        value, good = parsed(r["arguments"]), True
                    except ValueError:
                        errors.append("$: not JSON")
                    if r["name"] not in schemas:
                        errors.append("unknown tool")
                    elif good:
                        errors += problems(value, schemas[r["name"]])
                    body = {"role": "assistant", "tool_call": {"id": r["call_id"], "name": r["name"], "arguments": value if good else r["arguments"]}}
                elif kind == "result":
                    body = {"role": "tool", "tool_call_id": r["call_id"], "content": r["content"]}
                else:
                    body = {"role": r["role"], "content": r["content"]}
                out.append((r["conv_id"], r["turn"], kind, r["call_id"], r["status"], r["step"], errors, canonical(body)))
            types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.list_(pa.string()), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate(types)], names=names)

    return run


def _chains(edges: DataFrame) -> DataFrame:
    """(conv_id, call_id, root, dist) of calls that wait for one call each, given as (conv_id, call_id, on).

    root is the first call up the chain that is not among them, dist calls
    away.  Pointers double, so a chain takes rounds in the logarithm of its
    length; a call on a cycle, or that leads to one, has no row.
    """
    key = ["conv_id", "call_id"]
    open_, found = edges.withColumn("dist", F.lit(1)), None
    while True:
        ahead = open_.select("conv_id", F.col("call_id").alias("on"), F.col("on").alias("_on"), F.col("dist").alias("_dist"), F.lit(False).alias("_ends"))
        if found is not None:
            ahead = ahead.unionByName(found.select("conv_id", F.col("call_id").alias("on"), F.col("root").alias("_on"), F.col("dist").alias("_dist"), F.lit(True).alias("_ends")))
        step = checkpointed(open_.join(ahead, ["conv_id", "on"], "left"))
        ends = step.where("coalesce(_ends, true)").select(*key, F.coalesce("_on", "on").alias("root"), (F.col("dist") + F.coalesce("_dist", F.lit(0))).alias("dist"))
        if ends.isEmpty():  # a round reaches twice as far, so what is left has no end
            return ends if found is None else found
        found = checkpointed(ends if found is None else found.unionByName(ends))
        open_ = step.where("not _ends").select(*key, F.col("_on").alias("on"), (F.col("dist") + F.col("_dist")).alias("dist"))


def _levels(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, level): calls that wait for others come after them; a call on a cycle has no row.

    Chains of calls that wait for one call each count as one step; a round for
    each level of the calls that wait for several.
    """
    key = ["conv_id", "call_id"]
    edges = checkpointed(calls.select(*key, F.explode("depends_on").alias("on")).distinct())
    known = calls.select("conv_id", F.col("call_id").alias("on")).distinct()
    edges = checkpointed(edges.join(known, ["conv_id", "on"], "left_semi"))
    waits = checkpointed(edges.groupBy(*key).agg(F.count(F.lit(1)).alias("n")))
    every = calls.select(*key).distinct()
    done = every.join(waits, key, "left_anti").withColumn("level", F.lit(0))
    if waits.isEmpty():
        return done
    chains = _chains(edges.join(waits.where("n = 1"), key, "left_semi"))
    several = checkpointed(waits.where("n > 1").select(*key))
    if several.isEmpty():
        return done.unionByName(chains.select(*key, F.col("dist").alias("level")))
    ends = chains.select("conv_id", F.col("call_id").alias("on"), "root", "dist")
    ends = ends.unionByName(every.join(waits.where("n = 1"), key, "left_anti").select("conv_id", F.col("call_id").alias("on"), F.col("call_id").alias("root"), F.lit(0).alias("dist")))
    edges = checkpointed(edges.join(several, key, "left_semi").join(ends, ["conv_id", "on"], "left").select(*key, "root", "dist"))
    done, left = checkpointed(done), several
    while True:
        ready = edges.join(left, key, "left_semi").join(done.select("conv_id", F.col("call_id").alias("root"), "level"), ["conv_id", "root"], "left")
        ready = checkpointed(ready.groupBy(*key).agg(F.max(F.col("level") + F.col("dist") + 1).alias("level"), F.max(F.col("level").isNull()).alias("open")).where("not open").select(*key, "level"))
        if ready.isEmpty():
            break
        done = checkpointed(done.unionByName(ready))
        left = checkpointed(left.join(ready, key, "left_anti"))
    below = chains.join(done.select("conv_id", F.col("call_id").alias("root"), "level"), ["conv_id", "root"]).select(*key, (F.col("level") + F.col("dist")).alias("level"))
    return done.unionByName(below)


def link_tool_calls(events: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """(conv_id, turn, kind, call_id, status, step, errors, json) of every event.

    events: conv_id, turn, kind (call, result or message), role, call_id,
    name, arguments (JSON), depends_on (ids of the calls it waits for) and
    content.  Calls and results meet by (conv_id, call_id) in hash joins.
    status is linked, unanswered (a call), orphan (a result), duplicate (a
    later call or result of one id, by turn, then content), cycle, or null for
    a message.  Ordered by step, a conversation's calls follow what they wait
    for and results follow their calls; dependencies on unknown ids are
    dropped.  json has sorted keys and no spaces.  Calls and results without
    an id, or a conv_id, link with nothing.  Arguments that are no JSON, repeat a
    key, hold an infinite number or nest too deep are reported and written as
    text.  A schema with keywords that schemas.checked doesn't know is refused
    before the job.  Repeated rows count as duplicates of each other, but each
    is returned.
    """
    for name, schema_ in schemas.items():
        checked(schema_, name)
    columns = ["conv_id", "turn", "kind", "role", "call_id", "name", "arguments", "depends_on", "content"]
    rows = checkpointed(events.select(*columns).withColumn("_order", F.xxhash64("arguments", "content")))
    key = ["conv_id", "call_id"]
    named = rows.where("conv_id is not null and call_id is not null")
    first = named.where("kind in ('call', 'result')").groupBy(*key).agg(
        F.min(F.when(F.col("kind") == "call", F.struct("turn", "_order"))).alias("call"),
        F.min(F.when(F.col("kind") == "result", F.struct("turn", "_order"))).alias("result"),
        F.count(F.when(F.col("kind") == "call", 1)).alias("calls"),
        F.count(F.when(F.col("kind") == "result", 1)).alias("results"),
    )
    calls = named.where("kind = 'call'").join(first.select(*key, "call"), key).where(F.struct("turn", "_order") == F.col("call")).select(*key, "depends_on")
    level = checkpointed(_levels(calls))
    linked = rows.join(first, key, "left").join(level, key, "left")
    own = F.when(F.col("kind") == "call", F.col("call")).otherwise(F.col("result"))
    other = F.when(F.col("kind") == "call", F.col("result")).otherwise(F.col("call"))
    status = (
        F.when(~F.col("kind").isin("call", "result"), F.lit(None)).when(own.isNotNull() & (F.struct("turn", "_order") != own), "duplicate")
        .when(other.isNull(), F.when(F.col("kind") == "call", "unanswered").otherwise("orphan")).when(F.col("level").isNull(), "cycle").otherwise("linked")
    )
    step = F.when(F.col("kind") == "call", F.col("level") * 2).when(F.col("kind") == "result", F.col("level") * 2 + 1)
    schema = "conv_id long, turn long, kind string, call_id string, status string, step int, errors array<string>, json string"
    return linked.select(*columns, status.alias("status"), step.cast("int").alias("step")).mapInArrow(_written(schemas), schema)


def turns_as_calls(conversations: DataFrame) -> DataFrame:
    """Events of plain conversations: a user's turn calls `respond`, the assistant's next turn is its result.

    Each call waits for the call before it in its conversation.  That one is
    found by positions in all calls, so a long conversation is not one task.
    """
    turn = F.col("turn").cast("long")
    calls = conversations.where("role = 'user'").select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("turn")).where("conv_id is not null and turn is not null").distinct()
    calls = checkpointed(numbered(calls, [F.col("conv_id"), F.col("turn")], "_at"))
    before = calls.select("conv_id", (F.col("_at") + 1).alias("_at"), F.concat_ws(":", "conv_id", "turn").alias("_before"))
    before = calls.join(before, ["conv_id", "_at"]).select(F.col("conv_id").alias("_conv"), F.col("turn").alias("_turn"), F.lit("user").alias("_role"), "_before")
    rows = conversations.select("conv_id", "role", "text", turn.alias("turn")).withColumn("conv_id", F.col("conv_id").cast("long"))
    rows = rows.join(before, (F.col("conv_id") == F.col("_conv")) & (F.col("turn") == F.col("_turn")) & (F.col("role") == F.col("_role")), "left")
    user, assistant, turn = F.col("role") == "user", F.col("role") == "assistant", F.col("turn")
    return rows.select(
        "conv_id", "turn",
        F.when(user, "call").when(assistant, "result").otherwise("message").alias("kind"), "role",
        F.when(user, F.concat_ws(":", "conv_id", turn)).when(assistant, F.concat_ws(":", "conv_id", turn - 1)).alias("call_id"),
        F.when(user, "respond").alias("name"),
        F.when(user, F.to_json(F.struct(F.col("text").alias("prompt"), F.length("text").alias("chars")))).alias("arguments"),
        F.when(F.col("_before").isNotNull(), F.array("_before")).otherwise(F.array().cast("array<string>")).alias("depends_on"),
        F.when(~user | F.col("role").isNull(), F.col("text")).alias("content"),
    )
