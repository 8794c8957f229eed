"""Tool-call linking: calls meet their results by identifier, in topological order, as canonical JSON.

Calls and results are hash-joined by (conversation, call id).  Calls may name calls
they depend on; a call's level is one more than its dependencies' highest.  The calls
of a conversation of bounded size are put in order by the task that holds them; those
of larger ones in rounds of joins, one for each level, so that no task holds them all.
Calls are placed by level, then turn.  Arguments are checked against the tool's JSON
schema, and every call becomes one JSON object with sorted keys and no spare space.
"""

from __future__ import annotations

import json
import math
import re
import uuid
from collections import Counter, defaultdict, deque
from collections.abc import Iterator
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from .common import discard, durable, number_rows, settle, shared_dir

TURNS_PER_BUCKET = 20_000
#: Calls and dependencies of a conversation that one task puts in order; larger conversations take a round of joins for each level.
MOST_IN_TASK = 100_000
_NEVER = (1 << 31) - 1
_TYPES = {
    "object": dict, "array": list, "string": str, "boolean": bool, "null": type(None), "integer": int, "number": (int, float),
}


def _is(value, kind: str) -> bool:
    if isinstance(value, bool) and kind in ("integer", "number"):
        return False
    return isinstance(value, _TYPES[kind]) or kind == "integer" and isinstance(value, float) and value.is_integer()


#: Keywords that say something about values, and those that don't.
_CHECKED = frozenset(
    "type enum const required properties patternProperties additionalProperties minProperties maxProperties items minItems maxItems uniqueItems "
    "minLength maxLength pattern minimum maximum exclusiveMinimum exclusiveMaximum multipleOf allOf anyOf oneOf not $ref".split()
)
_SILENT = frozenset("title description default examples format $schema $id $comment $defs definitions deprecated readOnly writeOnly".split())


def _target(root, ref: str):
    """What a reference within the schema points at."""
    if not isinstance(ref, str) or not (ref == "#" or ref.startswith("#/")):
        raise ValueError(f"reference out of the schema: {ref}")
    found = root
    for part in ref.split("/")[1:]:
        part = part.replace("~1", "/").replace("~0", "~")
        if not isinstance(found, dict) or part not in found:
            raise ValueError(f"reference to nothing: {ref}")
        found = found[part]
    return found


def check_schema(schema, root=None, at: str = "#", within: tuple = ()) -> None:
    """Refuse, as a ValueError, a schema that ``problems`` would not apply in full: unknown keywords or types, bad patterns, references that lead nowhere or in a circle."""
    root = schema if root is None else root
    if isinstance(schema, bool):
        return
    if not isinstance(schema, dict):
        raise ValueError(f"{at}: neither an object nor a boolean")
    if unknown := sorted(set(schema) - _CHECKED - _SILENT):
        raise ValueError(f"{at}: unknown keywords {', '.join(unknown)}")
    kinds = schema.get("type", [])
    if not set([kinds] if isinstance(kinds, str) else kinds) <= set(_TYPES):
        raise ValueError(f"{at}: unknown type {kinds}")
    for pattern in (*([schema["pattern"]] if "pattern" in schema else []), *schema.get("patternProperties", {})):
        try:
            re.compile(pattern)
        except re.error as e:
            raise ValueError(f"{at}: bad pattern {pattern}: {e}") from None
    # What applies to the same value leads on; it must not come back.
    same = [*schema.get("allOf", []), *schema.get("anyOf", []), *schema.get("oneOf", []), *([schema["not"]] if "not" in schema else [])]
    if "$ref" in schema:
        if schema["$ref"] in within:
            raise ValueError(f"{at}: reference in a circle: {schema['$ref']}")
        check_schema(_target(root, schema["$ref"]), root, at, (*within, schema["$ref"]))
    for part in same:
        check_schema(part, root, at, within)
    # A target's own parts are checked where it stands.
    if not within:
        parts = [(k, part) for name in ("properties", "patternProperties", "$defs", "definitions") for k, part in schema.get(name, {}).items()]
        for name, part in [*parts, *((k, schema[k]) for k in ("items", "additionalProperties") if k in schema)]:
            check_schema(part, root, f"{at}/{name}")


def problems(value, schema, at: str = "$", root=None) -> list[str]:
    """What breaks the schema, of the keywords that ``check_schema`` lets pass."""
    root = schema if root is None else root
    if isinstance(schema, bool):
        return [] if schema else [f"{at}: not expected"]
    kinds = schema.get("type", list(_TYPES))
    kinds = [kinds] if isinstance(kinds, str) else kinds
    if not any(_is(value, k) for k in kinds):
        return [f"{at}: not {' or '.join(kinds)}"]
    found = []
    same = canonical(value) if {"enum", "const"} & set(schema) else ""
    if ("enum" in schema and same not in map(canonical, schema["enum"])) or ("const" in schema and same != canonical(schema["const"])):
        found.append(f"{at}: not one of the allowed values")
    within = lambda n, least, most: schema.get(least, 0) <= n <= schema.get(most, math.inf)
    if isinstance(value, dict):
        known, patterns = schema.get("properties", {}), schema.get("patternProperties", {})
        found += [f"{at}.{k}: missing" for k in schema.get("required", []) if k not in value]
        if not within(len(value), "minProperties", "maxProperties"):
            found.append(f"{at}: number of members out of bounds")
        for k in sorted(value):
            parts = [known[k]] if k in known else []
            parts += [part for pattern, part in patterns.items() if re.search(pattern, k)]
            for part in parts or [schema.get("additionalProperties", True)]:
                found += problems(value[k], part, f"{at}.{k}", root)
    elif isinstance(value, list):
        if not within(len(value), "minItems", "maxItems"):
            found.append(f"{at}: number of items out of bounds")
        if schema.get("uniqueItems") and len(set(map(canonical, value))) < len(value):
            found.append(f"{at}: repeated items")
        for k, item in enumerate(value):
            found += problems(item, schema.get("items", True), f"{at}[{k}]", root)
    elif isinstance(value, str):
        if not within(len(value), "minLength", "maxLength"):
            found.append(f"{at}: length out of bounds")
        if "pattern" in schema and not re.search(schema["pattern"], value):
            found.append(f"{at}: does not match the pattern")
    elif isinstance(value, (int, float)) and not isinstance(value, bool):
        above = schema.get("minimum", -math.inf) <= value and schema.get("exclusiveMinimum", -math.inf) < value
        if not (above and value <= schema.get("maximum", math.inf) and value < schema.get("exclusiveMaximum", math.inf)):
            found.append(f"{at}: out of bounds")
        if "multipleOf" in schema and Fraction(str(value)) % Fraction(str(schema["multipleOf"])):
            found.append(f"{at}: not a multiple")
    for part in [*schema.get("allOf", []), *([_target(root, schema["$ref"])] if "$ref" in schema else [])]:
        found += problems(value, part, at, root)
    fits = lambda name: sum(not problems(value, part, at, root) for part in schema[name])
    if ("anyOf" in schema and not fits("anyOf")) or ("oneOf" in schema and fits("oneOf") != 1):
        found.append(f"{at}: fits {'none' if 'anyOf' in schema else 'not just one'} of the alternatives")
    if "not" in schema and not problems(value, schema["not"], at, root):
        found.append(f"{at}: fits what it must not")
    return found


def _plain(value):
    """Whole floats as integers, so that equal numbers are written alike; true and 1 stay apart."""
    if isinstance(value, float) and value.is_integer():
        return int(value)
    if isinstance(value, list):
        return [_plain(x) for x in value]
    return {k: _plain(x) for k, x in value.items()} if isinstance(value, dict) else value


def canonical(value) -> str:
    """JSON with keys sorted by code point and no spare space, characters as they are, 1.0 as 1; non-finite numbers and lone surrogates are refused."""
    text = json.dumps(_plain(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)
    text.encode()
    return text


def in_order(calls: list, edges: list[tuple]) -> dict:
    """Level of each call, without those that wait on a cycle; ``edges``: (call, call it depends on)."""
    waits, followers = Counter(c for c, _ in edges), defaultdict(list)
    for call, before in edges:
        followers[before].append(call)
    level, free = {}, deque((c, 0) for c in calls if not waits[c])
    while free:
        call, n = free.popleft()
        level[call] = n
        for f in followers[call]:
            waits[f] -= 1
            if not waits[f]:
                # Calls become free in the order of their levels, so the last dependency is the highest.
                free.append((f, n + 1))
    return level


def _ordered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Levels of whole conversations; rows are (conv, call, befores) sorted by conv."""
    conv, rows = None, []

    def done():
        known = {c for c, _ in rows}
        level = in_order([c for c, _ in rows], [(c, b) for c, befores in rows for b in befores if b in known])
        return [(conv, c, level.get(c)) for c, _ in rows]

    for batch in batches:
        out = []
        for key, call, befores in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            if rows and key != conv:
                out += done()
                rows = []
            conv = key
            rows.append((call, befores))
        if out:
            yield _levels_batch(out, batch)
        last = batch
    if rows:
        yield _levels_batch(done(), last)


def _levels_batch(out: list[tuple], like: pa.RecordBatch) -> pa.RecordBatch:
    kinds = [like.schema.field(0).type, like.schema.field(1).type, pa.int32()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["conv", "call", "level"])


def levels(calls: DataFrame, *, most_in_task: int = MOST_IN_TASK) -> DataFrame:
    """``calls`` (conv, call, after: ids it depends on) with level, null where it waits on a cycle.

    Dependencies on calls that don't exist, or on the call itself, don't count.
    Conversations of up to ``most_in_task`` calls and dependencies are ordered within
    their task, however deep they are.  Of larger ones each round settles a level and
    keeps only what is left, so the rounds are as many as the levels.
    """
    calls = durable(calls)
    befores = F.array_remove(F.array_distinct(F.coalesce("after", F.array().cast("array<string>"))), F.col("call"))
    calls = calls.withColumn("befores", befores)
    large = durable(calls.groupBy("conv").agg(F.sum(F.size("befores") + 1).alias("n")).where(F.col("n") > most_in_task).select("conv"))
    small = calls.join(large, "conv", "left_anti").select("conv", "call", "befores")
    kinds = calls.schema["conv"].dataType.simpleString(), calls.schema["call"].dataType.simpleString()
    found = small.repartition("conv").sortWithinPartitions("conv").mapInArrow(_ordered, f"conv {kinds[0]}, call {kinds[1]}, level int")
    if not large.isEmpty():
        found = found.unionByName(_levels_by_rounds(calls.join(large, "conv", "left_semi")))
    return calls.drop("befores").join(found, ["conv", "call"], "left")


def _levels_by_rounds(calls: DataFrame) -> DataFrame:
    spark, root = calls.sparkSession, f"{shared_dir(calls.sparkSession)}/{uuid.uuid4().hex}"
    edges = calls.select("conv", "call", F.explode("befores").alias("before"))
    edges, edges_at = settle(edges.join(calls.select("conv", F.col("call").alias("before")), ["conv", "before"], "left_semi"))
    waiting, waiting_at = settle(calls.select("conv", "call"))
    schema, level = waiting.schema, 0
    while True:
        free = waiting.join(edges.select("conv", "call").distinct(), ["conv", "call"], "left_anti")
        # Settled calls gather in one folder, so that the plan does not grow with the levels.
        free.write.parquet(f"{root}/level={level}")
        free = spark.read.schema(schema).parquet(f"{root}/level={level}")
        if free.isEmpty():
            break
        left, left_at = settle(waiting.join(free, ["conv", "call"], "left_anti"))
        fewer, fewer_at = settle(edges.join(free.select("conv", F.col("call").alias("before")), ["conv", "before"], "left_anti"))
        discard(spark, waiting_at, edges_at)
        waiting, waiting_at, edges, edges_at, level = left, left_at, fewer, fewer_at, level + 1
    return spark.read.schema(StructType([*schema.fields, StructField("level", IntegerType())])).parquet(root)


def link_calls(calls: DataFrame, results: DataFrame, schemas: dict[str, dict], *, most_in_task: int = MOST_IN_TASK) -> DataFrame:
    """One row per call: conv, call, turn, level, position, status, problems (array) and json.

    ``calls``: conv, turn, call, name, arguments (JSON text), after (array of call ids);
    ``results``: conv, turn, call, content.  Of calls or results repeated under one id
    the earliest turn counts (of one turn, the smallest text).  Rows without
    conversation or id are left out.  Position counts a conversation's calls from 0.
    Status is the first that holds of: cycle (waits on itself; placed last), unknown
    (tool without schema), invalid (arguments that break it, or aren't JSON or can't be
    written as UTF-8), unanswered (no result), ok.  Arguments that aren't JSON stand in
    ``json`` as the text they are; null and empty ones are an empty object; texts of any
    length stay whole.  Of a name that repeats within one object the last value counts.
    Empty tables give no rows, and other columns are left out.  A schema that can't be
    applied in full is refused before any job starts.
    """
    for schema in schemas.values():
        check_schema(schema)
    named = lambda df: df.where("conv is not null and call is not null")
    calls = durable(
        named(calls)
        .groupBy("conv", "call")
        .agg(F.min(F.struct("turn", "name", "arguments", "after")).alias("c"))
        .select("conv", "call", "c.turn", "c.name", "c.arguments", F.coalesce("c.after", F.array().cast("array<string>")).alias("after"))
    )
    results = named(results).groupBy("conv", "call").agg(F.min(F.struct("turn", "content")).alias("r")).select("conv", "call", F.col("r.content").alias("content"), F.lit(True).alias("answered"))
    found = levels(calls.select("conv", "call", "after"), most_in_task=most_in_task)
    # A conversation's places: a level's first place from the sizes of those before it, then rank by turn within the level.
    placed = durable(found.select("conv", "call", F.coalesce("level", F.lit(_NEVER)).alias("lv")).join(calls.select("conv", "call", "turn"), ["conv", "call"]))
    before = Window.partitionBy("conv").orderBy("lv").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy("conv", "lv").agg(F.count(F.lit(1)).alias("n"))
    firsts = sizes.select("conv", "lv", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    ranked = number_rows(placed, ["conv", "lv"], ["turn", "call"], "rank", bucket=F.floor(F.coalesce("turn", F.lit(-1)) / TURNS_PER_BUCKET))
    places = ranked.join(firsts, ["conv", "lv"]).select(
        "conv", "call", F.when(F.col("lv") < _NEVER, F.col("lv")).alias("level"), (F.col("first") + F.col("rank")).alias("position")
    )
    linked = calls.join(places, ["conv", "call"]).join(results, ["conv", "call"], "left")
    kinds = {f.name: f.dataType.simpleString() for f in linked.schema.fields}
    given = ["conv", "call", "turn", "level", "position"]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {"status": [], "problems": [], "json": []}
            for row in batch.select(["call", "level", "name", "arguments", "content", "answered", "after"]).to_pylist():
                wrong: list[str] = []
                try:
                    value = json.loads(row["arguments"] or "{}")
                    canonical(value)
                    wrong = problems(value, schemas[row["name"]]) if row["name"] in schemas else []
                except (ValueError, RecursionError):
                    value, wrong = row["arguments"], ["$: not JSON"]
                out["status"].append(
                    "cycle" if row["level"] is None
                    else "unknown" if row["name"] not in schemas
                    else "invalid" if wrong
                    else "ok" if row["answered"] else "unanswered"
                )
                out["problems"].append(wrong)
                out["json"].append(canonical({"after": row["after"], "arguments": value, "id": row["call"], "name": row["name"], "result": row["content"]}))
            columns = {c: batch.column(batch.schema.get_field_index(c)) for c in given}
            columns |= {"status": pa.array(out["status"], pa.string()), "problems": pa.array(out["problems"], pa.list_(pa.string())), "json": pa.array(out["json"], pa.string())}
            yield pa.RecordBatch.from_pydict(columns)

    schema = ", ".join(f"{c} {kinds[c]}" for c in given) + ", status string, problems array<string>, json string"
    return linked.mapInArrow(write, schema)


#: Tools of the calls that ``calls_from_turns`` derives.
TURN_SCHEMAS: dict[str, dict] = {
    "answer": {
        "type": "object", "required": ["text", "words"], "additionalProperties": False,
        "properties": {"text": {"type": "string", "minLength": 1}, "words": {"type": "integer", "minimum": 3}},
    },
    "look_up": {
        "type": "object", "required": ["text"],
        "properties": {"text": {"type": "string"}, "words": {"type": "integer", "maximum": 60}},
    },
}


def calls_from_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations read as tool use: (calls, results).

    The k-th user turn calls a tool with its text, and depends on call (k - 1) div 2;
    the result is the first assistant turn after it and before the next user turn.
    User turns are counted by sums over ranges of turns, so a conversation of any
    length is shared by many tasks.  Of rows repeated under one turn and role the
    smallest text counts; rows without conversation or turn, and other roles, say nothing.
    """
    base = turns.where("conv_id is not null and turn is not null and role in ('user', 'assistant')")
    base = base.groupBy(F.col("conv_id").alias("conv"), "turn", "role").agg(F.min("text").alias("text"))
    user = (F.col("role") == "user").cast("int")
    ranged = base.withColumn("b", F.floor(F.col("turn") / TURNS_PER_BUCKET))
    before = Window.partitionBy("conv").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    firsts = ranged.groupBy("conv", "b").agg(F.sum(user).alias("n")).select("conv", "b", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    # Of one turn the user's side comes first.
    within = Window.partitionBy("conv", "b").orderBy("turn", F.desc("role")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = ranged.join(firsts, ["conv", "b"]).withColumn("k", F.col("first") + F.sum(user).over(within) - 1)
    id_ = lambda k: F.concat_ws(":", "conv", k)
    name = F.when(F.col("k") % 2 == 0, "answer").otherwise("look_up")
    arguments = F.to_json(F.struct(F.size(F.split("text", r"\s+")).alias("words"), "text"))
    after = F.when(F.col("k") > 0, F.array(id_(F.floor((F.col("k") - 1) / 2)))).otherwise(F.array().cast("array<string>"))
    calls = counted.where("role = 'user'").select("conv", "turn", id_("k").alias("call"), name.alias("name"), arguments.alias("arguments"), after.alias("after"))
    # An assistant's turn before any user turn has no call.
    results = counted.where("role = 'assistant' and k >= 0").select("conv", "turn", id_("k").alias("call"), F.col("text").alias("content"))
    return calls, results
