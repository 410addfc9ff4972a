"""Tool calls of chats: linked to their results, ordered, checked against schemas and written as JSON.

A message is a call (call_id, tool, arguments as JSON text, after: ids of calls whose results it
needs) or a result (call_id, result text). Calls and results of a conversation meet in a hash join on
(conv_id, call_id). The topological order is that of turns (then ids) wherever each call waits only
for calls of earlier turns, as in any chat that was led in order. Only conversations in which some
call waits for one of its own turn or later are ordered by levels: a call's level is one more than
the highest it waits for. Such a conversation of at most TOGETHER calls is levelled in one task, a longer
one in rounds of joins over the waits that are left, until nothing changes; a level is ordered by turn and
id. Calls in a cycle or behind one get no place. Calls are numbered by ranges of their order, so that no
conversation is ever collected, however long it is.

Defined results: a call without a result is 'unanswered', a result without a call 'orphan', a second
call or result of an id 'repeated' (the first by turn, then by text, is the one linked), a result
before its call 'early'. Ids in `after` that are null, unknown or the call's own are left out.
Arguments that aren't a JSON object are 'not an object'; else the first fault in order of the
schema's fields is named, at any depth; tools without a schema are 'unknown tool'. Schemas are JSON
Schema without conditions, patternProperties, prefixItems, contains and references to other files:
_KEYWORDS are known, others raise an error. Numbers go by value everywhere: 1.0 is an integer and equals 1;
patterns are Python's, formats aren't looked at. What is nested beyond Python's stack, some hundreds
of levels, is 'nested too deeply', and not written if even its JSON is. Null conv_id and call_id are
dropped from links, as nothing can name them. In canonical JSON equal numbers are written alike, with all
their digits and none too many, with an exponent from 1e21 on and below 1e-6; a surrogate without its
partner, which no text can hold, is escaped.
"""

from __future__ import annotations

import json
import re
from decimal import Decimal
from urllib.parse import unquote

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.llm.shared import Scratch, tasks_for

_KINDS = {"string": str, "object": dict, "array": list, "boolean": bool, "null": type(None)}
#: What schemas may say. The first line is what `fault` looks at, the second says nothing about a value.
_KEYWORDS = frozenset("type enum const required properties additionalProperties minProperties maxProperties items minItems maxItems uniqueItems minimum maximum exclusiveMinimum exclusiveMaximum multipleOf minLength maxLength pattern $ref allOf anyOf oneOf not".split())
_KEYWORDS |= frozenset("$schema $comment $defs definitions title description default examples deprecated readOnly writeOnly format".split())


#: Calls of a tangled conversation that one task orders.
TOGETHER = 10_000


class _Number(str):
    """A number as it was written."""


def canonical(value) -> str:
    """JSON with keys sorted by code point, no spaces, and no escapes but those JSON needs."""
    if isinstance(value, dict):
        return "{" + ",".join(f"{canonical(k)}:{canonical(value[k])}" for k in sorted(value)) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(canonical, value)) + "]"
    return _plain(value) if isinstance(value, _Number) else _whole(json.dumps(value, ensure_ascii=False))


def _whole(text: str) -> str:
    """The text with surrogates that have no partner written as escapes."""
    return re.sub("[\ud800-\udfff]", lambda m: f"\\u{ord(m[0]):04x}", text)


def _plain(number) -> str:
    """The one spelling of a number's value."""
    sign, size, digits = _exact(number)
    if not sign:
        return "0"
    if len(digits) <= size <= 21:
        text = digits.ljust(size, "0")
    elif 0 < size <= 21:
        text = f"{digits[:size]}.{digits[size:]}"
    elif -6 < size <= 0:
        text = "0." + "0" * -size + digits
    else:
        text = digits[0] + (f".{digits[1:]}" if len(digits) > 1 else "") + f"e{size - 1:+d}"
    return "-" * (sign < 0) + text


def _fits(value, kind: str) -> bool:
    if kind in ("number", "integer"):
        if kind == "number" or not isinstance(value, _Number):
            return isinstance(value, _Number)
        _, size, digits = _exact(value)
        return len(digits) <= size or not digits
    return isinstance(value, _KINDS[kind]) and not isinstance(value, _Number)


def _exact(number) -> tuple[int, int, str]:
    """Sign, size and digits of a number: 0.digits times 10**size, whatever its exponent."""
    sign, whole, part, power = re.fullmatch(r"(-?)(\d+)(?:\.(\d+))?(?:[eE]([+-]?\d+))?", str(number)).groups()
    digits = (whole + (part or "")).lstrip("0")
    if not digits:
        return 0, 0, ""
    # int() of a text has a limit of digits, Decimal has none
    return -1 if sign else 1, len(digits) - len(part or "") + int(Decimal(power or 0)), digits.rstrip("0")


def _less(a, b) -> bool:
    a, b = _exact(a), _exact(b)
    return a[0] < b[0] if a[0] != b[0] else a[1:] < b[1:] if a[0] > 0 else b[1:] < a[1:]


def _divides(step, number) -> bool:
    (_, up, a), (_, down, b) = _exact(number), _exact(step)
    power, a, b = (up - len(a)) - (down - len(b)), int(Decimal(a or 0)), int(Decimal(b))
    return a == 0 or (power >= 0 and a * pow(10, power, b) % b == 0)


def _alike(value):
    """Equal for equal JSON values: numbers go by value, and are neither texts nor booleans."""
    if isinstance(value, dict):
        return "object", frozenset((k, _alike(v)) for k, v in value.items())
    if isinstance(value, list):
        return "array", tuple(map(_alike, value))
    if isinstance(value, _Number) or (isinstance(value, (int, float)) and not isinstance(value, bool)):
        return "number", _exact(value)
    return type(value).__name__, value


def _resolved(ref: str, root):
    if ref != "#" and not ref.startswith("#/"):
        raise ValueError(f"schema reference {ref} is not supported")
    at = root
    for name in ref.split("/")[1:]:
        name = unquote(name).replace("~1", "/").replace("~0", "~")
        at = at[int(name)] if isinstance(at, list) else at[name]
    return at


def understood(root: dict) -> None:
    """Raises ValueError if a schema has keywords or kinds that `fault` doesn't know, or refers to itself
    for the same value."""
    todo, done = [root], set()

    def walk(schema, trail):
        if isinstance(schema, bool):
            return
        if not isinstance(schema, dict):
            raise ValueError(f"not a schema: {schema!r}")
        if id(schema) in trail:
            raise ValueError("a schema refers to itself")
        if id(schema) in done:
            return
        if strange := sorted(set(schema) - _KEYWORDS - ({"$id"} if schema is root else set())):
            raise ValueError(f"schema keywords not supported: {', '.join(strange)}")
        if strange := sorted(set(_kinds(schema)) - set(_KINDS) - {"number", "integer"}):
            raise ValueError(f"schema types not supported: {', '.join(strange)}")
        re.compile(schema.get("pattern", ""))
        same = [s for name in ("allOf", "anyOf", "oneOf") for s in schema.get(name, [])]
        same += [schema["not"]] if "not" in schema else []
        same += [_resolved(schema["$ref"], root)] if "$ref" in schema else []
        for inner in same:
            walk(inner, trail | {id(schema)})
        done.add(id(schema))
        todo.extend(schema.get("properties", {}).values())
        todo.extend(schema[name] for name in ("items", "additionalProperties") if name in schema)

    while todo:
        walk(todo.pop(), frozenset())


def _kinds(schema: dict) -> list[str]:
    kinds = schema.get("type", [])
    return [kinds] if isinstance(kinds, str) else kinds


def fault(value, schema, root=None, path: str = "") -> str | None:
    """What is wrong first, with the path of the field (a.b, a[0]): the value's kind and choices, then
    for objects required fields, the fields one by one and unknown fields, for arrays the items, for
    texts and numbers their bounds, then what $ref, allOf, anyOf, oneOf and not ask."""
    root = schema if root is None else root
    at = path or "value"
    if isinstance(schema, bool):
        return None if schema else f"{at} is not allowed"
    if "type" in schema and not any(_fits(value, kind) for kind in _kinds(schema)):
        return f"{at} is not {' or '.join(_kinds(schema))}"
    if "enum" in schema and _alike(value) not in map(_alike, schema["enum"]):
        return f"{at} is none of the choices"
    if "const" in schema and _alike(value) != _alike(schema["const"]):
        return f"{at} is none of the choices"
    if isinstance(value, dict):
        wrong = _object_fault(value, schema, root, path)
    elif isinstance(value, list):
        wrong = _array_fault(value, schema, root, path)
    elif isinstance(value, _Number):
        wrong = _number_fault(value, schema, at)
    elif isinstance(value, str):
        wrong = _size_fault(len(value), schema, "Length", at)
        if not wrong and "pattern" in schema and not re.search(schema["pattern"], value):
            wrong = f"{at} doesn't match the pattern"
    else:
        wrong = None
    if wrong:
        return wrong
    if "$ref" in schema and (wrong := fault(value, _resolved(schema["$ref"], root), root, path)):
        return wrong
    for inner in schema.get("allOf", []):
        if wrong := fault(value, inner, root, path):
            return wrong
    if "anyOf" in schema and all(fault(value, s, root, path) for s in schema["anyOf"]):
        return f"{at} fits none of the schemas"
    if "oneOf" in schema and (n := sum(not fault(value, s, root, path) for s in schema["oneOf"])) != 1:
        return f"{at} fits {'several' if n else 'none'} of the schemas"
    if "not" in schema and not fault(value, schema["not"], root, path):
        return f"{at} is not allowed"
    return None


def _size_fault(size: int, schema: dict, what: str, at: str) -> str | None:
    if size < schema.get(f"min{what}", 0):
        return f"{at} is too short" if what == "Length" else f"{at} has too few {what.lower()}"
    if size > schema.get(f"max{what}", size):
        return f"{at} is too long" if what == "Length" else f"{at} has too many {what.lower()}"
    return None


def _object_fault(value: dict, schema: dict, root, path: str) -> str | None:
    inside = f"{path}." if path else ""
    for name in schema.get("required", []):
        if name not in value:
            return f"missing {inside}{name}"
    fields = schema.get("properties", {})
    for name, field in fields.items():
        if name in value and (wrong := fault(value[name], field, root, inside + name)):
            return wrong
    others = schema.get("additionalProperties", True)
    for name in sorted(value):
        if name not in fields:
            if others is False:
                return f"unknown {inside}{name}"
            if wrong := fault(value[name], others, root, inside + name):
                return wrong
    return _size_fault(len(value), schema, "Properties", path or "value")


def _array_fault(value: list, schema: dict, root, path: str) -> str | None:
    for i, item in enumerate(value if "items" in schema else []):
        if wrong := fault(item, schema["items"], root, f"{path}[{i}]"):
            return wrong
    if schema.get("uniqueItems") and len(set(map(_alike, value))) < len(value):
        return f"{path} repeats an item"
    return _size_fault(len(value), schema, "Items", path)


def _number_fault(value: _Number, schema: dict, at: str) -> str | None:
    if ("minimum" in schema and _less(value, schema["minimum"])) or ("exclusiveMinimum" in schema and not _less(schema["exclusiveMinimum"], value)):
        return f"{at} is too small"
    if ("maximum" in schema and _less(schema["maximum"], value)) or ("exclusiveMaximum" in schema and not _less(value, schema["exclusiveMaximum"])):
        return f"{at} is too large"
    if "multipleOf" in schema and not _divides(schema["multipleOf"], value):
        return f"{at} is not a multiple of {schema['multipleOf']}"
    return None


def checked(text: str | None, schema: dict | None) -> tuple[str | None, str | None]:
    """Canonical JSON of the arguments, and their fault."""
    try:
        value = json.loads(text or "", parse_int=_Number, parse_float=_Number, parse_constant=lambda c: 1 / 0)
    except (ValueError, RecursionError, ZeroDivisionError):
        return None, "not an object"
    if not isinstance(value, dict):
        return None, "not an object"
    text = None
    try:
        text = canonical(value)
        wrong = "unknown tool" if schema is None else fault(value, schema)
        return text, wrong and _whole(wrong)
    except RecursionError:
        return text, "nested too deeply"


def link(messages: DataFrame, key: str = "call_id") -> DataFrame:
    """Calls with their results and a status, and results without calls.

    messages: conv_id, turn, kind ('call' or 'result'), call_id, tool, arguments, after, result."""
    known = messages.where(F.col("conv_id").isNotNull() & F.col(key).isNotNull() & F.col("kind").isin("call", "result"))
    content = F.when(F.col("kind") == "call", F.concat_ws("\x00", "tool", "arguments", F.to_json("after"))).otherwise(F.col("result"))
    turn = Window.partitionBy("conv_id", key, "kind").orderBy("turn", content)
    known = known.withColumn("_nth", F.row_number().over(turn))
    calls = known.where("kind = 'call'").select("conv_id", key, "turn", "tool", "arguments", "after", "_nth", F.lit(True).alias("is_call"))
    results = known.where("kind = 'result'").select("conv_id", key, F.col("turn").alias("result_turn"), "result", "_nth", F.lit(True).alias("is_result"))
    both = calls.hint("shuffle_hash").join(results, ["conv_id", key, "_nth"], "full_outer")
    status = (
        F.when(F.col("_nth") > 1, "repeated").when(F.col("is_call").isNull(), "orphan").when(F.col("is_result").isNull(), "unanswered")
        .when(F.col("result_turn") < F.col("turn"), "early").otherwise("linked")
    )
    return both.withColumn("status", status).withColumn("is_call", F.col("is_call").isNotNull()).drop("_nth", "is_result")


def ordered(calls: DataFrame, scratch: Scratch, key: str = "call_id") -> DataFrame:
    """conv_id, call_id and place of calls (conv_id, call_id, turn, after; one row an id)."""
    nodes = scratch.keep(calls.select("conv_id", key, "turn"), "nodes")
    waits = calls.select("conv_id", key, "turn", F.explode("after").alias("_on")).where(F.col("_on") != F.col(key)).distinct()
    waits = waits.join(nodes.select("conv_id", F.col(key).alias("_on"), F.col("turn").alias("_turn")), ["conv_id", "_on"])
    waits = scratch.keep(waits, "waits")
    tangled = scratch.keep(waits.where("not (_turn < turn) or turn is null or _turn is null").select("conv_id").distinct(), "tangled")
    waits = waits.select("conv_id", key, "_on")
    # one row for each tangled conversation
    tangled = scratch.keep(nodes.join(tangled, "conv_id", "left_semi").groupBy("conv_id").agg(F.count("*").alias("_calls")), "tangled-sizes")
    short, long = tangled.where(F.col("_calls") <= TOGETHER).select("conv_id"), tangled.where(F.col("_calls") > TOGETHER).select("conv_id")
    levels = scratch.keep(_levels_together(nodes.join(short, "conv_id", "left_semi"), waits.join(short, "conv_id", "left_semi"), key), "levels-short")
    levels = levels.union(_levels_in_rounds(nodes.join(long, "conv_id", "left_semi"), waits.join(long, "conv_id", "left_semi"), scratch, key))
    out = nodes.join(tangled, "conv_id", "left").join(levels, ["conv_id", key], "left")
    stuck = F.col("_calls").isNotNull() & F.col("level").isNull()
    return _numbered(out.withColumn("_stuck", stuck), scratch, key)


def _levels_together(nodes: DataFrame, waits: DataFrame, key: str) -> DataFrame:
    """conv_id, key and level; each conversation in one task, which holds TOGETHER calls and their waits."""
    after = waits.groupBy("conv_id", key).agg(F.collect_list("_on").alias("_after"))
    calls = nodes.select("conv_id", key).join(after, ["conv_id", key], "left")
    kinds = dict(calls.dtypes)

    def level(table: pa.Table) -> pa.Table:
        names = table[key].to_pylist()
        left, level_of, behind = {}, {}, {}
        for name, on in zip(names, table["_after"].to_pylist()):
            left[name] = len(on or ())
            for a in on or ():
                behind.setdefault(a, []).append(name)
        ready = [n for n in names if not left[n]]
        level_of.update(dict.fromkeys(ready, 0))
        for name in ready:
            for other in behind.get(name, ()):
                left[other] -= 1
                if not left[other]:
                    # the last of those it waits for to be placed is the highest, as levels are placed in order
                    level_of[other] = level_of[name] + 1
                    ready.append(other)
        found = pa.array([n in level_of for n in names], pa.bool_())
        out = pa.table({"conv_id": table["conv_id"], key: table[key]}).filter(found)
        return out.append_column("level", pa.array([level_of[n] for n in names if n in level_of], pa.int32()))

    return calls.groupBy("conv_id").applyInArrow(level, f"conv_id {kinds['conv_id']}, {key} {kinds[key]}, level int")


def _levels_in_rounds(nodes: DataFrame, waits: DataFrame, scratch: Scratch, key: str) -> DataFrame:
    """The same by joins: each round places the calls that wait for nothing any more, and drops what waits
    for them. Rounds read the waits that are left and the calls placed last, not all before them."""
    waits = scratch.keep(waits, "waits-0")
    placed = last = scratch.keep(nodes.select("conv_id", key).join(waits, ["conv_id", key], "left_anti").withColumn("level", F.lit(0)), "level-0")
    level = 0
    while not last.isEmpty():
        level += 1
        left = scratch.keep(waits.join(last.select("conv_id", F.col(key).alias("_on")), ["conv_id", "_on"], "left_anti").select("conv_id", key, "_on"), f"waits-{level}")
        free = waits.join(last.select("conv_id", F.col(key).alias("_on")), ["conv_id", "_on"], "left_semi").select("conv_id", key).distinct()
        last = scratch.keep(free.join(left, ["conv_id", key], "left_anti").withColumn("level", F.lit(level)), f"level-{level}")
        placed = placed.union(last)
        scratch.drop(f"waits-{level - 1}")
        waits = left
    return placed


def _numbered(calls: DataFrame, scratch: Scratch, key: str) -> DataFrame:
    """conv_id, key and place: calls are sorted by ranges, and one's place is its place in the range and the
    number of its conversation's calls in ranges before; stuck calls have none."""
    order = ["conv_id", "level", "turn", key]
    parts = tasks_for(calls.sparkSession, calls, 1 << 22)
    free = calls.where(~F.col("_stuck")).select(*order)
    ranged = free.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id())
    ranged = scratch.keep(ranged, "ranged")
    before = Window.partitionBy("conv_id").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # one row for each conversation and range that it is in
    counts = ranged.groupBy("conv_id", "_part").agg(F.count("*").alias("_many"))
    starts = counts.select("conv_id", "_part", F.coalesce(F.sum("_many").over(before), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy("conv_id", "_part").orderBy(*order[1:]))
    placed = ranged.withColumn("_inside", inside).join(starts, ["conv_id", "_part"])
    placed = placed.select("conv_id", key, (F.col("_start") + F.col("_inside")).cast("int").alias("place"))
    return placed.union(calls.where("_stuck").select("conv_id", key, F.lit(None).cast("int")))


def written(rows: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """rows with `fault` of the arguments and `json`, the call and its result as one canonical object."""
    for schema in schemas.values():
        understood(schema)

    @F.pandas_udf("fault string, json string")
    def write(call: pd.Series, tool: pd.Series, arguments: pd.Series, result: pd.Series) -> pd.DataFrame:
        out = []
        for c, t, a, r in zip(call, tool, arguments, result):
            text, wrong = checked(a, schemas.get(t))
            out.append((wrong, f'{{"arguments":{text or "null"},"call_id":{canonical(c)},"result":{canonical(r)},"tool":{canonical(t)}}}'))
        return pd.DataFrame(out, columns=["fault", "json"])

    return rows.withColumn("_written", write(F.col("call_id").cast("string"), "tool", "arguments", "result")).select("*", "_written.*").drop("_written")


def linked_calls(messages: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """conv_id, call_id, place, turn, result_turn, status, fault and json; one row for each call, and
    for each result without one."""
    scratch = Scratch(messages.sparkSession, "toolcalls")
    pairs = scratch.keep(link(messages), "pairs")
    calls = pairs.where("is_call and status <> 'repeated'").select("conv_id", "call_id", "turn", "after")
    places = ordered(calls, scratch).withColumn("_first", F.lit(True))
    rows = pairs.withColumn("_first", F.col("is_call") & (F.col("status") != "repeated")).join(places, ["conv_id", "call_id", "_first"], "left")
    fault_ = F.when(F.col("is_call"), F.col("fault")).alias("fault")
    return written(rows, schemas).select("conv_id", "call_id", "place", "turn", "result_turn", "status", fault_, "json")


#: Tools of the query below, as schemas of their arguments.
SCHEMAS = {
    "lookup": {"required": ["query"], "properties": {"query": {"type": "string"}, "limit": {"type": "integer"}}, "additionalProperties": False},
    "answer": {"required": ["words"], "properties": {"words": {"type": "integer"}, "tone": {"type": "string", "enum": ["plain", "warm"]}, "text": {"type": "string"}}},
}


def calls_of(conversations: DataFrame) -> DataFrame:
    """The synthetic chats hold no tool calls, so each user message is read as a call and the next
    turn's assistant message as its result. A call waits for that two turns before, so that chains
    run through the chat. Its arguments hold the whole text: a lookup's as query, others' as text."""
    text = F.coalesce("text", F.lit(""))
    name = lambda turn: F.concat(F.lit("c"), turn.cast("string"))
    tool = F.when(F.char_length(text) % 7 == 0, "erase").when(F.col("turn") % 4 == 0, "lookup").otherwise("answer")
    arguments = F.when(tool == "lookup", F.to_json(F.struct(F.char_length(text).alias("limit"), text.alias("query")))).otherwise(
        F.concat(F.lit('{ "words" : '), F.size(F.split(text, " ")).cast("string"), F.lit(', "tone": "'), F.when(F.char_length(text) % 2 == 0, "plain").otherwise("loud"), F.lit('", '), F.substr(F.to_json(F.struct(text.alias("text"))), F.lit(2)))
    )
    call = F.col("role") == "user"
    return conversations.where(F.col("role").isin("user", "assistant")).select(
        "conv_id", "turn", F.when(call, "call").otherwise("result").alias("kind"),
        F.when(call, name(F.col("turn"))).otherwise(name(F.col("turn") - 1)).alias("call_id"),
        F.when(call, tool).alias("tool"), F.when(call, arguments).alias("arguments"),
        F.when(call, F.array(name(F.col("turn") - 2))).alias("after"),
        F.when(~call, F.col("text")).alias("result"),
    )


def op1(spark, sf_dir: str) -> DataFrame:
    return linked_calls(calls_of(spark.read.parquet(f"{sf_dir}/conversations.parquet")), SCHEMAS)
