import json
import random

import pytest
from hypothesis import given
from hypothesis import strategies as st

from cairn.llm import toolcalls as tc
from cairn.llm.shared import Scratch

SCHEMA = "conv_id bigint, turn bigint, kind string, call_id string, tool string, arguments string, after array<string>, result string, status int"


@given(st.recursive(st.none() | st.booleans() | st.text(), lambda x: st.lists(x) | st.dictionaries(st.text(), x), max_leaves=12))
def test_canonical_json(value):
    text = tc.canonical(value)
    assert json.loads(text) == value
    assert text == json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


@pytest.mark.parametrize(
    "text,schema,want",
    [
        (None, {}, (None, "not an object")),
        ("[1]", {}, (None, "not an object")),
        ("{bad", {}, (None, "not an object")),
        ('{"a": NaN}', {}, (None, "not an object")),
        ('{"b": 1.50, "a": 1e3}', {}, ('{"a":1000,"b":1.5}', None)),
        ("{}", None, ("{}", "unknown tool")),
        ("{}", tc.SCHEMAS["lookup"], ("{}", "missing query")),
        ('{"query": 5}', tc.SCHEMAS["lookup"], ('{"query":5}', "query is not string")),
        ('{"query": "x", "limit": 1.0}', tc.SCHEMAS["lookup"], ('{"limit":1,"query":"x"}', None)),
        ('{"query": "x", "limit": 1.5}', tc.SCHEMAS["lookup"], ('{"limit":1.5,"query":"x"}', "limit is not integer")),
        ('{"a": "\\ud800", "b": "\\ud83d\\ude00"}', {}, ('{"a":"\\ud800","b":"😀"}', None)),
        ('{"query": "x", "\\udc00": 1}', tc.SCHEMAS["lookup"], ('{"query":"x","\\udc00":1}', "unknown \\udc00")),
        ('{"query": "x", "z": true}', tc.SCHEMAS["lookup"], ('{"query":"x","z":true}', "unknown z")),
        ('{"words": 2, "tone": "cold"}', tc.SCHEMAS["answer"], ('{"tone":"cold","words":2}', "tone is none of the choices")),
        ("[" * 100_000, {}, (None, "not an object")),
        ('{"a":' + "[" * 3000 + "]" * 3000 + "}", {}, (None, "nested too deeply")),
    ],
)
def test_checked(text, schema, want):
    assert tc.checked(text, schema) == want


@pytest.mark.parametrize(
    "spellings,want",
    [
        (["1", "1.0", "1.00", "1e0", "10E-1", "0.1e1"], "1"), (["0", "-0", "0.0", "0e9"], "0"), (["-1.50", "-15e-1"], "-1.5"), (["1e20"], "100000000000000000000"),
        (["1e21", "1000000000000000000000.0"], "1e+21"), (["0.000001"], "0.000001"), (["0.0000001", "1e-7"], "1e-7"), (["123.456e30"], "1.23456e+32"),
        (["123456789012345678901234567890"], "1.2345678901234567890123456789e+29"), (["12.50", "125e-1"], "12.5"),
    ],
)
def test_numbers_have_one_spelling(spellings, want):
    assert {tc.checked(f'{{"a": {s}}}', {})[0] for s in spellings} == {f'{{"a":{want}}}'}
    assert float(want) == float(spellings[0])


NESTED = {
    "$defs": {"tree": {"type": "object", "required": ["n"], "properties": {"n": {"type": "integer"}, "kids": {"type": "array", "items": {"$ref": "#/$defs/tree"}}}, "additionalProperties": False}},
    "properties": {
        "tree": {"$ref": "#/$defs/tree"}, "pick": {"enum": [1, 2.5, "1", None]}, "name": {"type": ["string", "null"], "minLength": 2, "maxLength": 3, "pattern": "^[a-z]"},
        "size": {"type": "number", "minimum": -1.5, "exclusiveMaximum": 1e3, "multipleOf": 0.5}, "list": {"minItems": 1, "maxItems": 3, "uniqueItems": True},
        "any": {"anyOf": [{"type": "boolean"}, {"type": "object", "required": ["x"]}]}, "one": {"oneOf": [{"type": "number"}, {"type": "integer"}]},
        "all": {"allOf": [{"minimum": 1}, {"maximum": 2}]}, "no": {"not": {"type": "null"}}, "big": {"maximum": 10**30}, "fixed": {"const": {"a": [1]}},
    },
    "additionalProperties": {"type": "string"},
    "maxProperties": 3,
}


@pytest.mark.parametrize(
    "text,want",
    [
        ('{"tree": {"n": 1, "kids": [{"n": 2}, {"n": 3, "kids": []}]}}', None),
        ('{"tree": {"n": 1, "kids": [{"n": 2}, {"n": "3"}]}}', "tree.kids[1].n is not integer"),
        ('{"tree": {"n": 1, "kids": [{}]}}', "missing tree.kids[0].n"),
        ('{"tree": {"n": 1, "z": 1}}', "unknown tree.z"),
        ('{"pick": 1}', None), ('{"pick": 1.0}', None), ('{"pick": 25e-1}', None), ('{"pick": "1"}', None), ('{"pick": null}', None),
        ('{"pick": "2.5"}', "pick is none of the choices"), ('{"pick": true}', "pick is none of the choices"), ('{"pick": 10}', "pick is none of the choices"),
        ('{"name": null}', None), ('{"name": "ab"}', None), ('{"name": 5}', "name is not string or null"), ('{"name": "a"}', "name is too short"),
        ('{"name": "abcd"}', "name is too long"), ('{"name": "Ab"}', "name doesn't match the pattern"),
        ('{"size": -1.50}', None), ('{"size": 999.5}', None), ('{"size": -2}', "size is too small"), ('{"size": 1000}', "size is too large"),
        ('{"size": 1e99999999999999999999}', "size is too large"), ('{"size": -1e99999999999999999999}', "size is too small"),
        ('{"size": 0.75}', "size is not a multiple of 0.5"), ('{"size": 1e-99999999999999999999}', "size is not a multiple of 0.5"), ('{"size": 0}', None),
        ('{"big": 1e30}', None), ('{"big": 1000000000000000000000000000001}', "big is too large"),
        ('{"list": []}', "list has too few items"), ('{"list": [1, 2, 3, 4]}', "list has too many items"), ('{"list": [1, "1", true]}', None), ('{"list": [{"a": 1}, {"a": 1.0}]}', "list repeats an item"),
        ('{"any": true}', None), ('{"any": {"x": 0}}', None), ('{"any": {}}', "any fits none of the schemas"),
        ('{"one": 1.5}', None), ('{"one": 1}', "one fits several of the schemas"), ('{"one": "1"}', "one fits none of the schemas"),
        ('{"all": 1.5}', None), ('{"all": 3}', "all is too large"), ('{"no": null}', "no is not allowed"), ('{"fixed": {"a": [1.0]}}', None), ('{"fixed": {"a": []}}', "fixed is none of the choices"),
        ('{"other": 1}', "other is not string"), ('{"a": "", "b": "", "c": "", "d": ""}', "value has too many properties"),
    ],
)
def test_nested_schemas(text, want):
    tc.understood(NESTED)
    assert tc.checked(text, NESTED)[1] == want


@pytest.mark.parametrize("schema", [{"if": {}}, {"properties": {"a": {"items": {"contains": {}}}}}, {"type": "text"}, {"$ref": "http://x.org/s"}, {"$ref": "#"}, {"items": [{}]}])
def test_schemas_not_supported(spark, schema):
    with pytest.raises(ValueError):
        tc.linked_calls(spark.createDataFrame([], SCHEMA), {"tool": schema})


def plain_order(calls):
    """Places by plain loops. calls: id -> (turn, after), of one conversation."""
    waits = {c: {a for a in after or [] if a in calls and a != c and a is not None} for c, (_, after) in calls.items()}
    if all(calls[a][0] < calls[c][0] for c, w in waits.items() for a in w):
        order = sorted(calls, key=lambda c: (calls[c][0], c))
    else:
        level = {}
        while True:
            ready = {c for c in calls if c not in level and all(a in level for a in waits[c])}
            if not ready:
                break
            n = max(level.values(), default=-1) + 1
            level |= dict.fromkeys(ready, n)
        order = sorted(level, key=lambda c: (level[c], calls[c][0], c))
    return {c: i + 1 for i, c in enumerate(order)}


@pytest.mark.parametrize("seed,together", [(1, 10_000), (2, 3)])
def test_order_against_loops(spark, monkeypatch, seed, together):
    """Tangled conversations in a task, and longer ones in rounds."""
    monkeypatch.setattr(tc, "TOGETHER", together)
    rnd = random.Random(seed)
    rows, want = [], set()
    for conv in range(25):
        n, back = rnd.randrange(1, 9), rnd.random() < 0.5
        calls = {}
        for i in range(n):
            pool = range(i) if back else range(n)
            after = rnd.choice([None, [], [None, "zz"], [f"c{rnd.choice(pool)}" for _ in range(rnd.randrange(3))] if pool else []])
            calls[f"c{i}"] = (i, after)
        for c, (turn, after) in calls.items():
            rows.append((conv, turn, "call", c, "t", "{}", after, None, 0))
        places = plain_order(calls)
        want |= {(conv, c, places.get(c)) for c in calls}
    found = tc.ordered(spark.createDataFrame(rows, SCHEMA), Scratch(spark, "test"))
    assert {tuple(r) for r in found.collect()} == want


def test_tangled_order_of_the_whole_table(spark):
    """The calls of all chats, waiting for earlier and later turns, for several calls and in cycles."""
    from pyspark.sql import functions as F

    calls = tc.calls_of(spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")).where("kind = 'call'")
    near = lambda by: F.concat(F.lit("c"), (F.col("turn") + by).cast("string"))
    kind = F.pmod(F.xxhash64("conv_id", "turn"), F.lit(4))
    after = F.when(kind == 0, F.array(near(2))).when(kind == 1, F.array(near(-2), near(-4), near(2))).when(kind == 2, F.array(near(-2), near(0)))
    calls = calls.withColumn("after", after)
    chats = {}
    for r in calls.collect():
        chats.setdefault(r.conv_id, {})[r.call_id] = (r.turn, r.after)
    want = {(conv, c, place) for conv, chat in chats.items() for c, place in (dict.fromkeys(chat) | plain_order(chat)).items()}
    assert {tuple(r) for r in tc.ordered(calls, Scratch(spark, "test")).collect()} == want
    tangled = {conv for conv, chat in chats.items() if any(int(a[1:]) > t and a in chat for t, after in chat.values() for a in after or [])}
    assert len(tangled) > 20 and any(place is None for _, _, place in want)


def test_one_long_conversation(spark):
    """Its calls are numbered over several ranges, of which none holds all."""
    rows = [(1, i // 2, "call", f"c{i:05}", "t", "{}", None, None, 0) for i in range(6000)] + [(2, 0, "call", "a", "t", "{}", None, None, 0)]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(6)
    found = {(r.conv_id, r.call_id): r.place for r in tc.ordered(frame, Scratch(spark, "test")).collect()}
    assert found == {(1, f"c{i:05}"): i + 1 for i in range(6000)} | {(2, "a"): 1}


def test_links(spark):
    call = lambda conv, turn, i, after=(), tool="answer", args='{"words":1}': (conv, turn, "call", i, tool, args, list(after), None, 0)
    result = lambda conv, turn, i, text: (conv, turn, "result", i, None, None, None, text, 0)
    rows = [
        call(1, 0, "a"), result(1, 1, "a", "ok"), call(1, 2, "b", ["a"]), call(2, 5, "a"), result(2, 3, "a", "soon"), result(2, 9, "x", None),
        call(1, 4, "a"), result(1, 5, "a", "again"), call(None, 1, "n"), call(3, 1, None), (3, 1, "other", "k", None, None, None, None, 0), call(3, 0, "q", tool="zap", args=None),
        result(4, 1, "", "é\n\"\x01"), call(4, 0, ""),
    ]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    found = {(r.conv_id, r.call_id, r.turn): r for r in tc.linked_calls(frame, tc.SCHEMAS).collect()}
    brief = {k: (r.place, r.result_turn, r.status, r.fault) for k, r in found.items()}
    assert brief == {
        (1, "a", 0): (1, 1, "linked", None), (1, "b", 2): (2, None, "unanswered", None), (1, "a", 4): (None, 5, "repeated", None),
        (2, "a", 5): (1, 3, "early", None), (2, "x", None): (None, 9, "orphan", None), (3, "q", 0): (1, None, "unanswered", "not an object"), (4, "", 0): (1, 1, "linked", None),
    }
    assert json.loads(found[4, "", 0].json) == {"arguments": {"words": 1}, "call_id": "", "result": 'é\n"\x01', "tool": "answer"}
    assert tc.linked_calls(frame.limit(0), tc.SCHEMAS).count() == 0


def test_query_arguments(spark):
    """Every call's arguments hold its message's whole text."""
    sf = "/root/testdata/sf0.01"
    texts = {(r.conv_id, r.turn): r.text or "" for r in spark.read.parquet(f"{sf}/conversations.parquet").collect()}
    for r in tc.op1(spark, sf).where("turn is not null").collect():
        call, text = json.loads(r.json), texts[r.conv_id, r.turn]
        tone = "loud" if len(text) % 2 else "plain"
        assert call["arguments"] == ({"query": text, "limit": len(text)} if call["tool"] == "lookup" else {"text": text, "words": len(text.split(" ")), "tone": tone})


def test_query_arguments_of_any_text(spark):
    rows = [(1, 0, "user", "a. b.\n\"c\" \\ \x00\x1f\u2028 é😀"), (2, 0, "user", "x. " * 400_000), (3, 0, "user", None), (4, 1, "user", "one. two.")]
    frame = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    for r in tc.linked_calls(tc.calls_of(frame), tc.SCHEMAS).collect():
        found = json.loads(r.json)["arguments"]
        assert found.get("query", found.get("text")) == (rows[r.conv_id - 1][3] or "")


def test_query(spark):
    """Every row of the query against the conversations, read in plain Python."""
    sf = "/root/testdata/sf0.01"
    turns = {(r.conv_id, r.turn): r for r in spark.read.parquet(f"{sf}/conversations.parquet").collect()}
    rows = tc.op1(spark, sf).collect()
    assert {(r.conv_id, r.turn) for r in rows if r.turn is not None} == {k for k, r in turns.items() if r.role == "user"}
    for r in rows:
        answer = turns.get((r.conv_id, int(r.call_id[1:]) + 1))
        answered = answer is not None and answer.role == "assistant"
        assert (r.status == "linked") == (answered and r.turn is not None) and (not answered or json.loads(r.json)["result"] == answer.text)
        if r.turn is not None:
            users = sorted(t for c, t in turns if c == r.conv_id and turns[c, t].role == "user")
            assert r.place == users.index(r.turn) + 1
            assert (json.loads(r.json)["tool"] == "erase") == (r.fault == "unknown tool")
