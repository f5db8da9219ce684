"""Tool calls of generated conversations with JSON Schema tools, against a plain version."""

import json
import random
import time

from claimspark.llm import chat

TYPES = {"string": str, "integer": int, "number": (int, float), "boolean": bool, "array": list, "object": dict}


def fits(value, schema):
    kind = schema.get("type")
    if kind and not (isinstance(value, TYPES[kind]) and not (isinstance(value, bool) and kind != "boolean")):
        return False
    if "enum" in schema and value not in schema["enum"]:
        return False
    for own, least, most in ((value if type(value) in (int, float) else None, "minimum", "maximum"), (len(value) if isinstance(value, str) else None, "minLength", "maxLength"), (len(value) if isinstance(value, list) else None, "minItems", "maxItems")):
        if own is not None and not schema.get(least, own) <= own <= schema.get(most, own):
            return False
    if isinstance(value, dict):
        props = schema.get("properties", {})
        if any(k not in value for k in schema.get("required", [])) or schema.get("additionalProperties") is False and any(k not in props for k in value):
            return False
        return all(fits(v, props[k]) for k, v in value.items() if k in props)
    return not (isinstance(value, list) and "items" in schema) or all(fits(v, schema["items"]) for v in value)


def conversation(rng, conv):
    schema = {"type": "object", "required": ["a"], "properties": {"a": {"type": rng.choice(["integer", "number", "string"]), "minimum": rng.choice([0, 2]), "maxLength": rng.choice([0, 3])}, "b": {"enum": ["x", "y", 3]}, "c": {"type": "object", "required": ["d"], "properties": {"d": {"type": "array", "items": {"type": "integer", "maximum": 2}, "minItems": rng.choice([1, 3])}}}}}
    if rng.random() < 0.5:
        schema["additionalProperties"] = False
    turns, ids = [("system", {"tools": [{"type": "function", "function": {"name": "t", "parameters": schema}}]})], []
    for _ in range(rng.randrange(1, 6)):
        calls = []
        for _ in range(rng.randrange(1, 4)):
            args = {k: v for k, v in {"a": rng.choice([1, "s", 2.5]), "b": rng.choice(["x", "z", 3]), "c": rng.choice([{"d": [1, 2]}, {"d": [1, "2"]}, {}]), "e": 1}.items() if rng.random() < (0.9 if k == "a" else 0.4)}
            own = f"id{rng.randrange(12)}"
            calls.append({"id": own, "name": rng.choice(["t", "t", "t", "u"]), "arguments": args, "depends_on": rng.sample([*ids, "gone", f"id{rng.randrange(12)}"], k=min(len(ids) + 2, rng.randrange(3)))})
            ids.append(own)
        turns.append(("assistant", {"content": "c", "tool_calls": calls}))
        if rng.random() < 0.8:
            turns.append(("tool", {"tool_call_id": rng.choice([*ids, "lost"]), "content": "r"}))
    return schema, [(conv, k, role, json.dumps(x)) for k, (role, x) in enumerate(turns)]


def plain(schema, turns):
    """Rows (turn, kind, call_id, linked, valid, level, declared) of one conversation."""
    calls = [(k, part, c) for _, k, role, x in turns if role == "assistant" for part, c in enumerate(json.loads(x)["tool_calls"])]
    first = {}
    for k, part, c in calls:
        first.setdefault(c["id"], (k, part, c))
    deps = {i: [d for d in dict.fromkeys(c["depends_on"]) if d in first] for i, (_, _, c) in first.items()}
    level = {}
    while new := {i: max((level[d] + 1 for d in ds), default=0) for i, ds in deps.items() if i not in level and all(d in level for d in ds)}:
        level |= new
    answered = {r["tool_call_id"] for _, k, role, x in turns if role == "tool" and (r := json.loads(x))["tool_call_id"] in first and first[r["tool_call_id"]][0] < k}
    out = []
    for k, part, c in calls:
        own = first[c["id"]][:2] == (k, part)
        out.append((k, "call", c["id"], own and c["id"] in answered, fits(c["arguments"], schema) if c["name"] == "t" else True, level.get(c["id"]) if own else None, c["name"] == "t", json.dumps({"arguments": c["arguments"], "id": c["id"], "name": c["name"], "role": "assistant"}, sort_keys=True, separators=(",", ":"))))
    for _, k, role, x in turns:
        if role == "tool":
            i = json.loads(x)["tool_call_id"]
            linked = i in answered and first[i][0] < k
            out.append((k, "result", i, linked, linked, level.get(i) if linked else None, None, json.dumps({"content": "r", "role": "tool", "tool_call_id": i}, sort_keys=True, separators=(",", ":"))))
    return out


def test_op3_equals_a_plain_version(spark):
    rng = random.Random(9)
    made = [conversation(rng, conv) for conv in range(150)]
    df = spark.createDataFrame([t for _, turns in made for t in turns], "conv_id bigint, turn bigint, role string, text string").repartition(4)
    got = [(r["conv_id"], r["turn"], r["kind"], r["call_id"], r["linked"], r["valid"], r["level"], r["declared"], r["json"]) for r in chat.link_tool_calls(df).filter("kind <> 'message'").collect()]
    expected = [(conv, *row) for conv, (schema, turns) in enumerate(made) for row in plain(schema, turns)]
    key = lambda r: tuple(map(str, r))
    got, expected = sorted(got, key=key), sorted(expected, key=key)
    assert got == expected, next(x for x in zip(got, expected, strict=False) if x[0] != x[1])
    assert {r[5] for r in got} == {True, False} and max(r[6] or 0 for r in got) >= 3


def test_op3_levels_of_a_long_chain(spark):
    calls = [{"id": f"c{k}", "name": "t", "arguments": {}, "depends_on": [f"c{k - 1}"] if k else []} for k in range(12)]
    df = spark.createDataFrame([(1, 0, "assistant", json.dumps({"tool_calls": calls}))], "conv_id bigint, turn bigint, role string, text string")
    assert {r["call_id"]: r["level"] for r in chat.link_tool_calls(df).collect()} == {f"c{k}": k for k in range(12)}


def test_op3_calls_behind_white_space_and_unchecked_keywords(spark):
    tools = '\n\t{"tools":[{"name":"w","parameters":{"type":"object","properties":{"a":{"anyOf":[{"type":"string"}],"pattern" : "x"}}}},{"name":"v","parameters":{"type":"object"}}]}'
    call = '\r\n {"tool_calls":[{"id":"1","name":"w","arguments":"{\\"a\\":1}"},{"id":"2","name":"v","arguments":"{}"}]}'
    turns = [(1, 0, "system", tools), (1, 1, "assistant", call), (1, 2, "tool", '\n{"tool_call_id":"1","content":"done"}')]
    out = chat.link_tool_calls(spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string")).collect()
    assert {r["call_id"]: (r["linked"], r["valid"], r["unchecked"]) for r in out if r["kind"] == "call"} == {"1": (True, True, "anyOf,pattern"), "2": (False, True, None)}
    assert [r["linked"] for r in out if r["kind"] == "result"] == [True]


def test_op3_levels_of_long_chains_and_circles(spark):
    rng = random.Random(12)
    calls, expected = [], {}
    for conv in range(30):
        n = rng.randrange(1, 40)
        deps = {i: sorted({rng.randrange(n + 2) for _ in range(rng.choice([0, 1, 1, 1, 2, 3]))}) for i in range(n)}  # forward, backward, to itself, to calls that aren't there
        if conv % 3:
            deps = {i: [d for d in ds if d < i] for i, ds in deps.items()}
        level = {i: 0 for i, ds in deps.items() if not [d for d in ds if d < n]}
        while new := {i: 1 + max(level[d] for d in ds if d < n) for i, ds in deps.items() if i not in level and all(d in level for d in ds if d < n)}:
            level |= new
        expected |= {(conv, str(i)): level.get(i) for i in deps}
        calls += [(conv, str(i), [str(d) for d in ds] or None) for i, ds in deps.items()]
    chain = 1000
    calls += [(99, str(i), [str(i - 1)] if i else []) for i in range(chain)]
    expected |= {(99, str(i)): i for i in range(chain)}
    at = time.time()
    got = chat.levels(spark.createDataFrame(calls, "conv_id bigint, call_id string, depends_on array<string>"))
    assert {(r["conv_id"], r["call_id"]): r["level"] for r in got.collect()} == expected and time.time() - at < 60
