"""Tool-call linking in conversations (native DataFrame operations only).

An assistant turn may be a JSON object with `tool_calls` (id, name, arguments, optional depends_on: ids of calls that come
first); a turn of role `tool` is one with `tool_call_id` and `content`; a system turn may declare `tools` (name, required,
types: argument to JSON type, or a JSON schema as `parameters`). Calls and declarations may hold their fields in `function`.
Calls and results are joined by (conversation, id); arguments are validated against the declared types, and by rounds of
joins, one a depth, against the schema (type, enum, const, required, properties, additionalProperties false, items, bounds of numbers,
lengths and numbers of items); calls
get topological levels by rounds of joins, chains by doubling; each message is one row of canonical JSON (keys sorted, no spaces).
Order is given by columns (anchor_turn, level, part, turn), so a conversation of any length is never gathered in one task.

Of a schema's other keywords (`$ref`, `anyOf`, `pattern` and so on) `unchecked` has the names: such a call may be `valid` only as far as it was checked.

Nothing of a turn is lost: `extra` has a call's or result's fields that `json` doesn't show, `turn_json` (at a turn's first
call) the turn's fields besides its calls, such as its content; both are canonical JSON, or null if there are none. Of JSON
that variants can't hold (a repeated key) they have the text as it is.

Defined cases: of calls that repeat an id in a conversation the earliest is linked, the others are flagged; a result without a
call, or before it, is an orphan and keeps its place; calls on a cycle, or that wait for one, have level null; unknown ids in
depends_on are ignored; arguments that aren't a JSON object are invalid; calls of undeclared tools are valid if their arguments
are an object, and have `declared` false; any other text, also null, is a plain message; repeated rows give repeated rows; other columns than the
four read are dropped, so names can't clash.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, or_empty, tidy

CALLS = "tool_calls array<struct<id:string,name:string,arguments:string,depends_on:array<string>,function:struct<name:string,arguments:string>>>"
TOOL = "name:string,required:array<string>,types:map<string,string>,parameters:string,function:struct<name:string,parameters:string>"
TOOLS = f"tools array<struct<{TOOL}>>"
#: Keywords of JSON schemas that aren't checked (as patterns).
UNCHECKED = [r"\$ref", r"\$dynamicRef", "allOf", "anyOf", "oneOf", "not", "if", "pattern", "format", "patternProperties", "propertyNames", "dependentRequired", "dependentSchemas", "minProperties", "maxProperties", "uniqueItems", "contains", "prefixItems", "multipleOf", "unevaluatedProperties", "unevaluatedItems"]
#: JSON types and how a variant's schema shows them.
JSON_TYPES = {"string": "STRING", "boolean": "BOOLEAN", "integer": "BIGINT|DECIMAL\\([0-9]+,0\\)", "number": "BIGINT|DOUBLE|FLOAT|DECIMAL.*", "array": "ARRAY.*", "object": "OBJECT.*", "null": "VOID"}


def _json_like(c: str):
    return F.col(c).rlike(r"^[\x20\t\n\r]*\{")


def _fields(v: Column) -> Column:
    """A variant object's fields; null if it is none."""
    return F.try_variant_get(v, "$", "map<string,variant>")


def _without(fields: Column, *names: str) -> Column:
    return F.map_filter(fields, lambda k, _: ~k.isin(*names))


def _said(fields: Column) -> Column:
    """Canonical JSON of fields, null if there are none."""
    return F.when(F.size(fields) > 0, F.to_json(F.to_variant_object(fields)))


def _is(kind: Column, name: Column) -> Column:
    """Whether a variant's schema shows the JSON type `name`; unknown names fit all."""
    known = F.create_map(*[F.lit(x) for kv in JSON_TYPES.items() for x in kv])
    return F.coalesce(F.regexp_like(kind, F.concat(F.lit("^("), F.coalesce(F.element_at(known, name), F.lit(".*")), F.lit(")$"))), F.lit(False))


def unchecked(schema: Column) -> Column:
    """Keywords that a schema uses and `unfit` doesn't check, in order; null if there are none, so that `valid` says all."""
    used = F.array_sort(F.array_distinct(F.regexp_extract_all(schema, F.lit(f'"({"|".join(UNCHECKED)})"\\s*:'), F.lit(1))))
    return F.when(F.size(used) > 0, F.array_join(used, ","))


@tidy
def unfit(pairs: DataFrame) -> DataFrame:
    """Those keys of pairs (key, value, schema: JSON texts) whose value breaks its schema. A round of each depth."""
    found, now = None, cut(pairs.select("key", "value", "schema"))
    while not now.isEmpty():
        v, s = F.col("v"), F.col("s")
        get = lambda path, kind: F.try_variant_get(s, path, kind)
        at = now.select("key", F.try_parse_json("value").alias("v"), F.try_parse_json("schema").alias("s")).select("*", F.schema_of_variant(v).alias("kind"))
        at = at.select("*", F.when(F.col("kind").startswith("OBJECT"), _fields(v)).alias("own"), F.when(F.col("kind").startswith("ARRAY"), F.try_variant_get(v, "$", "array<variant>")).alias("each"), get("$.properties", "map<string,variant>").alias("props"))
        types = F.coalesce(get("$.type", "array<string>"), F.filter(F.array(get("$.type", "string")), lambda t: t.isNotNull()))
        enum = F.coalesce(get("$.enum", "array<variant>"), F.array(get("$.const", "variant")))
        names = F.map_keys("own")
        checks = [
            (F.size(types) == 0) | F.exists(types, lambda t: _is(F.col("kind"), t)),
            F.exists(enum, lambda e: e.isNull()) | F.exists(enum, lambda e: F.to_json(e) == F.to_json(v)),
            F.forall(get("$.required", "array<string>"), lambda k: F.array_contains(names, k)),
            F.when(get("$.additionalProperties", "string") == "false", F.forall(names, lambda k: F.coalesce(F.array_contains(F.map_keys("props"), k), F.lit(False)))),
        ]
        number, text = F.when(F.regexp_like("kind", F.lit(f"^({JSON_TYPES['number']})$")), F.try_variant_get(v, "$", "double")), F.when(F.col("kind") == "STRING", F.try_variant_get(v, "$", "string"))
        for value, least, most in ((number, "minimum", "maximum"), (F.length(text), "minLength", "maxLength"), (F.size("each"), "minItems", "maxItems")):
            checks += [value >= get(f"$.{least}", "double"), value <= get(f"$.{most}", "double")]
        checks += [number > get("$.exclusiveMinimum", "double"), number < get("$.exclusiveMaximum", "double")]
        fits = F.coalesce(checks[0], F.lit(True))
        for c in checks[1:]:
            fits = fits & F.coalesce(c, F.lit(True))
        wrong = cut(at.filter(~fits).select("key").distinct())
        found = wrong if found is None else found.unionByName(wrong)
        json = lambda value, schema: F.struct(F.to_json(value).alias("value"), F.to_json(schema).alias("schema"))
        inner = F.transform(F.map_entries(F.map_filter("props", lambda k, _: F.array_contains(names, k))), lambda e: json(F.element_at("own", e["key"]), e["value"]))
        items = get("$.items", "variant")
        inner = F.concat(F.coalesce(inner, F.array()), F.when(items.isNotNull(), F.coalesce(F.transform("each", lambda x: json(x, items)), F.array())).otherwise(F.array()))
        now = cut(at.select("key", F.explode(inner).alias("i")).select("key", "i.value", "i.schema").distinct())
    return pairs.select("key").limit(0) if found is None else found.distinct()


def _chains(one: DataFrame) -> DataFrame:
    """(conv_id, call_id, to, dist, open) of calls with one dependency: the first call down the chain that has none or several, and how far it is; open if the chain goes round.

    Each round doubles the steps. While any chain still has an end to reach, the one nearest to its end reaches it, so a round without progress leaves circles only.
    """
    hop, before = cut(one.withColumn("dist", F.lit(1).cast("bigint")).withColumn("open", F.lit(True))), None
    while True:
        further = hop.select("conv_id", F.col("call_id").alias("to"), F.col("to").alias("_to"), F.col("dist").alias("_dist"))
        hop = cut(hop.join(further, ["conv_id", "to"], "left").select("conv_id", "call_id", F.coalesce("_to", "to").alias("to"), (F.col("dist") + F.coalesce("_dist", F.lit(0))).alias("dist"), F.col("_to").isNotNull().alias("open")))
        now = hop.filter("open").count()
        if now in (0, before):
            return hop
        before = now


@tidy
def levels(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, level) of linked calls: 0 without known dependencies, else one more than the latest of them; null on cycles, and for calls that wait for one.

    Chains of calls with one dependency each are walked by doubling. Calls with several then wait for the ends of those chains: a round gives the level of all whose last
    dependency has one, and reads what is left only.
    """
    names, call = calls.select("conv_id", "call_id"), ["conv_id", "call_id"]
    edges = cut(calls.select(*call, F.explode(F.array_distinct("depends_on")).alias("on")).join(names.withColumnRenamed("call_id", "on"), ["conv_id", "on"]))
    if edges.isEmpty():
        return names.withColumn("level", F.lit(0))
    wants = edges.groupBy(*call).agg(F.count("*").alias("n"), F.first("on").alias("to"))
    chains = _chains(wants.filter("n = 1").select(*call, "to"))
    ends = chains.select("conv_id", F.col("call_id").alias("on"), F.col("to").alias("_to"), F.col("dist").alias("_dist"))
    left = edges.join(wants.filter("n > 1").select(*call), call, "left_semi").join(ends, ["conv_id", "on"], "left")
    left = cut(left.select(*call, F.coalesce("_to", "on").alias("to"), (F.coalesce("_dist", F.lit(0)) + 1).alias("more"), F.lit(None).cast("bigint").alias("got")))
    now = names.join(edges.select(*call), call, "left_anti").withColumn("level", F.lit(0).cast("bigint"))
    done = [now]
    while not left.isEmpty():
        at = now.select("conv_id", F.col("call_id").alias("to"), "level")
        seen = cut(left.join(at, ["conv_id", "to"], "left").select(*call, "to", "more", F.coalesce("got", F.col("level") + F.col("more")).alias("got")))
        now = cut(seen.groupBy(*call).agg(F.max("got").alias("level"), F.count_if(F.col("got").isNull()).alias("open")).filter("open = 0").drop("open"))
        if now.isEmpty():
            break  # the rest are on cycles, or wait for one
        done.append(now)
        left = cut(seen.join(now, call, "left_anti"))
        if len(done) > 16:
            done = [cut(reduce(DataFrame.unionByName, done))]
    found = cut(reduce(DataFrame.unionByName, done))
    through = chains.filter("not open").join(found.select("conv_id", F.col("call_id").alias("to"), F.col("level").alias("_level")), ["conv_id", "to"]).select(*call, (F.col("_level") + F.col("dist")).alias("level"))
    return names.join(found.unionByName(through), call, "left").select(*call, F.col("level").cast("int").alias("level"))


def link_tool_calls(turns: DataFrame) -> DataFrame:
    """One row a message, call or result: conv_id, turn, role, kind, call_id, tool, linked, valid, anchor_turn, level, part, json, extra, turn_json, declared, unchecked."""
    t = turns.select("conv_id", "turn", "role", "text")
    parsed = t.withColumn("_c", F.when((F.col("role") == "assistant") & _json_like("text"), F.from_json("text", CALLS))).withColumn("_r", F.when((F.col("role") == "tool") & _json_like("text"), F.from_json("text", "tool_call_id string, content string"))).withColumn("_t", F.when((F.col("role") == "system") & _json_like("text"), F.from_json("text", TOOLS)))
    has_calls, has_result = F.coalesce(F.size("_c.tool_calls") > 0, F.lit(False)), F.col("_r.tool_call_id").isNotNull()
    turn = parsed.filter(has_calls).withColumn("_v", F.try_parse_json("text"))
    turn = turn.withColumn("_each", F.try_variant_get("_v", "$.tool_calls", "array<variant>")).withColumn("_rest", F.when(F.col("_v").isNull(), F.col("text")).otherwise(_said(_without(_fields(F.col("_v")), "tool_calls"))))
    calls = turn.select("conv_id", "turn", "role", "_each", "_rest", F.posexplode("_c.tool_calls").alias("part", "c")).withColumn("_f", _fields(F.get("_each", F.col("part")))).withColumn("_fn", _fields(F.element_at("_f", "function")))
    # what a call says besides: other fields, and of fields in `function` those that weren't read from it
    own = lambda k: F.col(f"c.{k}").isNotNull()
    inner = F.map_filter("_fn", lambda k, _: ~(((k == "name") & ~own("name")) | ((k == "arguments") & ~own("arguments"))))
    others = F.map_concat(_without(F.col("_f"), "id", "name", "arguments", "function"), F.when(F.size("_fn") > 0, F.when(F.size(inner) > 0, F.create_map(F.lit("function"), F.to_variant_object(inner))).otherwise(F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<variant>")))).otherwise(F.map_filter("_f", lambda k, _: k == "function")))
    calls = calls.select("conv_id", "turn", "role", "part", F.col("c.id").alias("call_id"), F.coalesce("c.name", "c.function.name").alias("tool"), F.coalesce("c.arguments", "c.function.arguments").alias("arguments"), "c.depends_on", _said(others).alias("extra"), F.when(F.col("part") == 0, F.col("_rest")).alias("turn_json"))
    declared = parsed.filter(F.size("_t.tools") > 0).select("conv_id", F.explode("_t.tools").alias("d")).groupBy("conv_id", F.coalesce("d.name", "d.function.name").alias("tool")).agg(F.min(F.to_json("d")).alias("d")).withColumn("d", F.from_json("d", f"struct<{TOOL}>"))
    kinds = F.transform_values(F.from_json("arguments", "map<string,variant>"), lambda k, v: F.schema_of_variant(v))
    fits = F.forall(F.map_entries(F.coalesce("d.types", F.create_map().cast("map<string,string>"))), lambda e: F.col("kinds")[e["key"]].isNull() | _is(F.col("kinds")[e["key"]], e["value"]))
    there = F.forall(F.coalesce("d.required", F.array().cast("array<string>")), lambda k: F.col("kinds")[k].isNotNull())
    # an object only: other JSON has no map form
    is_object = F.coalesce(F.schema_of_variant(F.try_parse_json("arguments")).startswith("OBJECT"), F.lit(False))
    checked = calls.join(declared, ["conv_id", "tool"], "left").withColumn("kinds", F.when(is_object, kinds)).withColumn("valid", is_object & F.coalesce(fits & there, F.lit(False)))
    schema = F.coalesce("d.parameters", "d.function.parameters")
    checked = cut(checked.select("conv_id", "turn", "role", "part", "call_id", "tool", "arguments", "depends_on", "extra", "turn_json", "valid", F.col("d").isNotNull().alias("declared"), unchecked(schema).alias("unchecked"), F.when(F.col("valid"), schema).alias("schema")))
    key = F.sha2(F.concat(F.length("schema"), F.lit(" "), F.col("schema"), F.col("arguments")), 256)
    broken = unfit(checked.filter("schema is not null").select(key.alias("key"), F.col("arguments").alias("value"), "schema").distinct())
    checked = checked.withColumn("key", key).join(broken.withColumn("broken", F.lit(True)), "key", "left").withColumn("valid", F.col("valid") & F.col("broken").isNull()).drop("key", "broken", "schema")
    first = checked.filter("call_id is not null").groupBy("conv_id", "call_id").agg(F.min(F.struct("turn", "part", "tool", "depends_on")).alias("f"))
    first = cut(first.select("conv_id", "call_id", F.col("f.turn").alias("call_turn"), F.col("f.part").alias("call_part"), F.col("f.depends_on").alias("depends_on")))
    level = levels(first.select("conv_id", "call_id", "depends_on"))
    placed = first.select("conv_id", "call_id", "call_turn", "call_part").join(level, ["conv_id", "call_id"])
    said = F.try_parse_json("text")
    results = parsed.filter(has_result).select("conv_id", "turn", "role", F.col("_r.tool_call_id").alias("call_id"), F.col("_r.content").alias("content"), F.when(said.isNull(), F.col("text")).otherwise(_said(_without(_fields(said), "tool_call_id", "content"))).alias("extra"))
    answered = results.join(placed, ["conv_id", "call_id"], "left").withColumn("linked", F.coalesce(F.col("call_turn") < F.col("turn"), F.lit(False)))
    answers = answered.filter("linked").groupBy("conv_id", "call_id").agg(F.count("*").alias("answers"))
    asked = checked.join(placed, ["conv_id", "call_id"], "left").join(answers, ["conv_id", "call_id"], "left")
    own = F.coalesce((F.col("turn") == F.col("call_turn")) & (F.col("part") == F.col("call_part")), F.lit(False))
    call_rows = asked.select("conv_id", "turn", "role", F.lit("call").alias("kind"), "call_id", "tool", (own & F.col("answers").isNotNull()).alias("linked"), "valid", F.col("turn").alias("anchor_turn"), F.when(own, F.col("level")).alias("level"), "part", F.to_json(F.struct(F.coalesce(F.try_parse_json("arguments"), F.try_parse_json(F.to_json(F.array("arguments")))).alias("arguments"), F.col("call_id").alias("id"), F.col("tool").alias("name"), "role")).alias("json"), "extra", "turn_json", "declared", "unchecked")
    none = F.lit(None).cast("string")
    result_rows = answered.select("conv_id", "turn", "role", F.lit("result").alias("kind"), "call_id", F.lit(None).cast("string").alias("tool"), "linked", F.col("linked").alias("valid"), F.when(F.col("linked"), F.col("call_turn")).otherwise(F.col("turn")).alias("anchor_turn"), F.when(F.col("linked"), F.col("level")).alias("level"), F.when(F.col("linked"), F.col("call_part")).otherwise(F.lit(0)).alias("part"), F.to_json(F.struct("content", "role", F.col("call_id").alias("tool_call_id"))).alias("json"), "extra", none.alias("turn_json"), F.lit(None).cast("boolean").alias("declared"), none.alias("unchecked"))
    plain = parsed.filter(~has_calls & ~has_result)
    plain_rows = plain.select("conv_id", "turn", "role", F.lit("message").alias("kind"), none.alias("call_id"), none.alias("tool"), F.lit(False).alias("linked"), F.lit(True).alias("valid"), F.col("turn").alias("anchor_turn"), F.lit(None).cast("int").alias("level"), F.lit(0).alias("part"), F.to_json(F.struct(or_empty(F.col("text")).alias("content"), or_empty(F.col("role")).alias("role"))).alias("json"), none.alias("extra"), none.alias("turn_json"), F.lit(None).cast("boolean").alias("declared"), none.alias("unchecked"))
    return plain_rows.unionByName(call_rows).unionByName(result_rows)
