"""Chat formatting with tool-call linking, in DataFrame functions only.

An assistant turn whose text is a JSON object with an array ``tool_calls`` of
{id, name, arguments} makes calls; a turn of role ``tool`` whose text is a JSON object
with ``tool_call_id`` is a result, linked to its call by a hash join on conversation and
identifier. The result is one row for each message: plain turns, calls and results, with
its place (order_turn, order_step, turn, call_index) in an order in which conversation
turns keep theirs and no result comes before its call. Rows are not gathered by
conversation, so that a conversation of any length needs no single task.

Arguments are objects (or strings that hold one) checked against the tool's schema: a
JSON-Schema subset of ``properties`` with ``type``, ``required`` and
``additionalProperties: false``. JSON is canonical: keys sorted, no spaces.

The first call of an identifier (by turn and index, and of equal rows one) gets its
results; others with that identifier and calls without one are errors, as are results
without a call. Null text is empty, null roles stay null; a null conv_id is a conversation
like others, and a null turn comes first in it. Text that is no such JSON is a plain
message, however long. Repeated rows are messages of their own. An empty table gives no
rows. Other columns are ignored, also those of the same names as results.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, numbered, table, text_or_empty

#: JSON-Schema types and what schema_of_variant calls them.
TYPES = {"string": "STRING", "integer": "BIGINT|DECIMAL\\(\\d+,0\\)", "number": "BIGINT|DOUBLE|FLOAT|DECIMAL.*", "boolean": "BOOLEAN", "array": "ARRAY<.*", "object": "OBJECT<.*", "null": "VOID"}


def _property(arguments: Column, key: str) -> Column:
    """A property of an object as a variant; null if there is none."""
    quote = '"' if "'" in key else "'"
    if quote in key:
        raise ValueError(f"a property may have one kind of quotes in its name: {key}")
    return F.try_variant_get(arguments, f"$[{quote}{key}{quote}]", "variant")


def argument_errors(name: Column, arguments: Column, schemas: Mapping[str, Mapping]) -> Column:
    """The faults of a call's arguments (a variant) as an array of strings."""
    kind = F.schema_of_variant(arguments)
    errors = F.when(arguments.isNull() | ~kind.startswith("OBJECT"), F.array(F.lit("arguments: not an object")))
    for tool, schema in schemas.items():
        found = []
        for key, rule in schema.get("properties", {}).items():
            is_a = F.schema_of_variant(_property(arguments, key))
            if "type" in rule:
                found.append(F.when(is_a.isNotNull() & ~is_a.rlike(f"^(?:{TYPES[rule['type']]})$"), F.lit(f"{key}: not {rule['type']}")))
        found += [F.when(_property(arguments, key).isNull(), F.lit(f"{key}: missing")) for key in schema.get("required", ())]
        if schema.get("additionalProperties") is False:
            known = F.array(*[F.lit(k) for k in schema.get("properties", {})]) if schema.get("properties") else F.array().cast("array<string>")
            more = F.array_except(F.map_keys(F.from_json(F.to_json(arguments), "map<string,string>")), known)
            found.append(F.when(F.size(more) > 0, F.concat(F.lit("unknown: "), F.array_join(F.array_sort(more), ","))))
        errors = errors.when(name == tool, F.filter(F.array(*found), lambda e: e.isNotNull()) if found else F.array().cast("array<string>"))
    return errors.when(F.lit(bool(schemas)) & ~F.coalesce(name, F.lit("")).isin(*schemas), F.array(F.lit("unknown tool"))).otherwise(F.array().cast("array<string>"))


def linked_messages(turns: DataFrame, schemas: Mapping[str, Mapping] | None = None) -> DataFrame:
    """conv_id, turn, call_index, role, kind, call_id, linked, errors, order_turn, order_step, json."""
    schemas = schemas or {}
    rows = numbered(turns.select("conv_id", "turn", "role", "text"), Scratch(turns.sparkSession, "turns"))
    text = text_or_empty()
    json_like = text.rlike(r"^\s*\{")
    read = rows.select("_row", "conv_id", "turn", "role", text.alias("text"), F.when(json_like & F.col("role").isin("assistant", "tool"), F.try_parse_json(text)).alias("v"))
    calls = F.try_variant_get("v", "$.tool_calls", "array<variant>")
    call_id = F.try_variant_get("v", "$.tool_call_id", "string")
    kind = F.when((F.col("role") == "assistant") & calls.isNotNull(), "call").when((F.col("role") == "tool") & call_id.isNotNull(), "result").otherwise("message")
    read = read.withColumn("kind", kind)
    none, no = F.lit(None).cast("string"), F.array().cast("array<string>")

    plain = read.where("kind = 'message'").select(
        "conv_id", "turn", F.lit(-1).alias("call_index"), "role", "kind", none.alias("call_id"), F.lit(None).cast("boolean").alias("linked"), no.alias("errors"),
        F.col("turn").alias("order_turn"), F.lit(0).alias("order_step"), F.to_json(F.struct(F.col("text").alias("content"), "role"), {"ignoreNullFields": "false"}).alias("json"),
    )
    each = read.where("kind = 'call'").select("_row", "conv_id", "turn", "role", "kind", F.posexplode_outer(calls).alias("call_index", "c"))
    given = F.try_variant_get("c", "$.arguments", "variant")
    arguments = F.when(F.schema_of_variant(given) == "STRING", F.try_parse_json(F.try_variant_get("c", "$.arguments", "string"))).otherwise(given)
    each = each.select("_row", "conv_id", "turn", "role", "kind", F.coalesce("call_index", F.lit(-1)).alias("call_index"), F.try_variant_get("c", "$.id", "string").alias("call_id"), F.try_variant_get("c", "$.name", "string").alias("name"), arguments.alias("arguments"))
    first = each.where("call_id IS NOT NULL").groupBy("conv_id", "call_id").agg(F.min(F.struct("turn", "call_index", "_row")).alias("first"))
    results = read.where("kind = 'result'").select("conv_id", "turn", "role", "kind", call_id.alias("call_id"), F.to_json(F.try_variant_get("v", "$.content", "variant")).alias("content"))
    answered = results.select("conv_id", "call_id").distinct().withColumn("answered", F.lit(True))

    made = _linked(_linked(each, first), answered)
    owner = (F.col("first._row") == F.col("_row")) & (F.col("first.call_index") == F.col("call_index"))
    faults = F.when(F.col("call_id").isNull(), F.array(F.lit("id: missing"))).when(~owner, F.array(F.lit("id: repeated"))).otherwise(no)
    call_json = F.concat(F.lit('{"arguments":'), F.coalesce(F.to_json("arguments"), F.lit("null")), F.lit(',"id":'), _quoted("call_id"), F.lit(',"name":'), _quoted("name"), F.lit(',"role":"assistant","type":"tool_call"}'))
    made = made.select(
        "conv_id", "turn", "call_index", "role", "kind", "call_id", F.coalesce(owner & F.col("answered"), F.lit(False)).alias("linked"),
        F.concat(faults, argument_errors(F.col("name"), F.col("arguments"), schemas)).alias("errors"), F.col("turn").alias("order_turn"), F.lit(0).alias("order_step"), call_json.alias("json"),
    )
    back = _linked(results, first)
    back = back.select(
        "conv_id", "turn", F.coalesce("first.call_index", F.lit(-1)).alias("call_index"), "role", "kind", "call_id", F.col("first").isNotNull().alias("linked"),
        F.when(F.col("first").isNull(), F.array(F.lit("call: missing"))).otherwise(no).alias("errors"),
        F.greatest(F.col("turn"), F.col("first.turn")).alias("order_turn"), F.lit(1).alias("order_step"),
        F.concat(F.lit('{"content":'), F.coalesce("content", F.lit("null")), F.lit(',"role":"tool","tool_call_id":'), _quoted("call_id"), F.lit("}")).alias("json"),
    )
    return plain.unionByName(made).unionByName(back)


def _linked(rows: DataFrame, one: DataFrame) -> DataFrame:
    """A left hash join by conversation and identifier; conversations without an id are one."""
    keys = one.select(F.col("conv_id").alias("_conv"), F.col("call_id").alias("_call"), *[c for c in one.columns if c not in ("conv_id", "call_id")])
    return rows.join(keys.hint("shuffle_hash"), F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("call_id") == F.col("_call")), "left").drop("_conv", "_call")


def _quoted(name: str) -> Column:
    """A string column as JSON."""
    return F.when(F.col(name).isNull(), "null").otherwise(F.regexp_extract(F.to_json(F.struct(F.col(name).alias("x"))), r'(?s)^\{"x":(.*)\}$', 1))


#: The tools that the registered query validates calls against.
SCHEMAS = {
    "search": {"properties": {"query": {"type": "string"}, "limit": {"type": "integer"}}, "required": ["query"], "additionalProperties": False},
    "fetch": {"properties": {"url": {"type": "string"}}, "required": ["url"]},
}


def with_tool_turns(conversations: DataFrame) -> DataFrame:
    """The turns of a table that has no tool calls (at four times their numbers), and between them calls and results that
    follow from conversation and turn alone. After each assistant turn comes a call to search, in some also one to fetch
    whose arguments are a string. Of every six calls one each lacks its id, has a limit of the wrong type, no query, an
    unknown argument, or a tool that is unknown; every tenth conversation gives all of its calls one id. Of every five
    calls one each has no result, an early one, or two; a call without an id is answered under an id that no call has."""
    said = conversations.select("conv_id", (F.col("turn") * 4).alias("turn"), "role", "text")
    made = conversations.where("role = 'assistant'").selectExpr("conv_id", "turn", "(conv_id * 7 + turn) % 6 AS v", "(conv_id + turn) % 5 AS w")
    made = made.withColumn("id", F.expr("CASE WHEN v = 0 THEN NULL WHEN conv_id % 10 = 0 THEN 'same' ELSE concat('a', turn) END"))
    search = F.expr("""concat('{', coalesce(concat('"id":"', id, '",'), ''), '"name":"', if(v = 5, 'unknown', 'search'), '","arguments":{', if(v = 2, '', concat('"query":"q', conv_id, '-', turn, '",')), if(v = 3, '"zzz":true,', ''), '"limit":', if(v = 1, '"many"', string(turn)), '}}')""")
    fetch = F.expr("""if(w = 3, concat(',{"id":"b', turn, '","name":"fetch","arguments":"{\\\\"url\\\\":\\\\"u', conv_id, '\\\\"}"}'), '')""")
    calls = made.select("conv_id", F.expr("turn * 4 + 1").alias("turn"), F.lit("assistant").alias("role"), F.concat(F.lit('{"tool_calls":['), search, fetch, F.lit("]}")).alias("text"))
    at = "CASE WHEN v = 0 OR w >= 3 THEN array(2) WHEN w = 0 THEN array() WHEN w = 1 THEN array(-1) ELSE array(2, 3) END"
    results = made.select("conv_id", "turn", F.coalesce("id", F.lit("nobody")).alias("id"), F.explode(F.expr(at)).alias("at"))
    results = results.select("conv_id", (F.col("turn") * 4 + F.col("at")).alias("turn"), F.lit("tool").alias("role"), F.expr("""concat('{"tool_call_id":"', id, '","content":{"rows":', turn, ',"ok":true}}')""").alias("text"))
    return said.unionByName(calls).unionByName(results)


def op5_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked_messages(with_tool_turns(table(spark, sf_dir, "conversations")), SCHEMAS).withColumn("errors", F.array_join("errors", ";")).withColumn("linked", F.coalesce("linked", F.lit(False)))


OP5_SQL = """
WITH a AS (SELECT conv_id, turn, (conv_id * 7 + turn) % 6 AS v, (conv_id + turn) % 5 AS w, CASE WHEN v = 0 THEN NULL WHEN conv_id % 10 = 0 THEN 'same' ELSE 'a' || turn END AS id FROM conversations WHERE role = 'assistant'),
r AS (SELECT conv_id, turn, turn * 4 + unnest(CASE WHEN v = 0 OR w >= 3 THEN [2] WHEN w = 0 THEN []::INT[] WHEN w = 1 THEN [-1] ELSE [2, 3] END) AS place, coalesce(id, 'nobody') AS id FROM a),
f AS (SELECT conv_id, id, min(turn * 4 + 1) AS first FROM a WHERE id IS NOT NULL GROUP BY ALL),
answered AS (SELECT DISTINCT conv_id, id FROM r)
SELECT conv_id, turn * 4 AS turn, -1 AS call_index, role, 'message' AS kind, NULL::VARCHAR AS call_id, false AS linked, '' AS errors, turn * 4 AS order_turn, 0 AS order_step,
  '{"content":' || to_json(text)::VARCHAR || ',"role":' || to_json(role)::VARCHAR || '}' AS json FROM conversations
UNION ALL
SELECT a.conv_id, turn * 4 + 1, 0, 'assistant', 'call', a.id, coalesce(first = turn * 4 + 1 AND answered.id IS NOT NULL, false),
  array_to_string(list_filter([CASE WHEN a.id IS NULL THEN 'id: missing' WHEN first < turn * 4 + 1 THEN 'id: repeated' END, CASE v WHEN 5 THEN 'unknown tool' WHEN 1 THEN 'limit: not integer' WHEN 2 THEN 'query: missing' WHEN 3 THEN 'unknown: zzz' END], lambda x: x IS NOT NULL), ';'),
  turn * 4 + 1, 0,
  '{"arguments":{"limit":' || CASE WHEN v = 1 THEN '"many"' ELSE turn::VARCHAR END || CASE WHEN v = 2 THEN '' ELSE ',"query":"q' || a.conv_id || '-' || turn || '"' END || CASE WHEN v = 3 THEN ',"zzz":true' ELSE '' END
    || '},"id":' || coalesce('"' || a.id || '"', 'null') || ',"name":"' || CASE WHEN v = 5 THEN 'unknown' ELSE 'search' END || '","role":"assistant","type":"tool_call"}'
FROM a LEFT JOIN f ON a.conv_id = f.conv_id AND a.id = f.id LEFT JOIN answered ON a.conv_id = answered.conv_id AND a.id = answered.id
UNION ALL
SELECT conv_id, turn * 4 + 1, 1, 'assistant', 'call', 'b' || turn, false, '', turn * 4 + 1, 0, '{"arguments":{"url":"u' || conv_id || '"},"id":"b' || turn || '","name":"fetch","role":"assistant","type":"tool_call"}' FROM a WHERE w = 3
UNION ALL
SELECT r.conv_id, place, CASE WHEN first IS NULL THEN -1 ELSE 0 END, 'tool', 'result', r.id, first IS NOT NULL, CASE WHEN first IS NULL THEN 'call: missing' ELSE '' END, greatest(place, first), 1,
  '{"content":{"ok":true,"rows":' || turn || '},"role":"tool","tool_call_id":"' || r.id || '"}'
FROM r LEFT JOIN f ON r.conv_id = f.conv_id AND r.id = f.id
"""
