"""Chat formatting: tool calls linked to their results, ordered, validated and written as canonical JSON.

Calls and results are hash-joined by conversation and identifier. A call may depend on others of its conversation:
its level is 0 without dependencies, else 1 more than the highest among them, so ordering by level, turn and
place is a topological order. Arguments are checked against the schema of their tool. A record is JSON with
sorted keys and no spaces. Built-in functions only; a conversation is never gathered into one row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, once, read, text_of

#: Tool -> field -> (JSON type, required[, rules: enum, minimum, maximum, items (a JSON type), properties (fields of an object)]).
SCHEMAS = {"instruct": {"text": ("string", True), "turn": ("integer", True)}, "ask": {"text": ("string", True), "turn": ("integer", True)}}
#: The same with a bound on turns, for `op1_tool_calls_strict`.
STRICT = {"instruct": {"text": ("string", True), "turn": ("integer", True, {"maximum": 0})}, "ask": {"text": ("string", True), "turn": ("integer", True, {"minimum": 1, "maximum": 4}), "topic": ("string", False, {"enum": ["any", "none"]})}}
TYPES = {"string": "^STRING", "integer": "^BIGINT", "number": "^(BIGINT|DOUBLE|DECIMAL)", "boolean": "^BOOLEAN", "object": "^OBJECT", "array": "^ARRAY", "null": "^VOID"}


def plain_numbers(json: Column) -> Column:
    """JSON text, as `to_json` writes it, with one form for every number: integers without a point, others as doubles."""
    inside, quote = F.lit("\u0001"), F.lit("\u0002")  # `to_json` escapes these two, so they stand for what ends no string
    parts = F.split(F.replace(F.replace(json, F.lit("\\\\"), inside), F.lit('\\"'), quote), '"', -1)
    value = lambda t: t.try_cast("double")
    whole = lambda t: (F.floor(value(t)) == value(t)) & (F.abs(value(t)) < 1e15)
    number = lambda t: F.when(whole(t), F.floor(value(t)).cast("long").cast("string")).otherwise(value(t).cast("string"))
    tokens = lambda p: F.regexp_extract_all(p, F.lit("-?[0-9][0-9.eE+-]*|[^0-9-]+"), F.lit(0))
    outside = lambda p: F.array_join(F.transform(tokens(p), lambda t: F.when(t.rlike("^-?[0-9].*[.eE]"), number(t)).otherwise(t)), "")
    # Every second part is a string.
    joined = F.array_join(F.transform(parts, lambda p, i: F.when(i % 2 == 0, outside(p)).otherwise(p)), '"')
    return F.replace(F.replace(joined, quote, F.lit('\\"')), inside, F.lit("\\\\"))


def canonical_json(col: Column) -> Column:
    """JSON text with sorted keys, no spaces and one form for every number; null where it is no JSON or repeats a key."""
    return plain_numbers(F.to_json(F.try_parse_json(col)))


def wrong_in(value: Column, fields: dict, label: str) -> Column:
    """What is wrong in an object (variant): an array of sentences, by field; `label` stands before the fields' names."""
    there = F.coalesce(F.json_object_keys(F.to_json(value)), F.array().cast("array<string>"))
    found = [F.array().cast("array<string>")]
    for field, (type_, required, *more) in sorted(fields.items()):
        rules, name, has = (more or [{}])[0], f"{label}{field}", F.array_contains(there, field)
        part = F.try_variant_get(value, f'$["{field}"]', "variant")
        fits = F.coalesce(F.schema_of_variant(part).rlike(TYPES[type_]), F.lit(False))
        said = [F.when(~has, F.lit(f"{name} is missing"))] if required else []
        said.append(F.when(has & ~fits, F.lit(f"{name} is not of type {type_}")))
        if "enum" in rules:
            said.append(F.when(has & fits & ~F.try_variant_get(part, "$", "string").isin(*rules["enum"]), F.lit(f"{name} is none of {', '.join(rules['enum'])}")))
        for key, beyond, word in (("minimum", lambda n, most: n < most, "below"), ("maximum", lambda n, most: n > most, "above")):
            if key in rules:
                said.append(F.when(has & fits & beyond(F.try_variant_get(part, "$", "double"), F.lit(rules[key])), F.lit(f"{name} is {word} {rules[key]}")))
        if "items" in rules:
            items = F.coalesce(F.try_variant_get(part, "$", "array<variant>"), F.array().cast("array<variant>"))
            said.append(F.when(has & fits & F.exists(items, lambda x: ~F.coalesce(F.schema_of_variant(x).rlike(TYPES[rules["items"]]), F.lit(False))), F.lit(f"an item of {name} is not of type {rules['items']}")))
        found.append(F.array_compact(F.array(*said)))
        if "properties" in rules:
            found.append(F.when(has & fits, wrong_in(part, rules["properties"], f"{name}.")).otherwise(F.array().cast("array<string>")))
    unknown = F.array_sort(F.array_except(there, F.array(*[F.lit(f) for f in fields]).cast("array<string>")))
    return F.concat(*found, F.transform(unknown, lambda f: F.concat(F.lit(label), f, F.lit(" is not known"))))


def complaints(name: Column, arguments: Column, schemas: dict[str, dict]) -> Column:
    """What is wrong with a call's arguments (canonical JSON, so that 2.0 is an integer), in a fixed order; nothing for a valid call."""

    def judged(value: Column) -> Column:
        branches = F.when(value.isNull(), F.array(F.lit("arguments are not JSON"))).when(~F.schema_of_variant(value).rlike("^OBJECT"), F.array(F.lit("arguments are not an object")))
        for tool, fields in sorted(schemas.items()):
            branches = branches.when(name == tool, wrong_in(value, fields, ""))
        return branches.otherwise(F.array(F.lit("no such tool")))

    return once(F.try_parse_json(arguments), judged)


def hashed(left: DataFrame, right: DataFrame, on: str, how: str = "inner") -> DataFrame:
    """A hash join that builds on `right`, which has a row for each key."""
    return left.join(right.hint("shuffle_hash"), on, how)


def jumped(single: DataFrame) -> DataFrame:
    """key, at, far, moved: where the chain of calls with one dependency ends (a call with none or several) and how far; `moved` on a cycle or behind one.

    Pointers are doubled, so a chain of n calls takes a logarithm of rounds. A chain stays in its conversation: what
    still moves after as many steps as that has such calls is on no chain that ends.
    """
    jumps, steps = cut(single.select("key", F.col("on").alias("at"), F.lit(1).cast("long").alias("far"), F.lit(False).alias("moved"))), 1
    longest = jumps.groupBy("key.conv_id").count().agg(F.max("count")).first()[0] or 0
    while longest:
        ahead = jumps.select(F.col("key").alias("at"), F.col("at").alias("_at"), F.col("far").alias("_far"))
        met = hashed(jumps, ahead, "at", "left")
        jumps = cut(met.select("key", F.coalesce("_at", "at").alias("at"), (F.col("far") + F.coalesce("_far", F.lit(0))).alias("far"), F.col("_at").isNotNull().alias("moved")))
        if steps >= longest or jumps.filter("moved").isEmpty():
            break
        steps *= 2
    return jumps


def levels(edges: DataFrame, calls: DataFrame) -> DataFrame:
    """key, level of the calls (distinct `key`) under edges (key, on); level is null on a cycle or behind one.

    Chains of calls with one dependency are followed by `jumped`. What is left are calls with several: every round settles
    those whose dependencies all are, and tells the newest ones to the edges that wait for them.
    """
    edges = cut(edges.select("key", "on").distinct())
    if edges.isEmpty():
        return calls.select("key", F.lit(0).cast("long").alias("level"))
    counts = cut(edges.groupBy("key").agg(F.count("*").alias("waits"), F.min("on").alias("on")))
    jumps, several = jumped(counts.filter("waits = 1")), counts.filter("waits > 1").select("key")
    deep = several.select(F.col("key").alias("at"), F.lit(True).alias("deep"))

    # Edges of calls with several dependencies, to the ends of chains.
    ends = jumps.select(F.col("key").alias("on"), F.col("at").alias("_at"), "far", "moved")
    to_ends = hashed(hashed(edges, several, "key", "left_semi"), ends, "on", "left").select("key", F.coalesce("_at", "on").alias("at"), F.coalesce("far", F.lit(0)).alias("far"), F.coalesce("moved", F.lit(False)).alias("moved"))
    known = F.when(F.col("deep").isNull() & ~F.col("moved"), F.col("far"))
    open_ = cut(hashed(to_ends, deep, "at", "left").select("key", "at", "far", known.alias("top")))
    settled = []
    while not open_.isEmpty():
        newest = cut(open_.groupBy("key").agg(F.count("*").alias("n"), F.count("top").alias("known"), F.max("top").alias("top")).filter("n = known").select("key", (F.col("top") + 1).alias("level")))
        if newest.isEmpty():
            break
        settled.append(newest)
        told = hashed(hashed(open_, newest.select("key"), "key", "left_anti"), newest.withColumnRenamed("key", "at"), "at", "left")
        open_ = cut(told.select("key", "at", "far", F.coalesce("top", F.col("level") + F.col("far")).alias("top")))

    tops = reduce(DataFrame.unionByName, settled, several.select("key", F.lit(None).cast("long").alias("level")).limit(0))
    above = hashed(deep, tops.withColumnRenamed("key", "at"), "at", "left")
    chained = hashed(jumps.filter("NOT moved"), above, "at", "left").select("key", F.when(F.col("deep").isNull(), F.col("far")).otherwise(F.col("far") + F.col("level")).alias("level"))
    free = hashed(calls, counts.select("key"), "key", "left_anti").select("key", F.lit(0).cast("long").alias("level"))
    return hashed(calls, free.unionByName(chained).unionByName(tops), "key", "left")


def link_calls(calls: DataFrame, results: DataFrame, schemas: dict = SCHEMAS) -> DataFrame:
    """One row per call, and one per result that answers no call.

    calls: conv_id, call_id, turn, place (in its turn), name, arguments (JSON text), depends_on (array of call ids);
    results: conv_id, call_id, turn, content; other columns are not read, whatever their names. Returned: conv_id,
    call_id, topo_level, turn, place, name, arguments (canonical JSON), valid, errors, result, result_turn, status and
    record (canonical JSON of the row). status is `linked`, `unanswered`, `cycle` (its dependencies never settle),
    `unnamed` (a null call id) or `orphan` (a result without a call). Calls and results meet on both columns of
    (conv_id, call_id). Of several results of one call the first by turn counts, of one turn the first by content.
    Dependencies on ids that no call has are left out, as are null ones and a null array. Repeated calls are rows of their
    own with the same links; a null conversation is one of its own, and not the one named by an empty text. Null or empty
    arguments are no JSON. Texts of any length are read whole. Empty tables give no rows.
    """
    # A key compares its two columns, a null conversation included; without a call id it is null and meets no other.
    key = lambda call: F.when(F.col(call).isNotNull(), F.struct("conv_id", F.col(call).alias("call_id"))).alias("key")
    calls = calls.select(key("call_id"), "conv_id", "call_id", "turn", "place", "name", "arguments", "depends_on")
    results = results.select(key("call_id"), "conv_id", "call_id", "turn", "content")
    named = cut(calls.filter("key IS NOT NULL").select("key").distinct())
    wanted = calls.filter("key IS NOT NULL").select("conv_id", "key", F.explode("depends_on").alias("_on")).select("key", key("_on").alias("on"))
    ranked = cut(levels(hashed(wanted, named.withColumnRenamed("key", "on"), "on", "left_semi"), named))
    first = results.filter("key IS NOT NULL").groupBy("key").agg(F.min_by(F.struct("content", "turn"), F.struct("turn", "content")).alias("got"))
    linked = hashed(hashed(calls.withColumn("arguments", canonical_json(F.col("arguments"))), ranked, "key", "left"), cut(first), "key", "left")
    status = F.when(F.col("key").isNull(), "unnamed").when(F.col("level").isNull(), "cycle").when(F.col("got").isNull(), "unanswered").otherwise("linked")
    wrong = complaints(F.col("name"), F.col("arguments"), schemas)
    linked = linked.select(
        "conv_id", "call_id", F.col("level").cast("int").alias("topo_level"), "turn", "place", "name", "arguments", wrong.alias("wrong"),
        F.col("got.content").alias("result"), F.col("got.turn").alias("result_turn"), status.alias("status"))
    none = lambda type_, name: F.lit(None).cast(type_).alias(name)
    orphans = hashed(results, named, "key", "left_anti").select(
        "conv_id", "call_id", none("int", "topo_level"), none("long", "turn"), none("int", "place"), none("string", "name"), none("string", "arguments"), none("array<string>", "wrong"),
        F.col("content").alias("result"), F.col("turn").alias("result_turn"), F.lit("orphan").alias("status"))
    whole = linked.unionByName(orphans)
    record = F.to_json(F.struct(F.try_parse_json("arguments").alias("arguments"), F.col("call_id").alias("id"), F.col("topo_level").alias("level"), "name", "result", "status"))
    valid, errors = F.coalesce(F.size("wrong") == 0, F.lit(False)), F.coalesce(F.array_join("wrong", "; "), F.lit(""))
    ends = ["conv_id", "call_id", "topo_level", "turn", "place", "name", "arguments", valid.alias("valid"), errors.alias("errors"), "result", "result_turn", "status", record.alias("record")]
    return whole.select(*ends)


def from_turns(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results of plain conversations (conv_id, turn, role, text).

    A system turn is a call of `instruct`, a user turn one of `ask`, identified by its turn; an assistant turn is the
    result of the call in the turn before. Every later call depends on its conversation's opening turn.
    """
    called = messages.filter(F.col("role").isin("system", "user"))
    arguments = F.to_json(F.struct(F.col("text"), F.col("turn")))
    on = F.when(F.col("turn") > 0, F.array(F.lit("0"))).otherwise(F.array().cast("array<string>"))
    calls = called.select("conv_id", F.col("turn").cast("string").alias("call_id"), F.col("turn").cast("long").alias("turn"), F.lit(0).alias("place"), F.when(F.col("role") == "system", "instruct").otherwise("ask").alias("name"), arguments.alias("arguments"), on.alias("depends_on"))
    answered = messages.filter(F.col("role") == "assistant")
    return calls, answered.select("conv_id", (F.col("turn") - 1).cast("string").alias("call_id"), F.col("turn").cast("long").alias("turn"), F.col("text").alias("content"))


def inline_calls(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results written inside texts, as <tool_call>{"id", "name", "arguments", "depends_on"}</tool_call> and <tool_result>{"id", "content"}</tool_result>."""

    def blocks(tag: str) -> DataFrame:
        found = F.regexp_extract_all(text_of(), F.lit(f"(?s)<{tag}>(.*?)</{tag}>"), F.lit(1))
        return messages.select("conv_id", F.col("turn").cast("long").alias("turn"), F.posexplode(found).alias("place", "body")).withColumn("v", F.try_parse_json("body"))

    get = lambda path, type_: F.try_variant_get("v", path, type_)
    calls = blocks("tool_call").select("conv_id", get("$.id", "string").alias("call_id"), "turn", "place", get("$.name", "string").alias("name"), F.to_json(get("$.arguments", "variant")).alias("arguments"), F.coalesce(get("$.depends_on", "array<string>"), F.array().cast("array<string>")).alias("depends_on"))
    return calls, blocks("tool_result").select("conv_id", get("$.id", "string").alias("call_id"), "turn", get("$.content", "string").alias("content"))


def op1_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turns of `conversations` as calls and results, with whatever calls stand inside their texts."""
    messages = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    pairs = from_turns(messages), inline_calls(messages)
    return link_calls(*[reduce(DataFrame.unionByName, side) for side in zip(*pairs, strict=True)])


def op1_tool_calls_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User and system turns as calls that bound their turn, name a topic of a fourth kind in every fifth conversation, and depend on the turn 2 before them.

    In every seventh conversation the opening turn depends on turn 2 in turn, so all its even turns are a cycle or behind one.
    """
    messages = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    calls, results = from_turns(messages)
    turn, conv = F.col("turn"), F.col("conv_id")
    topic = F.when(conv % 5 == 0, F.to_json(F.struct("text", turn.cast("double").alias("turn"), F.lit("new").alias("topic")))).otherwise(F.col("arguments"))
    on = F.when((turn == 0) & (conv % 7 == 0), F.array(F.lit("2"))).when(turn > 0, F.array((F.least(turn, F.lit(4)) - 2).cast("string"))).otherwise(F.array().cast("array<string>"))
    body = calls.select("*", F.get_json_object("arguments", "$.text").alias("text"))
    return link_calls(body.withColumns({"arguments": topic, "depends_on": on}), results, STRICT).select("conv_id", "call_id", "topo_level", "name", "valid", "errors", "status", F.get_json_object("record", "$.arguments.turn").alias("turn_text"))


OP1_SQL = r"""
WITH c AS (SELECT conv_id, turn::VARCHAR AS call_id, turn, CASE role WHEN 'system' THEN 'instruct' ELSE 'ask' END AS name, text FROM conversations WHERE role IN ('system', 'user')),
r AS (SELECT conv_id, (turn - 1)::VARCHAR AS call_id, turn, text FROM conversations WHERE role = 'assistant'),
o AS (SELECT DISTINCT conv_id FROM c WHERE turn = 0),
g AS (SELECT conv_id, call_id, arg_min(text, turn) AS result, min(turn) AS result_turn FROM r GROUP BY ALL),
x AS (SELECT c.conv_id, c.call_id, CASE WHEN c.turn > 0 AND o.conv_id IS NOT NULL THEN 1 ELSE 0 END AS topo_level, c.turn, 0 AS place, c.name,
  '{"text":' || to_json(c.text) || ',"turn":' || c.turn || '}' AS arguments, true AS valid, '' AS errors, result, result_turn, CASE WHEN result_turn IS NULL THEN 'unanswered' ELSE 'linked' END AS status
  FROM c LEFT JOIN o USING (conv_id) LEFT JOIN g ON g.conv_id = c.conv_id AND g.call_id = c.call_id
  UNION ALL SELECT r.conv_id, r.call_id, NULL, NULL, NULL, NULL, NULL, false, '', r.text, r.turn, 'orphan' FROM r LEFT JOIN c ON c.conv_id = r.conv_id AND c.call_id = r.call_id WHERE c.call_id IS NULL)
SELECT *, '{' || CASE WHEN arguments IS NULL THEN '' ELSE '"arguments":' || arguments || ',' END || '"id":"' || call_id || '"' || CASE WHEN topo_level IS NULL THEN '' ELSE ',"level":' || topo_level || ',"name":"' || name || '"' END
  || CASE WHEN result IS NULL THEN '' ELSE ',"result":' || to_json(result) END || ',"status":"' || status || '"}' AS record FROM x
"""
#: Even turns of a conversation call; turns 2 and 4 stand for all that depend on 0 and 2.
OP1_STRICT_SQL = r"""
WITH c AS (SELECT conv_id, turn, CASE role WHEN 'system' THEN 'instruct' ELSE 'ask' END AS name FROM conversations WHERE role IN ('system', 'user')),
r AS (SELECT DISTINCT conv_id, turn - 1 AS turn FROM conversations WHERE role = 'assistant'),
e AS (SELECT c.conv_id, c.turn, CASE WHEN c.turn = 0 AND c.conv_id % 7 = 0 THEN 2 WHEN c.turn > 0 THEN least(c.turn, 4) - 2 END AS dep FROM c),
d AS (SELECT e.conv_id, e.turn, CASE WHEN x.turn IS NOT NULL THEN e.dep END AS dep FROM e LEFT JOIN (SELECT DISTINCT conv_id, turn FROM c) x ON x.conv_id = e.conv_id AND x.turn = e.dep),
u AS (SELECT DISTINCT * FROM d),
l AS (SELECT a.conv_id, a.turn, CASE WHEN a.dep IS NULL THEN 0 WHEN b.dep IS NULL THEN 1 WHEN g.dep IS NULL THEN 2 WHEN h.dep IS NULL THEN 3 END AS level FROM u a LEFT JOIN u b ON b.conv_id = a.conv_id AND b.turn = a.dep LEFT JOIN u g ON g.conv_id = b.conv_id AND g.turn = b.dep LEFT JOIN u h ON h.conv_id = g.conv_id AND h.turn = g.dep),
w AS (SELECT c.*, list_filter([CASE WHEN name = 'ask' AND conv_id % 5 = 0 THEN 'topic is none of any, none' END, CASE WHEN name = 'instruct' AND turn > 0 THEN 'turn is above 0' WHEN name = 'ask' AND turn < 1 THEN 'turn is below 1' WHEN name = 'ask' AND turn > 4 THEN 'turn is above 4' END,
  CASE WHEN name = 'instruct' AND conv_id % 5 = 0 THEN 'topic is not known' END], lambda x: x IS NOT NULL) AS wrong FROM c)
SELECT w.conv_id, w.turn::VARCHAR AS call_id, level AS topo_level, name, len(wrong) = 0 AS valid, array_to_string(wrong, '; ') AS errors, CASE WHEN level IS NULL THEN 'cycle' WHEN r.turn IS NULL THEN 'unanswered' ELSE 'linked' END AS status, w.turn::VARCHAR AS turn_text
FROM w JOIN l USING (conv_id, turn) LEFT JOIN r USING (conv_id, turn)
UNION ALL SELECT m.conv_id, (m.turn - 1)::VARCHAR, NULL, NULL, false, '', 'orphan', NULL FROM conversations m WHERE role = 'assistant' AND NOT EXISTS (SELECT 1 FROM c WHERE c.conv_id = m.conv_id AND c.turn = m.turn - 1)
"""
