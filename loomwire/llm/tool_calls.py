"""Operator 3, chat formatting: link tool calls and results, order them, check arguments, write canonical JSON."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwire.llm.columns import table, word_count
from loomwire.session import cut

#: Argument schemas: per tool the properties with type, and bounds where there are any.
SCHEMAS = {
    "ask": {
        "properties": {"prompt": {"type": "string", "max_length": 4000, "min_length": 1}, "turn": {"type": "integer", "minimum": 0}, "words": {"type": "integer", "minimum": 3}},
        "required": ["prompt", "turn"],
        "extra": False,
    },
    "instruct": {
        "properties": {"rules": {"type": "string", "min_length": 1}, "turn": {"type": "integer", "maximum": 0}},
        "required": ["rules"],
        "extra": False,
    },
}
# How schema_of_variant names the JSON types.
TYPE_NAMES = {
    "string": r"^STRING$",
    "integer": r"^(BIGINT|DECIMAL\(\d+,0\))$",
    "number": r"^(BIGINT|DOUBLE|FLOAT|DECIMAL\(\d+,\d+\))$",
    "boolean": r"^BOOLEAN$",
    "array": r"^ARRAY<",
    "object": r"^OBJECT<",
    "null": r"^VOID$",
}


def json_string(c: Column) -> Column:
    """A text as a JSON string literal, null as ``null``."""
    one = F.to_json(F.array(c))
    return F.when(c.isNull(), F.lit("null")).otherwise(F.substring(one, F.lit(2), F.length(one) - 2))


def rule_checks(value: Column, schema: dict, path: str = "$", shown: str = "") -> list[Column]:
    """What is wrong with the object at ``path`` of a variant: entries are null where nothing is."""
    checks = []
    for prop, rule in schema["properties"].items():
        at, name = f"{path}.{prop}", f"{shown}{prop}"
        kind = F.schema_of_variant(F.try_variant_get(value, at, "variant"))
        there = kind.isNotNull()
        right = kind.rlike(TYPE_NAMES[rule["type"]])
        if prop in schema.get("required", ()):
            checks.append(F.when(~there, F.lit(f"missing {name}")))
        checks.append(F.when(there & ~right, F.lit(f"type of {name}")))
        text, number = F.try_variant_get(value, at, "string"), F.try_variant_get(value, at, "double")
        for key, bad in (
            ("min_length", lambda x, t=text: F.length(t) < x),
            ("max_length", lambda x, t=text: F.length(t) > x),
            ("minimum", lambda x, n=number: n < x),
            ("maximum", lambda x, n=number: n > x),
            ("pattern", lambda x, t=text: ~t.rlike(x)),
            ("enum", lambda x, t=text: ~t.isin(*x)),
        ):
            if key in rule:
                checks.append(F.when(there & right & bad(rule[key]), F.lit(f"{key} of {name}")))
        if "items" in rule:
            entries = F.try_variant_get(value, at, "array<variant>")
            fits = TYPE_NAMES[rule["items"]["type"]]
            wrong = F.exists(entries, lambda e: ~F.coalesce(F.schema_of_variant(e).rlike(fits), F.lit(False)))  # noqa: B023
            checks.append(F.when(there & right & wrong, F.lit(f"items of {name}")))
        if "properties" in rule:
            checks += [F.when(there & right, c) for c in rule_checks(value, rule, at, f"{name}.")]
    return checks


def problems(name: Column, arguments: Column, schemas: dict = SCHEMAS) -> Column:
    """Sorted list of what is wrong with a call's arguments (JSON text); empty when they fit the tool's schema.

    A schema has ``properties`` with a ``type`` each, ``required`` names, and ``extra`` (whether other properties may be there). A
    property may have min_length, max_length, pattern, enum, minimum, maximum, ``items`` with the type of an array's
    entries, and ``properties`` of its own. Text that is no JSON object, or names a key twice, is one problem."""
    value = F.try_parse_json(arguments)
    is_object = F.schema_of_variant(value).startswith("OBJECT<")
    found = F.array(F.lit("unknown tool"))
    for tool, schema in schemas.items():
        checks = rule_checks(value, schema)
        listed = F.filter(F.array(*checks), lambda p: p.isNotNull()) if checks else F.array().cast("array<string>")
        if not schema.get("extra", True):
            extra = F.array_except(F.map_keys(value.cast("map<string,variant>")), F.array(*[F.lit(p) for p in schema["properties"]]))
            listed = F.concat(listed, F.transform(extra, lambda p: F.concat(F.lit("extra "), p)))
        found = F.when(name == tool, listed).otherwise(found)
    return F.array_sort(F.when(F.coalesce(is_object, F.lit(False)), found).otherwise(F.array(F.lit("arguments are no JSON object"))))


def canonical_json(text: Column) -> Column:
    """A JSON text with sorted keys, no white space, and whole numbers without a fraction, however they were written (1, 1.0
    and 1e0 are 1); null for other texts. Strings are not touched."""
    made = F.to_json(F.try_parse_json(text))
    pieces = F.regexp_extract_all(made, F.lit(r'("(?:[^"\\]|\\.)*"|[^"]+)'))
    plain = F.transform(pieces, lambda p: F.when(F.startswith(p, F.lit('"')), p).otherwise(F.regexp_replace(p, r"(-?\d+)\.0+(?![0-9])", "$1")))
    return F.when(made.rlike(r"\d\.0"), F.array_join(plain, "")).otherwise(made)


def levels(calls: DataFrame) -> DataFrame:
    """``(conv_id, call_id, level)``: how many calls must come before one, along ``after_id``.

    Every node doubles the distance it looks back in each round, so a chain of n calls takes log2(n) rounds. Calls on
    or behind a cycle get a null level. Identifiers that are no call of the conversation count as absent.
    """
    nodes = calls.select("conv_id", "call_id", "after_id")
    known = nodes.select(F.col("conv_id").alias("c"), F.col("call_id").alias("a"))
    joined = nodes.join(known, nodes["conv_id"].eqNullSafe(known["c"]) & (nodes["after_id"] == known["a"]), "left")
    state = cut(joined.select("conv_id", "call_id", F.col("a").alias("seen"), F.col("a").isNotNull().cast("long").alias("level")))
    total, open_ = state.agg(F.count("*"), F.count("seen")).first()
    for _ in range(math.ceil(math.log2(total + 1)) + 1 if open_ else 0):
        other = state.select(F.col("conv_id").alias("c"), F.col("call_id").alias("k"), F.col("seen").alias("next"), F.col("level").alias("more"))
        step = state.join(other, state["conv_id"].eqNullSafe(other["c"]) & (state["seen"] == other["k"]), "left")
        state = cut(step.select("conv_id", "call_id", F.col("next").alias("seen"), (F.col("level") + F.coalesce("more", F.lit(0))).alias("level")))
        if state.filter("seen IS NOT NULL").limit(1).count() == 0:
            break
    return state.select("conv_id", "call_id", F.when(F.col("seen").isNull(), F.col("level")).alias("level"))


def link_calls(calls: DataFrame, results: DataFrame, schemas: dict = SCHEMAS) -> DataFrame:
    """One row per identifier of a conversation: the call, its result, order, verdict and canonical JSON.

    ``calls``: conv_id, call_id, after_id (the call it builds on, or null), turn, name, arguments (JSON text).
    ``results``: conv_id, call_id, turn, content. An identifier used by several calls or results keeps the one of the
    least turn (then the least other columns); ``n_calls`` and ``n_results`` tell how many there were. ``status``: ok,
    invalid, no result, no call, cycle, or no id for calls and results without identifier, which stay rows of their
    own. ``level`` is the topological level (callers order by level, turn, call_id); null on cycles and without a
    call. The join sides hold one row per identifier, so a hot conversation is spread by its identifiers.
    JSON keys are sorted, there is no white space, and whole numbers have no fraction; other numbers are as Spark's variant
    type writes them. Empty tables give no rows; texts of any length are taken whole; other columns are left out.
    """
    one_call = (
        calls.filter("call_id IS NOT NULL")
        .groupBy("conv_id", "call_id")
        .agg(F.min(F.struct("turn", "name", "arguments", "after_id")).alias("call"), F.count("*").alias("n_calls"))
        .select("conv_id", "call_id", "call.*", "n_calls")
    )
    one_call = cut(one_call)
    one_result = (
        results.filter("call_id IS NOT NULL")
        .groupBy(F.col("conv_id").alias("rc"), F.col("call_id").alias("ri"))
        .agg(F.min(F.struct("turn", "content")).alias("result"), F.count("*").alias("n_results"))
    )
    level = levels(one_call).select(F.col("conv_id").alias("lc"), F.col("call_id").alias("li"), "level")
    ordered = one_call.join(level, one_call["conv_id"].eqNullSafe(level["lc"]) & (one_call["call_id"] == level["li"]), "left")
    both = ordered.join(one_result, ordered["conv_id"].eqNullSafe(one_result["rc"]) & (ordered["call_id"] == one_result["ri"]), "full_outer")
    linked = both.select(
        F.when(F.col("n_calls").isNull(), F.col("rc")).otherwise(F.col("conv_id")).alias("conv_id"),
        F.coalesce("call_id", "ri").alias("call_id"),
        "turn", "name", "arguments", "level",
        F.col("result.turn").alias("result_turn"),
        F.col("result.content").alias("content"),
        F.coalesce("n_calls", F.lit(0)).cast("long").alias("n_calls"),
        F.coalesce("n_results", F.lit(0)).cast("long").alias("n_results"),
    )
    none = lambda kind: F.lit(None).cast(kind)
    loose_calls = calls.filter("call_id IS NULL").select(
        "conv_id", "call_id", "turn", "name", "arguments", none("long").alias("level"), none("long").alias("result_turn"), none("string").alias("content"),
        F.lit(1).cast("long").alias("n_calls"), F.lit(0).cast("long").alias("n_results"),
    )
    loose_results = results.filter("call_id IS NULL").select(
        "conv_id", "call_id", none("long").alias("turn"), none("string").alias("name"), none("string").alias("arguments"), none("long").alias("level"),
        F.col("turn").alias("result_turn"), "content", F.lit(0).cast("long").alias("n_calls"), F.lit(1).cast("long").alias("n_results"),
    )
    rows = linked.unionByName(loose_calls).unionByName(loose_results)
    called = F.col("n_calls") > 0
    wrong = F.when(called, problems(F.col("name"), F.col("arguments"), schemas)).otherwise(F.array().cast("array<string>"))
    status = (
        F.when(F.col("call_id").isNull(), "no id").when(~called, "no call").when(F.col("level").isNull(), "cycle")
        .when(F.size("problems") > 0, "invalid").when(F.col("n_results") == 0, "no result").otherwise("ok")
    )
    args = F.coalesce(canonical_json(F.col("arguments")), F.lit("null"))
    number = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("null"))
    text = F.concat(
        F.lit('{"arguments":'), args, F.lit(',"call_id":'), json_string(F.col("call_id")), F.lit(',"name":'), json_string(F.col("name")),
        F.lit(',"result":'), json_string(F.col("content")), F.lit(',"result_turn":'), number("result_turn"), F.lit(',"turn":'), number("turn"), F.lit("}"),
    )
    return rows.withColumn("problems", wrong).withColumns({"status": status, "json": text})


def conversation_calls(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results in plain conversations, which hold no tool calls, so two made-up tools stand for them: a user or system turn calls ``ask`` or ``instruct``, an assistant turn
    is the result of the turn before; a user turn builds on the user turn before, or on the system turn."""
    ident = lambda turn: F.concat_ws("-", F.lit("call"), F.col("conv_id"), turn)
    named = conversations.withColumn("call_id", F.when(F.col("conv_id").isNotNull() & F.col("turn").isNotNull(), ident(F.col("turn"))))
    is_call = F.col("role").isin("user", "system")
    ask = F.to_json(F.struct(word_count(F.col("text")).alias("words"), F.col("turn"), F.col("text").alias("prompt")))
    rules = F.to_json(F.struct(F.col("turn"), F.col("text").alias("rules")))
    calls = named.filter(is_call).select(
        "conv_id", "call_id", F.when(F.col("turn") > 0, ident(F.greatest(F.col("turn") - 2, F.lit(0)))).alias("after_id"), "turn",
        F.when(F.col("role") == "user", "ask").otherwise("instruct").alias("name"), F.when(F.col("role") == "user", ask).otherwise(rules).alias("arguments"),
    )
    results = named.filter(~is_call | F.col("role").isNull()).select(
        "conv_id", F.when(F.col("call_id").isNotNull(), ident(F.col("turn") - 1)).alias("call_id"), "turn", F.col("text").alias("content")
    )
    return calls, results


def op3_tool_calls(spark, sf_dir: str) -> DataFrame:
    """All conversations as linked calls, one row per identifier."""
    linked = link_calls(*conversation_calls(table(spark, sf_dir, "conversations")))
    return linked.select("conv_id", "call_id", "turn", "level", "status", F.array_join("problems", "; ").alias("problems"), "n_calls", "n_results", "json")


OP3_SQL = r"""
WITH RECURSIVE m AS (
  SELECT *, 'call-' || conv_id || '-' || turn AS id FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
c0 AS (
  SELECT conv_id, id AS call_id, turn, CASE WHEN turn > 0 THEN 'call-' || conv_id || '-' || greatest(turn - 2, 0) END AS after_id,
    CASE WHEN role = 'user' THEN 'ask' ELSE 'instruct' END AS name, text,
    len(regexp_extract_all(text, '[^\x20\x09-\x0D]+'))::BIGINT AS words FROM m WHERE role IN ('user', 'system')),
c AS (SELECT conv_id, call_id, turn, name, text, words, after_id, count(*) OVER (PARTITION BY conv_id, call_id) AS n_calls FROM c0
  QUALIFY row_number() OVER (PARTITION BY conv_id, call_id ORDER BY turn, name, text) = 1),
r AS (SELECT conv_id, 'call-' || conv_id || '-' || (turn - 1) AS call_id, turn AS result_turn, text AS content,
    count(*) OVER (PARTITION BY conv_id, turn) AS n_results FROM m WHERE role IS NULL OR role NOT IN ('user', 'system')
  QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY text) = 1),
lv AS (
  SELECT conv_id, call_id, 0 AS level FROM c WHERE after_id IS NULL OR after_id NOT IN (SELECT call_id FROM c)
  UNION ALL SELECT c.conv_id, c.call_id, lv.level + 1 FROM c JOIN lv ON c.conv_id = lv.conv_id AND c.after_id = lv.call_id),
l AS (SELECT coalesce(c.conv_id, r.conv_id) AS conv_id, coalesce(c.call_id, r.call_id) AS call_id, c.turn, lv.level, name, text, words, content, result_turn,
    coalesce(n_calls, 0) AS n_calls, coalesce(n_results, 0) AS n_results
  FROM c LEFT JOIN lv ON c.conv_id = lv.conv_id AND c.call_id = lv.call_id FULL JOIN r ON c.conv_id = r.conv_id AND c.call_id = r.call_id),
p AS (SELECT *, CASE name
    WHEN 'ask' THEN concat_ws('; ', CASE WHEN length(text) > 4000 THEN 'max_length of prompt' END, CASE WHEN length(text) < 1 THEN 'min_length of prompt' END,
      CASE WHEN words < 3 THEN 'minimum of words' END, CASE WHEN text IS NULL THEN 'missing prompt' END)
    WHEN 'instruct' THEN concat_ws('; ', CASE WHEN turn > 0 THEN 'maximum of turn' END, CASE WHEN length(text) < 1 THEN 'min_length of rules' END, CASE WHEN text IS NULL THEN 'missing rules' END)
    ELSE '' END AS problems FROM l)
SELECT conv_id, call_id, turn, level::BIGINT AS level,
  CASE WHEN n_calls = 0 THEN 'no call' WHEN level IS NULL THEN 'cycle' WHEN problems <> '' THEN 'invalid' WHEN n_results = 0 THEN 'no result' ELSE 'ok' END AS status,
  problems, n_calls::BIGINT AS n_calls, n_results::BIGINT AS n_results,
  '{"arguments":' || CASE name WHEN 'ask' THEN '{"prompt":' || to_json(text) || ',"turn":' || turn || ',"words":' || words || '}'
    WHEN 'instruct' THEN '{"rules":' || to_json(text) || ',"turn":' || turn || '}' ELSE 'null' END
  || ',"call_id":' || to_json(call_id) || ',"name":' || coalesce(to_json(name), 'null') || ',"result":' || coalesce(to_json(content), 'null')
  || ',"result_turn":' || coalesce(result_turn::VARCHAR, 'null') || ',"turn":' || coalesce(turn::VARCHAR, 'null') || '}' AS json
FROM p
"""
