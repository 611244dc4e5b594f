"""Tool-call linking for chat formatting, with DataFrame functions only.

Calls and results meet in a hash join on their identifier, calls that refer to
other calls follow them (topological order), arguments are checked against
schemas, and every event becomes one line of canonical JSON: no blanks, keys in
sorted order.
"""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, global_rank, table

#: A reference to another call inside arguments: {"$call": "<identifier>"}.
REFERENCE = r'"\$call"\s*:\s*"([^"]+)"'
#: JSON schema types by the head of a variant's type name.
TYPES = {"string": "STRING", "integer": "BIGINT", "number": "(BIGINT|DECIMAL|DOUBLE|FLOAT)", "boolean": "BOOLEAN", "array": "ARRAY", "object": "OBJECT"}


def validate_arguments(calls: DataFrame, schemas: DataFrame) -> DataFrame:
    """Append valid boolean to calls(name, arguments, ...).

    schemas has a row (name, argument, type, required) for each argument of a
    tool.  A call is valid if its arguments are a JSON object, its tool has a
    schema, every required argument is there, none is unknown, and each that is
    there has its type (null has none).  The join is on the tool's name; one row
    per tool holds its whole schema, which is small by its nature.
    """
    shape = schemas.where("name is not null and argument is not null").groupBy(F.col("name").alias("__tool")).agg(F.map_from_entries(F.collect_set(F.struct("argument", "type"))).alias("__types"), F.collect_set(F.when(F.col("required"), F.col("argument"))).alias("__needed"))
    given = F.from_json("arguments", "map<string,variant>")
    joined = calls.withColumn("__given", F.when(F.col("arguments").rlike(r"^\s*\{"), given)).join(shape, F.col("name") == F.col("__tool"), "left")
    kind = F.create_map(*[F.lit(x) for pair in TYPES.items() for x in pair])

    def fits(name, value):
        want = F.element_at(F.col("__types"), name)
        return F.coalesce(F.rlike(F.schema_of_variant(value), F.concat(F.lit("^"), F.element_at(kind, want))), F.lit(False))

    valid = F.size(F.array_except("__needed", F.map_keys("__given"))) == 0
    valid = valid & (F.size(F.map_filter("__given", lambda k, v: ~fits(k, v))) == 0)
    return joined.withColumn("valid", F.coalesce(valid & F.col("__tool").isNotNull() & F.col("__given").isNotNull(), F.lit(False))).drop("__given", "__tool", "__types", "__needed")


def _key(call_id):
    return F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit("")), F.lit("\0"), call_id)


def call_levels(calls: DataFrame) -> DataFrame:
    """(key, level) of calls(conv_id, call_id, arguments): 0 without references, else one more than the largest level referred to.

    References are to calls of the same conversation.  Each round places the
    calls whose references all are placed; the rounds are those of the longest
    chain of references.  References to calls that do not exist are ignored;
    calls on a cycle, or that refer to one, get the null level.  Runs actions.
    """
    own = calls.where("call_id is not null").withColumn("key", _key(F.col("call_id")))
    ids = own.select("key").distinct()
    links = own.select("key", "conv_id", F.explode(F.regexp_extract_all("arguments", F.lit(REFERENCE), F.lit(1))).alias("other")).select("key", _key(F.col("other")).alias("needs")).distinct()
    waiting = durable(links.join(ids.select(F.col("key").alias("needs")), "needs", "left_semi"))
    placed = ids.join(waiting.select("key").distinct(), "key", "left_anti").withColumn("level", F.lit(0))
    if waiting.isEmpty():
        return placed
    placed = durable(placed)
    for level in count(1):
        blocked = waiting.join(placed.select(F.col("key").alias("needs")), "needs", "left_anti").select("key").distinct()
        ready = waiting.select("key").distinct().join(blocked, "key", "left_anti").join(placed, "key", "left_anti").withColumn("level", F.lit(level))
        ready = durable(ready)
        if ready.isEmpty():
            break
        placed = durable(placed.union(ready))
    return ids.join(placed, "key", "left")


def link_tool_calls(messages: DataFrame, calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """One row per message, call and result, in topological order within its conversation.

    messages(conv_id, turn, role, text), calls(conv_id, turn, call_id, name,
    arguments), results(conv_id, turn, call_id, content).  Returns conv_id, turn,
    kind, call_id, linked (a call with a result, a result with a call), valid (of
    calls), seq (gapless from 0 in the conversation) and line (canonical JSON;
    arguments are a JSON value if they parse, else a string).  A result follows
    its call even if its turn comes first; a call follows those that it refers
    to within its turn.  Results without a call, calls without a result or
    identifier, null texts, repeated rows (each gets its own seq, repeated
    results link to the call once each) and null conversations (one group) all
    keep their rows; nothing links in the null conversation; empty tables give no rows.  The rank is taken by range
    partitions, so one conversation may hold a third of all rows.
    """
    known = calls.where("call_id is not null").groupBy("conv_id", "call_id").agg(F.min("turn").alias("call_turn"))
    answered = results.where("call_id is not null").select("conv_id", "call_id").distinct().withColumn("__answered", F.lit(True))
    checked = validate_arguments(calls, schemas).join(answered, ["conv_id", "call_id"], "left")
    levels = call_levels(calls)
    checked = checked.withColumn("key", _key(F.col("call_id")))
    text_json = lambda c: F.regexp_extract(F.to_json(F.struct(F.coalesce(F.col(c), F.lit("")).alias("x"))), r"(?s)^\{\"x\":(.*)\}$", 1)
    arguments = F.coalesce(F.to_json(F.try_parse_json("arguments")), text_json("arguments"))
    call = checked.join(levels, "key", "left").select("conv_id", "turn", F.lit("call").alias("kind"), "call_id", F.coalesce("__answered", F.lit(False)).alias("linked"), "valid", F.col("turn").alias("anchor"), F.coalesce("level", F.lit(2147483646)).alias("level"), F.concat(F.lit('{"arguments":'), arguments, F.lit(',"id":'), text_json("call_id"), F.lit(',"name":'), text_json("name"), F.lit(',"type":"call"}')).alias("line"))
    result = results.join(known, ["conv_id", "call_id"], "left").select("conv_id", "turn", F.lit("result").alias("kind"), "call_id", F.col("call_turn").isNotNull().alias("linked"), F.lit(None).cast("boolean").alias("valid"), F.greatest("turn", "call_turn").alias("anchor"), F.lit(2147483647).alias("level"), F.concat(F.lit('{"content":'), text_json("content"), F.lit(',"id":'), text_json("call_id"), F.lit(',"type":"result"}')).alias("line"))
    plain = messages.select("conv_id", "turn", F.lit("message").alias("kind"), F.lit(None).cast("string").alias("call_id"), F.lit(False).alias("linked"), F.lit(None).cast("boolean").alias("valid"), F.col("turn").alias("anchor"), F.lit(-1).alias("level"), F.concat(F.lit('{"content":'), text_json("text"), F.lit(',"role":'), text_json("role"), F.lit(',"type":"message"}')).alias("line"))
    events = reduce(DataFrame.unionByName, [plain, call, result])
    ranked, total = global_rank(events, ["conv_id", "anchor", "level", "turn", "call_id", "line"], "__rank")
    starts = ranked.groupBy(F.col("conv_id").alias("__conv")).agg(F.min("__rank").alias("__first"))
    return ranked.join(starts, F.col("conv_id").eqNullSafe(F.col("__conv"))).select("conv_id", "turn", "kind", "call_id", "linked", "valid", (F.col("__rank") - F.col("__first")).alias("seq"), "line")


def conversation_events(conversations: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Messages, calls and results of a table of plain turns.

    A user's turn calls the tool ``answer`` with its text, under the identifier
    conversation-turn; an assistant's turn is the result of the turn before it;
    every other turn is a message.
    """
    rows = conversations.select("conv_id", "turn", "role", "text")
    calls = rows.where("role = 'user'").select("conv_id", "turn", F.concat_ws("-", "conv_id", "turn").alias("call_id"), F.lit("answer").alias("name"), F.to_json(F.struct("text")).alias("arguments"))
    results = rows.where("role = 'assistant'").select("conv_id", "turn", F.concat_ws("-", "conv_id", F.col("turn") - 1).alias("call_id"), F.col("text").alias("content"))
    return rows.where("role is null or role not in ('user', 'assistant')"), calls, results


def answer_schema(spark: SparkSession) -> DataFrame:
    return spark.range(1).select(F.lit("answer").alias("name"), F.lit("text").alias("argument"), F.lit("string").alias("type"), F.lit(True).alias("required"))


def op10_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: all conversations, a user's turn as a call and the answer as its result."""
    return link_tool_calls(*conversation_events(table(spark, sf_dir, "conversations")), answer_schema(spark))


OP10_SQL = r"""
WITH c AS (SELECT conv_id, turn, conv_id || '-' || turn AS call_id, text FROM conversations WHERE role = 'user'),
r AS (SELECT conv_id, turn, conv_id || '-' || (turn - 1) AS call_id, text FROM conversations WHERE role = 'assistant'),
e AS (
SELECT conv_id, turn, 'message' AS kind, NULL::VARCHAR AS call_id, FALSE AS linked, NULL::BOOLEAN AS valid, turn AS anchor, -1 AS level,
  '{"content":' || to_json(coalesce(text, ''))::VARCHAR || ',"role":' || to_json(coalesce(role, ''))::VARCHAR || ',"type":"message"}' AS line
  FROM conversations WHERE role IS NULL OR role NOT IN ('user', 'assistant')
UNION ALL
SELECT conv_id, turn, 'call', call_id, EXISTS (SELECT 1 FROM r WHERE r.call_id = c.call_id), text IS NOT NULL, turn, 0,
  '{"arguments":{' || coalesce('"text":' || to_json(text)::VARCHAR, '') || '},"id":' || to_json(call_id)::VARCHAR || ',"name":"answer","type":"call"}' FROM c
UNION ALL
SELECT r.conv_id, r.turn, 'result', r.call_id, k.t IS NOT NULL, NULL, greatest(r.turn, k.t), 2147483647,
  '{"content":' || to_json(coalesce(r.text, ''))::VARCHAR || ',"id":' || to_json(r.call_id)::VARCHAR || ',"type":"result"}'
  FROM r LEFT JOIN (SELECT call_id, min(turn) AS t FROM c GROUP BY call_id) k USING (call_id))
SELECT conv_id, turn, kind, call_id, linked, valid,
  row_number() OVER (PARTITION BY conv_id ORDER BY anchor, level, turn, call_id, line) - 1 AS seq, line FROM e
"""
