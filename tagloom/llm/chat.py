"""Tool calls of chats: linked to their results, ordered, validated and written as canonical JSON.

Everything is DataFrame expressions.  Results are reduced to one per identifier before the join, so the
join is many-to-one and an identifier that a third of all rows carry cannot multiply.

Order: a call's level is 0 without predecessors, else one more than the highest level among them;
``(level, position)`` is a topological order of each chat.  Chains of calls with one predecessor are shortened by
pointer doubling; the calls with several are then placed from the front: a round places those whose
predecessors are all placed, and only looks at the links that leave the calls placed in the round before.
So a chain of n calls takes log2(n) rounds, and the work is linear in the links.  Calls on a cycle, or
behind one, have a null level.

Arguments are JSON objects; `SCHEMA` tables say which fields a tool has.  Canonical JSON has its keys sorted
at every depth and no blanks, and leaves out what is null in the envelope.

Status of a row: ``ok``; ``no_id`` (null identifier, never linked); ``repeated`` (not the first call of its
identifier: it is listed, and takes no result); ``unknown_tool``; ``bad_json`` (null, not JSON or no
object); ``invalid`` (see ``errors``); ``cycle``; ``no_result``; ``orphan`` (a result without a call).  Of several
results for one identifier the first by position counts, ties to the smaller text.  Empty tables give no
rows.  Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.llm.staging import new_folder, staged

#: columns of a schema table: tool, field, type (string, integer, number, boolean, array, object), required,
#: low and high (of a number, or of a string's length; null for no bound)
SCHEMA = "tool string, field string, type string, required boolean, low double, high double"


def chained(calls: DataFrame, links: DataFrame) -> DataFrame:
    """``call_id, anchor, steps``: follow single predecessors back to a call that has none or several.

    Pointers double in every round, so a chain of n calls takes log2(n) rounds.  Calls that a cycle of
    single predecessors holds have a null anchor.
    """
    before = links.groupBy("call_id").agg(F.count("*").alias("n"), F.min("after").alias("after"))
    single = F.coalesce(F.col("n") == 1, F.lit(False))
    now = staged(calls.select("call_id").join(before, "call_id", "left").select(
        "call_id", F.when(single, F.col("after")).otherwise(F.col("call_id")).alias("anchor"),
        single.cast("int").alias("steps"), (~single).alias("done")))
    rounds = now.count().bit_length() + 1
    while rounds and not now.where("not done").isEmpty():
        ahead = now.select(F.col("call_id").alias("anchor"), F.col("anchor").alias("next"), F.col("steps").alias("more"), F.col("done").alias("ends"))
        now = staged(now.join(ahead, "anchor").select("call_id", F.col("next").alias("anchor"), (F.col("steps") + F.col("more")).alias("steps"),
                                                     (F.col("done") | F.col("ends")).alias("done")))
        rounds -= 1
    return now.select("call_id", F.when(F.col("done"), F.col("anchor")).alias("anchor"), "steps")


def levels(calls: DataFrame, links: DataFrame) -> DataFrame:
    """``call_id, level`` for calls (``call_id``, unique) under ``links`` (``call_id, after``).

    A predecessor that is no call is ignored.  Calls that get no level are left out.
    """
    spark = calls.sparkSession
    links = staged(links.where("call_id is not null").join(calls.select(F.col("call_id").alias("after")), "after", "left_semi")
                   .join(calls.select("call_id"), "call_id", "left_semi").select("call_id", "after").distinct())
    chain = chained(calls, links)
    several = links.groupBy("call_id").agg(F.count("*").alias("open")).where("open > 1")
    # between calls with several predecessors: from the anchor of each predecessor, over its steps and one
    jumps = staged(links.join(several, "call_id", "left_semi")
                   .join(chain.select(F.col("call_id").alias("after"), "anchor", "steps"), "after", "left")
                   .select("call_id", "anchor", (F.col("steps") + 1).alias("steps")))
    waiting = staged(several.select("call_id", "open", F.lit(0).alias("best")))
    folder, turn = new_folder(spark), 0
    first = calls.select("call_id").join(links.select("call_id"), "call_id", "left_anti").withColumn("level", F.lit(0))
    schema = first.schema
    first.write.parquet(f"{folder}/round=0")
    front = spark.read.schema(schema).parquet(f"{folder}/round=0")
    while not waiting.isEmpty() and not front.isEmpty():
        turn += 1
        closed = (jumps.join(front.select(F.col("call_id").alias("anchor"), "level"), "anchor")
                  .groupBy("call_id").agg(F.count("*").alias("closed"), F.max(F.col("level") + F.col("steps")).alias("reach")))
        left = staged(waiting.join(closed, "call_id", "left").select(
            "call_id", (F.col("open") - F.coalesce("closed", F.lit(0))).alias("open"), F.greatest("best", "reach").alias("best")))
        left.where("open = 0").select("call_id", F.col("best").alias("level")).write.parquet(f"{folder}/round={turn}")
        front = spark.read.schema(schema).parquet(f"{folder}/round={turn}")
        waiting = left.where("open > 0")
    placed = spark.read.schema(schema).parquet(*[f"{folder}/round={k}" for k in range(turn + 1)])
    return chain.join(placed.withColumnRenamed("call_id", "anchor"), "anchor").select("call_id", (F.col("level") + F.col("steps")).alias("level"))


def json_type(value: Column) -> Column:
    """JSON type of a variant value."""
    kind = F.schema_of_variant(value)
    return (F.when(kind == "BIGINT", "integer").when(kind.rlike("^(DECIMAL|DOUBLE|FLOAT)"), "number").when(kind == "STRING", "string")
            .when(kind == "BOOLEAN", "boolean").when(kind.startswith("ARRAY"), "array").when(kind.startswith("OBJECT"), "object")
            .otherwise("null"))


def violations(fields: Column, values: Column) -> Column:
    """Sorted list of what a call's argument map breaks: missing, type, range, unknown, each with the field."""
    def one(f: Column) -> Column:
        v = F.element_at(values, f["field"])
        kind = json_type(v)
        fits = (kind == f["type"]) | ((kind == "integer") & (f["type"] == "number"))
        size = F.when(kind == "string", F.length(F.try_variant_get(v, "$", "string")).cast("double")).otherwise(
            F.try_variant_get(v, "$", "double"))
        outside = F.coalesce(size < f["low"], F.lit(False)) | F.coalesce(size > f["high"], F.lit(False))
        return (F.when(~F.map_contains_key(values, f["field"]) | (kind == "null"),
                       F.when(f["required"], F.concat(F.lit("missing:"), f["field"])))
                .when(~fits, F.concat(F.lit("type:"), f["field"])).when(outside, F.concat(F.lit("range:"), f["field"])))

    known = F.transform(fields, lambda f: f["field"])
    extra = F.transform(F.array_except(F.map_keys(values), known), lambda k: F.concat(F.lit("unknown:"), k))
    return F.array_sort(F.array_compact(F.concat(F.transform(fields, one), extra)))


def canonical(text: Column) -> Column:
    """A JSON text with sorted keys and no blanks; null where it is no JSON."""
    return F.to_json(F.try_parse_json(text))


def linked(calls: DataFrame, results: DataFrame, links: DataFrame, schemas: DataFrame) -> DataFrame:
    """One row per call and per orphan result.

    ``calls``: chat_id, call_id, position, tool, arguments (JSON text).  ``results``: chat_id, call_id, position,
    content.  ``links``: call_id, after.  ``schemas``: see `SCHEMA`.
    Returns chat_id, call_id, level, position, tool, status, errors, message.
    """
    calls = calls.select("chat_id", "call_id", "position", "tool", "arguments")
    order = F.struct("position", F.coalesce("tool", F.lit("")), F.coalesce("arguments", F.lit("")))
    owners = calls.where("call_id is not null").groupBy("call_id").agg(F.min(order).alias("first"), F.count("*").alias("times"))
    answers = (results.where("call_id is not null").groupBy("call_id")
               .agg(F.min(F.struct("position", "content")).alias("answer"), F.min("chat_id").alias("answer_chat")))
    facts = staged(owners.join(answers, "call_id", "full"))
    placed = levels(facts.where("first is not null").select("call_id"), links)
    ranked = facts.join(placed, "call_id", "left")
    tools = schemas.groupBy("tool").agg(F.collect_list(F.struct("field", "type", "required", "low", "high")).alias("fields"))
    is_first = F.col("first") == order
    rows = calls.join(ranked.where("first is not null"), "call_id", "left").join(tools, "tool", "left")
    body, parsed = canonical(F.col("arguments")), F.from_json("arguments", "map<string,variant>")
    is_object = F.coalesce(F.schema_of_variant(F.try_parse_json("arguments")).startswith("OBJECT"), F.lit(False))
    errors = F.when(F.col("fields").isNotNull() & is_object, F.array_join(violations(F.col("fields"), parsed), ",")).otherwise("")
    content = F.when(is_first, F.col("answer.content"))
    status = (F.when(F.col("call_id").isNull(), "no_id").when(~is_first, "repeated").when(F.col("fields").isNull(), "unknown_tool")
              .when(~is_object, "bad_json").when(F.col("errors") != "", "invalid").when(F.col("level").isNull(), "cycle")
              .when(F.col("answer").isNull(), "no_result").otherwise("ok"))
    rest = F.to_json(F.struct(F.col("call_id").alias("id"), F.col("tool").alias("name"), content.alias("result")))
    message = F.concat(F.lit('{"arguments":'), F.coalesce(body, F.lit("null")),
                       F.when(rest == "{}", "}").otherwise(F.concat(F.lit(","), F.substring(rest, 2, 2147483647))))
    known = rows.withColumn("errors", errors).select(
        "chat_id", "call_id", "level", "position", "tool", status.alias("status"), "errors", message.alias("message"))
    orphan = ranked.where("first is null").select(
        F.col("answer_chat").alias("chat_id"), "call_id", F.lit(None).cast("int").alias("level"), F.col("answer.position").alias("position"),
        F.lit(None).cast("string").alias("tool"), F.lit("orphan").alias("status"), F.lit("").alias("errors"),
        F.to_json(F.struct(F.col("call_id").alias("id"), F.col("answer.content").alias("result"))).alias("message"))
    return known.union(orphan)
