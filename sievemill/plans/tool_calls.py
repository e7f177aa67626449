"""Registered queries on translated tool calls, tool results, errors and usage of whole conversations, with reference SQL.

Each turn's text is what a tool is asked, what it answers, or an error's message; what stands where after the translation
follows from the turn."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from sievemill.functions import dialects
from sievemill.plans.catalog import query
from sievemill.sources.tables import texts
from sievemill.streaming import chunks


def _json(**fields):
    return F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()]))


def _turns(spark, sf_dir):
    said = F.coalesce("text", F.lit(""))
    return texts(spark, sf_dir, "conversations").select("conv_id", "turn", said.alias("said"), F.concat(F.lit("call_"), F.col("conv_id").cast("string"), F.lit("_"), F.col("turn").cast("string")).alias("call"))


def _call(arguments):
    return F.struct(F.col("call").alias("id"), F.lit("function").alias("type"), F.struct(F.lit("look_up").alias("name"), arguments.alias("arguments")).alias("function"))


def _arguments() -> Column:
    """By turn: an object, a number, broken JSON."""
    return F.when(F.col("turn") % 3 == 0, _json(q=F.col("said"), turn=F.col("turn"))).when(F.col("turn") % 3 == 1, F.col("turn").cast("string")).otherwise("{broken")


@query(
    """SELECT conv_id, turn, 'tool_use' AS kind, concat('call_', conv_id, '_', turn) AS call, 'look_up' AS name, md5(CASE WHEN turn % 3 = 0 THEN coalesce(text, '') END) AS asked_md5,
  CASE WHEN turn % 3 = 1 THEN turn::VARCHAR END AS raw, concat('call_', conv_id, '_', turn) AS answered, md5(coalesce(text, '')) AS answer_md5, 'string' AS parameter, 300::BIGINT AS max_tokens FROM conversations"""
)
def tool_requests(spark, sf_dir):
    """Requests with tools, a call and its result, from choices to blocks."""
    messages = F.array(
        _json(role=F.lit("user"), content=F.lit("ask"), tool_calls=F.lit(None).cast("array<string>")),
        _json(role=F.lit("assistant"), content=F.lit(""), tool_calls=F.array(_call(_arguments()))),
        _json(role=F.lit("tool"), tool_call_id=F.col("call"), content=F.col("said")),
    )
    tool = F.lit('{"type": "function", "function": {"name": "look_up", "description": "d", "parameters": {"type": "object", "properties": {"q": {"type": "string"}}}}}')
    body = F.concat(F.lit('{"model": "m", "max_completion_tokens": 300, "messages": ['), F.array_join(messages, ","), F.lit('], "tools": ['), tool, F.lit("]}"))
    rows = _turns(spark, sf_dir).select("conv_id", "turn", dialects.to_blocks(body).alias("b"))
    at = lambda path: F.get_json_object("b", path)
    return rows.select(
        "conv_id", "turn", at("$.messages[1].content[0].type").alias("kind"), at("$.messages[1].content[0].id").alias("call"), at("$.messages[1].content[0].name").alias("name"),
        F.md5(at("$.messages[1].content[0].input.q")).alias("asked_md5"), at("$.messages[1].content[0].input.raw").alias("raw"), at("$.messages[2].content[0].tool_use_id").alias("answered"),
        F.md5(at("$.messages[2].content[0].content")).alias("answer_md5"), at("$.tools[0].input_schema.properties.q.type").alias("parameter"), at("$.max_tokens").cast("long").alias("max_tokens"),
    )


@query(
    """SELECT conv_id, turn, CASE WHEN turn % 4 = 3 THEN 'error' ELSE 'message' END AS type, CASE WHEN turn % 4 < 3 THEN CASE WHEN turn % 4 = 0 THEN 'tool_use' WHEN turn % 4 = 1 THEN 'max_tokens' ELSE 'end_turn' END END AS stop,
  CASE WHEN turn % 4 = 3 THEN md5(coalesce(text, '')) WHEN coalesce(text, '') <> '' THEN md5(text) END AS text_md5, CASE WHEN turn % 4 = 0 THEN concat('call_', conv_id, '_', turn) END AS call,
  CASE WHEN turn % 4 = 3 THEN CASE turn % 3 WHEN 0 THEN 'authentication_error' WHEN 1 THEN 'rate_limit_error' ELSE 'api_error' END END AS error,
  CASE WHEN turn % 4 < 3 THEN turn::BIGINT END AS asked, CASE WHEN turn % 4 < 3 THEN strlen(coalesce(text, ''))::BIGINT END AS told, CASE WHEN turn % 4 = 0 THEN 'tool_calls' WHEN turn % 4 = 1 THEN 'length' WHEN turn % 4 = 2 THEN 'stop' END AS finish,
  CASE WHEN turn % 4 < 3 THEN turn + strlen(coalesce(text, '')) END::BIGINT AS total, CASE WHEN turn % 4 = 3 THEN md5(coalesce(text, '')) END AS back_md5 FROM conversations"""
)
def tool_answers(spark, sf_dir):
    """Answers with calls, ends, errors and usage, from choices to blocks and back."""
    t = F.col("turn")
    finish = F.when(t % 4 == 0, "tool_calls").when(t % 4 == 1, "length").otherwise("stop")
    message = F.when(t % 4 == 0, _json(role=F.lit("assistant"), content=F.col("said"), tool_calls=F.array(_call(F.lit("{}"))))).otherwise(_json(role=F.lit("assistant"), content=F.col("said")))
    usage = _json(prompt_tokens=t, completion_tokens=F.octet_length("said"))
    good = F.concat(F.lit('{"id": "x", "choices": [{"finish_reason": "'), finish, F.lit('", "message": '), message, F.lit('}], "usage": '), usage, F.lit("}"))
    code = F.when(t % 3 == 0, "invalid_api_key").when(t % 3 == 1, "rate_limit_exceeded").otherwise("other")
    bad = F.to_json(F.struct(F.struct(F.col("said").alias("message"), code.alias("code"), F.lit("x").alias("type")).alias("error")))
    rows = _turns(spark, sf_dir).withColumn("b", dialects.answer_to_blocks(F.when(t % 4 == 3, bad).otherwise(good)))
    rows = rows.withColumn("c", dialects.answer_to_choices(F.col("b")))
    at, back = (lambda path: F.get_json_object("b", path)), (lambda path: F.get_json_object("c", path))
    n = F.when((t % 4 == 0) & (F.col("said") != ""), at("$.content[1].id")).when(t % 4 == 0, at("$.content[0].id"))
    return rows.select(
        "conv_id", "turn", at("$.type").alias("type"), at("$.stop_reason").alias("stop"), F.md5(F.coalesce(at("$.content[0].text"), at("$.error.message"))).alias("text_md5"), n.alias("call"), at("$.error.type").alias("error"),
        at("$.usage.input_tokens").cast("long").alias("asked"), at("$.usage.output_tokens").cast("long").alias("told"), back("$.choices[0].finish_reason").alias("finish"), back("$.usage.total_tokens").cast("long").alias("total"), F.md5(back("$.error.message")).alias("back_md5"),
    )


@query(
    """WITH t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, count(*) OVER (PARTITION BY conv_id) AS k FROM conversations),
e AS (SELECT conv_id, turn, unnest(list_concat(list_concat(CASE WHEN i = 1 THEN ['message_start', 'content_block_start'] ELSE [] END, CASE WHEN coalesce(text, '') <> '' THEN ['content_block_delta'] ELSE [] END), CASE WHEN i = k THEN ['content_block_stop', 'message_delta', 'message_stop'] ELSE [] END)) AS event FROM t)
SELECT conv_id, turn, event, count(*) AS n FROM e GROUP BY ALL"""
)
def chunk_rows(spark, sf_dir):
    """Events of each conversation, its turns being the chunks of one answer, in order."""
    rows = texts(spark, sf_dir, "conversations")
    last = F.max("turn").over(Window.partitionBy("conv_id"))
    choice = F.struct(F.struct(F.col("text").alias("content")).alias("delta"), F.when(F.col("turn") == last, "stop").alias("finish_reason"))
    body = rows.select("conv_id", "turn", F.to_json(F.struct(F.array(choice).alias("choices"))).alias("chunk"))
    out = chunks.chunk_rows(body, "conv_id", "turn")
    return out.groupBy(F.col("stream_id").alias("conv_id"), F.col("seq").alias("turn"), F.regexp_extract("event", r"\Aevent: (\w+)", 1).alias("event")).agg(F.count("*").alias("n"))
