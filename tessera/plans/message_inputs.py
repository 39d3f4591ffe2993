"""Response items, chat messages, agent events and model responses derived from
``conversations`` (one per turn; the kind of a turn follows fixed rules on
role, turn and conversation id, stated next to each builder)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.jsonfmt import json_string
from ..sources.tables import load_table


def _conv(spark, sf_dir):
    return load_table(spark, sf_dir, "conversations")


def _ids():
    c, t = F.col("conv_id").cast("string"), F.col("turn").cast("string")
    return c, t


def _args_json():
    return F.concat(F.lit('{"q":'), json_string("text"), F.lit("}"))


def response_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user -> message with one input_text part; assistant turn%3=0 -> function_call;
    turn%3=1 -> function_call_output; turn%3=2 -> message with string content;
    system -> bare {role, content}."""
    c, t = _ids()
    call_id = F.concat(F.lit("call-"), c, F.lit("-"), t)
    r, k = F.col("role"), F.col("turn") % 3
    item = (F.when(r == "user", F.concat(F.lit('{"type":"message","role":"user","content":[{"type":"input_text","text":'),
                                         json_string("text"), F.lit("}]}")))
            .when((r == "assistant") & (k == 0),
                  F.concat(F.lit('{"type":"function_call","call_id":'), json_string(call_id),
                           F.lit(',"name":"lookup","arguments":'), json_string(_args_json()), F.lit("}")))
            .when((r == "assistant") & (k == 1),
                  F.concat(F.lit('{"type":"function_call_output","call_id":'), json_string(call_id),
                           F.lit(',"output":'), json_string("text"), F.lit("}")))
            .when(r == "assistant",
                  F.concat(F.lit('{"type":"message","role":"assistant","content":'), json_string("text"),
                           F.lit(',"id":"msg-'), c, F.lit("-"), t, F.lit('"}')))
            .otherwise(F.concat(F.lit('{"role":'), json_string("role"), F.lit(',"content":'),
                                json_string("text"), F.lit("}"))))
    return _conv(spark, sf_dir).select("conv_id", F.col("turn").alias("pos"), item.alias("item"))


def chat_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user turn%4=0 -> role human; other user and system turns keep their role;
    assistant turn%3=0 -> assistant with one tool call (content blank in odd
    conversations); turn%3=1 -> tool output answering the previous turn's call;
    turn%3=2 -> plain assistant."""
    c, t = _ids()
    r, k = F.col("role"), F.col("turn") % 3
    call = F.concat(F.lit('[{"id":"call-'), c, F.lit("-"), t,
                    F.lit('","type":"function","function":{"name":"lookup","arguments":'),
                    json_string(_args_json()), F.lit("}}]"))
    prev_call = F.concat(F.lit("call-"), c, F.lit("-"), (F.col("turn") - 1).cast("string"))
    mid = F.concat(F.lit(',"id":"msg-'), c, F.lit("-"), t, F.lit('"'))
    msg = (F.when((r == "user") & (F.col("turn") % 4 == 0),
                  F.concat(F.lit('{"role":"human","content":'), json_string("text"), F.lit("}")))
           .when((r == "assistant") & (k == 0),
                 F.concat(F.lit('{"role":"assistant","content":'),
                          F.when(F.col("conv_id") % 2 == 0, json_string("text")).otherwise(F.lit('""')),
                          mid, F.lit(',"tool_calls":'), call, F.lit("}")))
           .when((r == "assistant") & (k == 1),
                 F.concat(F.lit('{"role":"tool","content":'), json_string("text"),
                          F.lit(',"tool_call_id":'), json_string(prev_call), F.lit("}")))
           .when(r == "assistant",
                 F.concat(F.lit('{"role":"assistant","content":'), json_string("text"), mid, F.lit("}")))
           .otherwise(F.concat(F.lit('{"role":'), json_string("role"), F.lit(',"content":'),
                               json_string("text"), F.lit("}"))))
    return _conv(spark, sf_dir).select("conv_id", F.col("turn").alias("pos"), msg.alias("message"))


def _tokens(df: DataFrame) -> DataFrame:
    """Split text on single spaces, keeping the space on every token but the last."""
    # counted before the rows multiply
    return (df.withColumn("_n", F.size(F.split("text", " "))).select("*", F.posexplode(F.split("text", " ")).alias("idx", "tok"))
            .withColumn("idx", F.col("idx").cast("bigint"))
            .withColumn("tok", F.when(F.col("idx") < F.col("_n") - 1, F.concat("tok", F.lit(" "))).otherwise(F.col("tok")))
            .drop("_n"))


def agent_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user -> one update from the structured agent; assistant turn%3=0 -> token
    chunks with a tool call then an update, from the retrieval agent; other
    assistant turns -> token chunks then an update, from the answer node."""
    conv = _conv(spark, sf_dir).select("conv_id", "turn", "role", "text")
    node = F.when(F.col("role") != "assistant", "structured_agent") \
        .when(F.col("turn") % 3 == 0, "unstructured_agent").otherwise("response_agent")
    calls = F.when(F.col("turn") % 3 == 0, F.concat(F.lit('[{"id":"call-'), F.col("conv_id").cast("string"),
                                                     F.lit("-"), F.col("turn").cast("string"), F.lit('"}]')))
    upd = conv.select("conv_id", "turn", F.lit(1).cast("bigint").alias("phase"),
                      F.lit(0).cast("bigint").alias("idx"),
                      F.lit("updates").alias("mode"), node.alias("node"), "role",
                      F.col("text").alias("content"), F.lit(None).cast("string").alias("tool_calls"))
    chunks = _tokens(conv.filter(F.col("role") == "assistant")).select(
        "conv_id", "turn", F.lit(0).cast("bigint").alias("phase"), "idx", F.lit("messages").alias("mode"),
        node.alias("node"), "role", F.col("tok").alias("content"), calls.alias("tool_calls"))
    return upd.unionByName(chunks)


def stream_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Non-assistant turns -> one done item; assistant turns -> one text delta per
    token (item ids vary per delta) with an unrelated heartbeat event after the
    first delta. Ordered by (turn, sub)."""
    conv = _conv(spark, sf_dir).select("conv_id", "turn", "role", "text")
    c, t = _ids()
    done = conv.filter(F.col("role") != "assistant").select(
        F.col("conv_id").alias("request_id"), "turn", F.lit(0).alias("sub"),
        F.lit("response.output_item.done").alias("type"),
        F.concat(F.lit("item-"), c, F.lit("-"), t).alias("item_id"),
        F.lit(None).cast("string").alias("delta"), "text")
    toks = _tokens(conv.filter(F.col("role") == "assistant"))
    deltas = toks.select(
        F.col("conv_id").alias("request_id"), "turn", (F.col("idx") * 2 + 1).alias("sub"),
        F.lit("response.output_text.delta").alias("type"),
        F.concat(F.lit("item-"), c, F.lit("-"), t, F.lit("-"), F.col("idx").cast("string")).alias("item_id"),
        F.col("tok").alias("delta"), F.lit(None).cast("string").alias("text"))
    beats = conv.filter(F.col("role") == "assistant").select(
        F.col("conv_id").alias("request_id"), "turn", F.lit(2).alias("sub"),
        F.lit("response.heartbeat").alias("type"), F.lit(None).cast("string").alias("item_id"),
        F.lit(None).cast("string").alias("delta"), F.lit(None).cast("string").alias("text"))
    return done.unionByName(deltas).unionByName(beats)


def model_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistant turns wrapped as a model response by ``conv_id % 5``: 0 choices
    form, 1 content form, 2 bare JSON string, 3 another object, 4 no response."""
    k = F.col("conv_id") % 5
    r = (F.when(k == 0, F.concat(F.lit('{"choices":[{"message":{"content":'), json_string("text"), F.lit("}}]}")))
         .when(k == 1, F.concat(F.lit('{"content":'), json_string("text"), F.lit("}")))
         .when(k == 2, json_string("text"))
         .when(k == 3, F.concat(F.lit('{"output":'), json_string("text"), F.lit("}"))))
    return (_conv(spark, sf_dir).filter(F.col("role") == "assistant")
            .select("conv_id", "turn", r.alias("response")))
