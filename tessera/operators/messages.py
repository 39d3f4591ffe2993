"""Chat message translation, stream-event filtering and delta merging.

Response items and chat messages are JSON object texts; parsing uses Spark's
VARIANT functions, so the branches run as built-in expressions and
``posexplode`` generators (no Python per row).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from ..functions.ids import stable_id
from ..functions.jsonfmt import json_string
from ..functions.text import normalize_ws
from ..session import write_once
from .ordering import position_in_group, runs

TEXT_DELTA = "response.output_text.delta"
ITEM_DONE = "response.output_item.done"
END_OF_REQUEST = "response.completed"
# Fixed value: message content used for a tool-call turn.
TOOL_CALL_TEXT = "tool call"
# Fixed value: the chat app's fallback text when the model call fails.
FALLBACK_TEXT = ("I'm experiencing technical difficulties right now, but I'm here to help. "
                 "Could you please try again?")

# The fields of a chat message and the event types of a response stream.
CHAT_MESSAGE_FIELDS = ["role", "content", "name", "tool_calls", "tool_call_id"]


def _vs(path: str, v: str = "_v") -> F.Column:
    return F.expr(f"variant_get({v}, '{path}', 'string')")


def _vpresent(path: str, v: str = "_v") -> F.Column:
    return F.expr(f"variant_get({v}, '{path}') IS NOT NULL")


def to_chat_messages(items: DataFrame, key: str = "conv_id", pos: str = "pos",
                     item_col: str = "item") -> DataFrame:
    """Response items -> chat-completions messages, flattened in order.

    * ``function_call``: assistant, content 'tool call', one tool call
      ``{id, type: function, function: {arguments, name}}``;
    * ``message`` with list content: one message per part ``{role, content: text}``;
    * ``function_call_output``: role tool with the output and ``tool_call_id``;
    * anything else: the allow-listed keys only (content becomes 'tool call' when
      empty but tool calls exist); an item with none of them gives no row.

    Output ``(key, pos, sub, role, content, name, tool_calls, tool_call_id)``;
    ``tool_calls`` is JSON text.
    """
    v = items.select(F.col(key), F.col(pos), F.expr(f"try_parse_json({item_col})").alias("_v"))
    v = v.withColumn("_type", _vs("$.type")) \
         .withColumn("_ctype", F.expr("schema_of_variant(variant_get(_v, '$.content'))"))
    calls = F.to_json(F.array(F.struct(
        _vs("$.call_id").alias("id"), F.lit("function").alias("type"),
        F.struct(_vs("$.arguments").alias("arguments"), _vs("$.name").alias("name")).alias("function"))))
    msg = "struct<role:string,content:string,name:string,tool_calls:string,tool_call_id:string>"
    none = F.lit(None).cast("string")

    def one(role, content, name=none, tool_calls=none, tool_call_id=none):
        return F.array(F.struct(role.alias("role"), content.alias("content"), name.alias("name"),
                                tool_calls.alias("tool_calls"), tool_call_id.alias("tool_call_id")))

    parts = F.transform(F.expr("cast(variant_get(_v, '$.content') AS array<variant>)"),
                        lambda p: F.struct(_vs("$.role").alias("role"),
                                           F.variant_get(p, "$.text", "string").alias("content"),
                                           none.alias("name"), none.alias("tool_calls"),
                                           none.alias("tool_call_id")))
    has_calls = F.expr("variant_get(_v, '$.tool_calls') IS NOT NULL "
                       "AND NOT is_variant_null(variant_get(_v, '$.tool_calls')) "
                       "AND coalesce(array_size(cast(variant_get(_v, '$.tool_calls') AS array<variant>)) > 0, true)")
    content_empty = F.coalesce(_vs("$.content"), F.lit("")) == ""
    other_content = F.when(content_empty & has_calls, F.lit(TOOL_CALL_TEXT)).otherwise(_vs("$.content"))
    other = one(_vs("$.role"), other_content, _vs("$.name"),
                F.expr("to_json(variant_get(_v, '$.tool_calls'))"), _vs("$.tool_call_id"))
    any_key = (_vpresent("$.role") | _vpresent("$.content") | _vpresent("$.name")
               | _vpresent("$.tool_calls") | _vpresent("$.tool_call_id") | (content_empty & has_calls))
    rows = (F.when(F.col("_type") == "function_call", one(F.lit("assistant"), F.lit(TOOL_CALL_TEXT),
                                                        tool_calls=calls))
            .when((F.col("_type") == "message") & F.col("_ctype").startswith("ARRAY"), parts.cast(f"array<{msg}>"))
            .when(F.col("_type") == "function_call_output",
                  one(F.lit("tool"), _vs("$.output"), tool_call_id=_vs("$.call_id")))
            .when(any_key, other)
            .otherwise(F.array().cast(f"array<{msg}>")))
    return (v.select(key, pos, F.posexplode(rows).alias("sub", "_m"))
            .select(key, pos, F.col("sub").cast("bigint").alias("sub"), *[F.col(f"_m.{c}").alias(c)
                                                                           for c in CHAT_MESSAGE_FIELDS]))


ITEM_FIELDS = ["type", "item_id", "role", "text", "call_id", "name", "arguments", "output", "error"]


def to_response_items(msgs: DataFrame, key: str = "conv_id", pos: str = "pos",
                      msg_col: str = "message") -> DataFrame:
    """Chat messages -> response output items, flattened in order.

    * assistant with tool calls: a text item when the content is not blank, then
      one ``function_call`` item per call (arguments JSON-encoded once more);
    * assistant: one text item; tool: one ``function_call_output`` item;
    * human: the message unchanged (type null, role and text kept);
    * other roles: one row with ``error`` set (quarantine), not a job failure.

    Item ids come from the message ``id``; when absent a stable hash of
    (key, pos) stands in for the random id.
    """
    v = msgs.select(F.col(key), F.col(pos), F.expr(f"try_parse_json({msg_col})").alias("_v"))
    role = _vs("$.role")
    mid = F.coalesce(_vs("$.id"), F.concat(F.lit("msg_"), F.substring(stable_id(key, pos), 1, 24)))
    content = _vs("$.content")
    none = F.lit(None).cast("string")
    st = ("struct<type:string,item_id:string,role:string,text:string,call_id:string,name:string,"
          "arguments:string,output:string,error:string>")

    def item(type_=none, item_id=none, role_=none, text=none, call_id=none, name=none, arguments=none,
             output=none, error=none):
        return F.struct(type_.alias("type"), item_id.alias("item_id"), role_.alias("role"), text.alias("text"),
                        call_id.alias("call_id"), name.alias("name"), arguments.alias("arguments"),
                        output.alias("output"), error.alias("error"))

    text_item = item(F.lit("message"), mid, F.lit("assistant"), content)
    calls = F.expr("cast(variant_get(_v, '$.tool_calls') AS array<variant>)")
    call_items = F.transform(calls, lambda c: item(
        F.lit("function_call"), mid, none, none, F.variant_get(c, "$.id", "string"),
        F.variant_get(c, "$.function.name", "string"),
        json_string(F.variant_get(c, "$.function.arguments", "string"))))
    has_calls = F.coalesce(F.size(calls) > 0, F.lit(False))
    with_calls = F.concat(F.when(F.length(normalize_ws(F.coalesce(content, F.lit("")))) > 0, F.array(text_item))
                          .otherwise(F.array().cast(f"array<{st}>")), call_items)
    rows = (F.when((role == "assistant") & has_calls, with_calls)
            .when(role == "assistant", F.array(text_item))
            .when(role == "tool", F.array(item(F.lit("function_call_output"), none, none, none,
                                              _vs("$.tool_call_id"), output=content)))
            .when(role == "human", F.array(item(role_=role, text=content)))
            .otherwise(F.array(item(role_=role, error=F.concat(F.lit("unsupported role: "),
                                                               F.coalesce(role, F.lit("null")))))))
    return (v.select(key, pos, F.posexplode(rows).alias("item_pos", "_i"))
            .select(key, pos, F.col("item_pos").cast("bigint").alias("item_pos"),
                    *[F.col(f"_i.{c}").alias(c) for c in ITEM_FIELDS]))


def filter_stream_events(events: DataFrame, answer_node: str = "response_agent") -> DataFrame:
    """Keep node updates except the answer node's, and the answer node's text
    chunks that carry no tool call (``mode``, ``node``, ``role``, ``tool_calls``)."""
    no_calls = F.col("tool_calls").isNull() | (F.col("tool_calls") == "") | (F.col("tool_calls") == "[]")
    keep = (((F.col("mode") == "updates") & (F.col("node") != answer_node))
            | ((F.col("mode") == "messages") & (F.col("node") == answer_node)
               & (F.col("role") == "assistant") & no_calls))
    return events.filter(keep)


def _joined_deltas(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.RecordBatch]:
    """One row for each stretch of consecutive deltas of a request in a batch of sorted events, with the
    first one's columns, the texts concatenated and the latest time; other events stay as they are."""
    for batch in batches:
        if not batch.num_rows:
            continue
        delta = np.asarray(pc.equal(batch["type"], TEXT_DELTA))
        keys = np.asarray(batch[key].dictionary_encode(null_encoding="encode").indices)
        at = np.flatnonzero(np.r_[True, ~(delta[1:] & delta[:-1] & (keys[1:] == keys[:-1]))])
        out = {name: batch[name].take(pa.array(at)) for name in batch.schema.names if name not in ("_d", "_time")}
        lists = pa.ListArray.from_arrays(pa.array(np.append(at, batch.num_rows), pa.int32()), batch["_d"].fill_null(""))
        none = np.iinfo(np.int64).min
        latest = np.maximum.reduceat(np.asarray(batch["_time"].cast(pa.int64()).fill_null(none)), at)
        out |= {"_d": pc.binary_join(lists, ""), "_time": pa.array(latest, mask=latest == none).cast(batch.schema.field("_time").type)}
        yield pa.RecordBatch.from_arrays([out[name] for name in batch.schema.names], schema=batch.schema)


def _delta_runs(events: DataFrame, types: tuple[str, ...], key: str, order: list[str], time_col: str | None = None) -> DataFrame:
    """One row per run of consecutive deltas and per other event of ``types``: ``(key, run, type,
    item_id, text, time)``. Events are sorted over range partitions once, where consecutive deltas are
    joined to pieces; only the pieces, few to a run, are numbered. Keys and types go through the numbering, the
    texts meet their run numbers by row, so a request that holds most events is spread over all tasks."""
    time = F.col(time_col) if time_col else F.lit(None).cast("timestamp")
    at = [key, *order, "_r"]
    rows = events.filter(F.col("type").isin(*types)).select(
        F.monotonically_increasing_id().alias("_r"), key, *order, "type", "item_id", F.coalesce("delta", "text").alias("_d"),
        time.alias("_time"))
    ranged = rows.repartitionByRange(*at).sortWithinPartitions(*at)
    pieces = write_once(ranged.mapInArrow(lambda batches: _joined_deltas(batches, key), ranged.schema), "delta_pieces")
    numbered = runs(pieces.select("_r", key, *order, "type"), [key], [*order, "_r"], "type", "run", singleton=F.col("type") != TEXT_DELTA)
    ordkey = F.struct(*[F.col(c) for c in (*order, "_r")])
    texts = F.array_sort(F.collect_list(F.struct(ordkey.alias("o"), F.col("_d").alias("d"))))
    return (pieces.join(numbered.select("_r", F.col("run").cast("bigint").alias("run")), "_r").groupBy(key, "run")
            .agg(F.first("type").alias("type"), F.min_by("item_id", ordkey).alias("item_id"),
                 F.array_join(F.transform(texts, lambda x: x["d"]), "").alias("text"), F.max("_time").alias("time")))


def _kind(type_col: str = "type") -> F.Column:
    return F.when(F.col(type_col) == ITEM_DONE, "done").otherwise("delta")


def merge_deltas(events: DataFrame, key: str = "request_id", order: list[str] | None = None) -> DataFrame:
    """Collapse consecutive text deltas into one item.

    A run of ``response.output_text.delta`` events becomes one item with the
    first delta's id and the deltas concatenated; ``response.output_item.done``
    events pass as they are and end a run; other event types are ignored and do
    not end a run. Output ``(key, out_pos, kind, item_id, text)``.
    """
    merged = _delta_runs(events, (TEXT_DELTA, ITEM_DONE), key, order or ["seq"])
    return merged.select(key, F.col("run").alias("out_pos"), _kind().alias("kind"), "item_id", "text")


def delta_state_schema(events: DataFrame, key: str) -> str:
    """Columns of the state of :func:`merge_deltas_step`: a request's next position, and its open
    run, if there is one, which will have that position."""
    return (f"{key} {events.schema[key].dataType.simpleString()}, next_pos bigint, open boolean, open_id string, open_text string, "
            "last_time timestamp")


def merge_deltas_step(events: DataFrame, state: DataFrame, key: str = "request_id", order: list[str] | None = None,
                      time_col: str | None = None, watermark=None, idle_seconds: float | None = None) -> tuple[DataFrame, DataFrame]:
    """:func:`merge_deltas` for the next part of a stream: ``(items, new state)``.

    ``events`` come after those of earlier parts. A run that reaches the part's end stays
    open in the state, unless the request ends in the part (``response.completed``,
    which also takes the request out of the state) or the ``watermark`` is at least
    ``idle_seconds`` after the request's last event. Every join is by request with a
    table of one row per request; texts of a hot request stay spread.
    """
    order = order or ["seq"]
    found = write_once(_delta_runs(events, (TEXT_DELTA, ITEM_DONE, END_OF_REQUEST), key, order, time_col), "delta_runs")
    is_end = F.col("type") == END_OF_REQUEST
    items = found.where(~is_end)
    if found.where(is_end).isEmpty():
        items = items.withColumn("pos", F.col("run"))
    else:  # ends are no items: positions among the items only
        items = items.join(position_in_group(items.select(key, "run"), [key], ["run"], "pos"), [key, "run"])
    part = found.groupBy(key).agg(
        F.min_by("type", "run").alias("first_type"), F.max_by("type", "run").alias("last_type"), F.max("run").alias("last_run"),
        F.count(F.when(~is_end, 1)).alias("n"), F.bool_or(is_end).alias("ended"), F.max("time").alias("time"))
    each = part.join(state, key, "full").select(
        key, F.coalesce("next_pos", F.lit(0)).alias("next_pos"), F.coalesce("open", F.lit(False)).alias("was_open"), "open_id", "open_text",
        F.col("last_run").isNotNull().alias("here"), "last_run", "last_type", F.coalesce("n", F.lit(0)).alias("n"),
        F.coalesce("ended", F.lit(False)).alias("ended"), F.coalesce(F.greatest("time", "last_time"), "time", "last_time").alias("last_time"),
        (F.col("first_type") == TEXT_DELTA).alias("goes_on"))
    goes_on = F.col("was_open") & F.coalesce("goes_on", F.lit(False))
    cut = F.col("was_open") & F.col("here") & ~goes_on  # an open run that the part's first event ends
    each = each.withColumn("joined", goes_on).withColumn("cut", cut).withColumn(
        "base", F.col("next_pos") + F.col("cut").cast("int")).drop("goes_on")
    each = write_once(each, "delta_requests")
    first = F.col("joined") & (F.col("run") == 0)
    placed = items.join(each.drop("last_time", "n"), key).select(
        key, (F.col("base") + F.col("pos")).alias("out_pos"), _kind().alias("kind"),
        F.when(first, F.col("open_id")).otherwise(F.col("item_id")).alias("item_id"),
        F.when(first, F.concat("open_text", "text")).otherwise(F.col("text")).alias("text"),
        ((F.col("type") == TEXT_DELTA) & (F.col("run") == F.col("last_run")) & ~F.col("ended")).alias("open"))
    placed = write_once(placed, "delta_items")
    old = lambda rows: rows.select(key, F.col("next_pos").alias("out_pos"), F.lit("delta").alias("kind"),
                                   F.col("open_id").alias("item_id"), F.col("open_text").alias("text"))
    out = placed.where(~F.col("open")).drop("open").unionByName(old(each.where("cut")))
    still = placed.where("open").select(key, F.col("out_pos").alias("_pos"), F.col("item_id").alias("_id"), F.col("text").alias("_text"))
    kept = each.where(~F.col("ended")).join(still, key, "left")
    carried = F.col("was_open") & ~F.col("here")
    has = F.col("_pos").isNotNull()
    new = kept.select(key, F.when(has, F.col("_pos")).when(carried, F.col("next_pos")).otherwise(F.col("base") + F.col("n")).alias("next_pos"),
                      (has | carried).alias("open"), F.when(has, F.col("_id")).when(carried, F.col("open_id")).alias("open_id"),
                      F.when(has, F.col("_text")).when(carried, F.col("open_text")).alias("open_text"), "last_time")
    if idle_seconds is not None and watermark is not None:
        late = F.col("open") & (F.unix_micros("last_time") + int(idle_seconds * 1e6) <= F.unix_micros(F.lit(watermark)))
        out = out.unionByName(old(new.where(late)))
        new = new.select(key, (F.col("next_pos") + F.when(late, 1).otherwise(0)).alias("next_pos"), (F.col("open") & ~late).alias("open"),
                         F.when(~late, F.col("open_id")).alias("open_id"), F.when(~late, F.col("open_text")).alias("open_text"), "last_time")
    return out, new


def response_text(df: DataFrame, col: str = "response", out: str = "text") -> DataFrame:
    """Add the assistant's text from a model response JSON text, parsed once:
    ``choices[0].message.content`` when ``choices`` is present, else ``content`` when
    present, else the bare string, else the whole response text; a missing
    response (failed call) or a ``choices`` without that path gives the fallback."""
    v = df.withColumn("_v", F.expr(f"try_parse_json({col})"))
    kind = F.expr("schema_of_variant(_v)")
    is_obj = F.coalesce(kind.startswith("OBJECT"), F.lit(False))
    has = lambda k: F.expr(f"try_variant_get(_v, '$.{k}') IS NOT NULL")
    choice = F.expr("try_variant_get(_v, '$.choices[0].message.content', 'string')")
    text = (F.when(F.col(col).isNull(), F.lit(FALLBACK_TEXT))
            .when(is_obj & has("choices"), F.coalesce(choice, F.lit(FALLBACK_TEXT)))
            .when(is_obj & has("content"), F.expr("try_variant_get(_v, '$.content', 'string')"))
            .when(kind == "STRING", F.expr("try_variant_get(_v, '$', 'string')"))
            .otherwise(F.col(col)))
    return v.withColumn(out, text).drop("_v")


def conversation_payload(msgs: DataFrame, key: str = "chat_id",
                         order: tuple[str, ...] = ("created_at", "id")) -> DataFrame:
    """Per chat, the request payload ``{"messages": [{"role", "content"}, ...]}`` in
    message order (JSON text)."""
    ordkey = F.struct(*[F.col(c) for c in order])
    return (msgs.groupBy(key)
            .agg(F.array_sort(F.collect_list(F.struct(ordkey.alias("o"), F.struct("role", "content")
                                                      .alias("m")))).alias("_l"))
            .select(key, F.to_json(F.struct(F.transform("_l", lambda x: x["m"]).alias("messages")))
                    .alias("payload")))


def validate_arguments(df: DataFrame, json_col: str, schema: dict) -> DataFrame:
    """Validate tool arguments against a JSON schema (``properties`` with
    ``type``; ``required``): integer -> bigint, number -> double, boolean ->
    boolean, anything else (or no type) -> string. Adds one typed column per
    property and ``errors`` (array of messages, empty when valid): a missing
    required field or a value that does not convert."""
    props = schema.get("properties", {})
    required = set(schema.get("required", []))
    types = {"integer": "bigint", "number": "double", "boolean": "boolean"}
    m = F.from_json(F.col(json_col), "map<string,string>")
    out = df.withColumn("_args", m)
    errs = []
    for name, info in props.items():
        sql_t = types.get((info or {}).get("type", "string"), "string")
        raw = F.col("_args").getItem(name)
        val = raw if sql_t == "string" else F.expr(f"try_cast(_args['{name}'] AS {sql_t})")
        out = out.withColumn(name, val)
        if name in required:
            errs.append(F.when(raw.isNull(), F.lit(f"{name}: field required")))
        if sql_t != "string":
            errs.append(F.when(raw.isNotNull() & val.isNull(), F.lit(f"{name}: not a valid {sql_t}")))
    errors = F.filter(F.array(*errs), lambda x: x.isNotNull()) if errs else F.array().cast("array<string>")
    bad_json = F.when(F.col("_args").isNull(), F.array(F.lit("arguments: invalid JSON object")))
    return out.withColumn("errors", F.coalesce(bad_json, errors)).drop("_args")
