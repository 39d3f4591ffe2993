"""Message translation, stream filtering, delta merging and tool-argument queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import messages as msg
from ..sources.tables import load_table
from .catalog import register
from .message_inputs import agent_events, chat_history, model_responses, response_items, stream_events


def _q(s: str) -> str:
    return s.replace("'", "''")


@register("chat_messages", """
SELECT conv_id, turn AS pos, CAST(0 AS BIGINT) AS sub,
       CASE WHEN role = 'assistant' AND turn % 3 = 1 THEN 'tool' ELSE role END AS role,
       CASE WHEN role = 'assistant' AND turn % 3 = 0 THEN 'tool call' ELSE text END AS content,
       CAST(NULL AS VARCHAR) AS name,
       CASE WHEN role = 'assistant' AND turn % 3 = 0 THEN
         CAST(to_json([{'id': 'call-' || conv_id || '-' || turn, 'type': 'function',
                        'function': {'arguments': '{"q":' || CAST(to_json(text) AS VARCHAR) || '}',
                                     'name': 'lookup'}}]) AS VARCHAR) END AS tool_calls,
       CASE WHEN role = 'assistant' AND turn % 3 = 1 THEN 'call-' || conv_id || '-' || turn END AS tool_call_id
FROM conversations""")
def q_chat_messages(spark, sf_dir):
    return msg.to_chat_messages(response_items(spark, sf_dir))


_ITEM_NULLS = "CAST(NULL AS VARCHAR)"


@register("response_items", f"""
WITH h AS (SELECT conv_id, turn, role, text, 'msg-' || conv_id || '-' || turn AS mid,
                  'call-' || conv_id || '-' || turn AS cid,
                  '{{"q":' || CAST(to_json(text) AS VARCHAR) || '}}' AS args FROM conversations),
r AS (
  SELECT conv_id, turn, 0 AS item_pos, NULL AS type, NULL AS item_id, 'human' AS role, text,
         NULL AS call_id, NULL AS name, NULL AS arguments, NULL AS output, NULL AS error
  FROM h WHERE role = 'user' AND turn % 4 = 0
  UNION ALL
  SELECT conv_id, turn, 0, NULL, NULL, role, NULL, NULL, NULL, NULL, NULL, 'unsupported role: ' || role
  FROM h WHERE (role = 'user' AND turn % 4 <> 0) OR role NOT IN ('user', 'assistant')
  UNION ALL
  SELECT conv_id, turn, 0, 'message', mid, 'assistant', text, NULL, NULL, NULL, NULL, NULL
  FROM h WHERE role = 'assistant' AND turn % 3 = 0 AND conv_id % 2 = 0 AND length(trim(text)) > 0
  UNION ALL
  SELECT conv_id, turn, CASE WHEN conv_id % 2 = 0 AND length(trim(text)) > 0 THEN 1 ELSE 0 END,
         'function_call', mid, NULL, NULL, cid, 'lookup', CAST(to_json(args) AS VARCHAR), NULL, NULL
  FROM h WHERE role = 'assistant' AND turn % 3 = 0
  UNION ALL
  SELECT conv_id, turn, 0, 'function_call_output', NULL, NULL, NULL, 'call-' || conv_id || '-' || (turn - 1),
         NULL, NULL, text, NULL
  FROM h WHERE role = 'assistant' AND turn % 3 = 1
  UNION ALL
  SELECT conv_id, turn, 0, 'message', mid, 'assistant', text, NULL, NULL, NULL, NULL, NULL
  FROM h WHERE role = 'assistant' AND turn % 3 = 2)
SELECT conv_id, turn AS pos, CAST(item_pos AS BIGINT) AS item_pos, type, item_id, role, text, call_id, name,
       arguments, output, error FROM r""")
def q_response_items(spark, sf_dir):
    return msg.to_response_items(chat_history(spark, sf_dir))


@register("stream_filter", """
WITH conv AS (
  SELECT conv_id, turn, role, text,
         CASE WHEN role <> 'assistant' THEN 'structured_agent' WHEN turn % 3 = 0 THEN 'unstructured_agent'
              ELSE 'response_agent' END AS node FROM conversations),
upd AS (SELECT conv_id, turn, CAST(1 AS BIGINT) AS phase, CAST(0 AS BIGINT) AS idx, 'updates' AS mode, node, role,
               text AS content, CAST(NULL AS VARCHAR) AS tool_calls FROM conv),
tok AS (SELECT conv_id, turn, role, node, unnest(string_split(text, ' ')) AS tok,
               unnest(range(len(string_split(text, ' ')))) AS idx, len(string_split(text, ' ')) AS n
        FROM conv WHERE role = 'assistant'),
chunks AS (SELECT conv_id, turn, CAST(0 AS BIGINT) AS phase, CAST(idx AS BIGINT) AS idx, 'messages' AS mode, node,
                  role, CASE WHEN idx < n - 1 THEN tok || ' ' ELSE tok END AS content,
                  CASE WHEN turn % 3 = 0 THEN '[{"id":"call-' || conv_id || '-' || turn || '"}]' END AS tool_calls
           FROM tok)
SELECT * FROM (SELECT * FROM upd UNION ALL SELECT * FROM chunks)
WHERE (mode = 'updates' AND node <> 'response_agent')
   OR (mode = 'messages' AND node = 'response_agent' AND role = 'assistant'
       AND (tool_calls IS NULL OR tool_calls IN ('', '[]')))""")
def q_stream_filter(spark, sf_dir):
    return msg.filter_stream_events(agent_events(spark, sf_dir))


@register("merge_deltas", """
SELECT conv_id AS request_id,
       CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS BIGINT) AS out_pos,
       CASE WHEN role = 'assistant' THEN 'delta' ELSE 'done' END AS kind,
       'item-' || conv_id || '-' || turn || CASE WHEN role = 'assistant' THEN '-0' ELSE '' END AS item_id,
       text
FROM conversations""")
def q_merge_deltas(spark, sf_dir):
    return msg.merge_deltas(stream_events(spark, sf_dir), key="request_id", order=["turn", "sub"])


@register("response_text", f"""
SELECT conv_id, turn,
       CASE conv_id % 5 WHEN 3 THEN '{{"output":' || CAST(to_json(text) AS VARCHAR) || '}}'
                        WHEN 4 THEN '{_q(msg.FALLBACK_TEXT)}' ELSE text END AS text
FROM conversations WHERE role = 'assistant'""")
def q_response_text(spark, sf_dir):
    return msg.response_text(model_responses(spark, sf_dir), "response", "answer").select("conv_id", "turn", F.col("answer").alias("text"))


TOOL_SCHEMA = {"properties": {"k": {"type": "integer"}, "w": {"type": "number"},
                              "flag": {"type": "boolean"}, "note": {}},
               "required": ["k"]}


def _arg(name, typ):
    raw = f"json_extract_string(props, '$.{name}')"
    return raw if typ is None else f"TRY_CAST({raw} AS {typ})"


@register("validate_arguments", f"""
SELECT event_id, {_arg('k', 'BIGINT')} AS k, {_arg('w', 'DOUBLE')} AS w, {_arg('flag', 'BOOLEAN')} AS flag,
       {_arg('note', None)} AS note,
       concat_ws('; ',
         CASE WHEN {_arg('k', None)} IS NULL THEN 'k: field required' END,
         CASE WHEN {_arg('k', None)} IS NOT NULL AND {_arg('k', 'BIGINT')} IS NULL THEN 'k: not a valid bigint' END,
         CASE WHEN {_arg('w', None)} IS NOT NULL AND {_arg('w', 'DOUBLE')} IS NULL THEN 'w: not a valid double' END,
         CASE WHEN {_arg('flag', None)} IS NOT NULL AND {_arg('flag', 'BOOLEAN')} IS NULL
              THEN 'flag: not a valid boolean' END) AS errors
FROM events""")
def q_validate_arguments(spark, sf_dir):
    ev = load_table(spark, sf_dir, "events").select("event_id", "props")
    out = msg.validate_arguments(ev, "props", TOOL_SCHEMA)
    return out.select("event_id", "k", "w", "flag", "note", F.array_join("errors", "; ").alias("errors"))


@register("tag_speaker", """
SELECT conv_id, turn,
       CASE WHEN length(text) > 0 THEN '<name>Unstructured Agent</name>' || chr(10) || text ELSE text END AS tagged
FROM conversations WHERE role = 'assistant'""")
def q_tag_speaker(spark, sf_dir):
    from ..functions.text import tag_speaker
    c = load_table(spark, sf_dir, "conversations").filter(F.col("role") == "assistant")
    return c.select("conv_id", "turn", tag_speaker("text", "Unstructured Agent").alias("tagged"))


@register("tag_structured", """
SELECT conv_id, '<name>Structured Agent</name>' || chr(10) || coalesce(arg_min(text, turn), '') || ' ' || chr(10) || chr(10)
       || ' ' || coalesce(arg_max(text, turn), '') AS tagged
FROM conversations GROUP BY conv_id""")
def q_tag_structured(spark, sf_dir):
    from ..functions.text import tag_structured
    c = load_table(spark, sf_dir, "conversations").groupBy("conv_id").agg(
        F.min_by("text", "turn").alias("first"), F.max_by("text", "turn").alias("last"))
    return c.select("conv_id", tag_structured("first", "last").alias("tagged"))


# Tool calls derived from events so that every check fails somewhere.
_CALLS = ['{}', '{"k": 1, "w": 2.5, "flag": true, "note": "n"}', '{"k": "x", "w": "y", "flag": "z"}', '{"w": 1}',
          '{"k": 7, "flag": false}']


@register("validate_arguments_errors", f"""
WITH events AS (SELECT event_id, [{", ".join(f"'{a}'" for a in _CALLS)}][event_id % 5 + 1] AS props FROM events)
SELECT event_id, {_arg('k', 'BIGINT')} AS k, {_arg('w', 'DOUBLE')} AS w, {_arg('flag', 'BOOLEAN')} AS flag,
       {_arg('note', None)} AS note,
       concat_ws('; ',
         CASE WHEN {_arg('k', None)} IS NULL THEN 'k: field required' END,
         CASE WHEN {_arg('k', None)} IS NOT NULL AND {_arg('k', 'BIGINT')} IS NULL THEN 'k: not a valid bigint' END,
         CASE WHEN {_arg('w', None)} IS NOT NULL AND {_arg('w', 'DOUBLE')} IS NULL THEN 'w: not a valid double' END,
         CASE WHEN {_arg('flag', None)} IS NOT NULL AND {_arg('flag', 'BOOLEAN')} IS NULL
              THEN 'flag: not a valid boolean' END) AS errors
FROM events""")
def q_validate_arguments_errors(spark, sf_dir):
    calls = F.array(*[F.lit(a) for a in _CALLS])
    ev = load_table(spark, sf_dir, "events").select(
        "event_id", F.element_at(calls, (F.col("event_id") % 5 + 1).cast("int")).alias("props"))
    out = msg.validate_arguments(ev, "props", TOOL_SCHEMA)
    return out.select("event_id", "k", "w", "flag", "note", F.array_join("errors", "; ").alias("errors"))
