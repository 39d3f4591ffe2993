"""Chat table queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import chat_store as cs, chats as ch
from ..operators.messages import conversation_payload
from ..operators.ordering import assign_ids
from ..session import shared_dir
from ..sources.tables import load_table
from .catalog import register
from .chat_inputs import CHATS_SQL, attachments, chats, messages

_W = "WITH " + CHATS_SQL


@register("assign_ids", """
SELECT conv_id, turn, CAST(row_number() OVER (ORDER BY conv_id, turn) AS BIGINT) AS id FROM conversations""")
def q_assign_ids(spark, sf_dir):
    c = load_table(spark, sf_dir, "conversations").select("conv_id", "turn")
    return assign_ids(c, ["conv_id", "turn"], start=1)


@register("chat_message_count", _W + """
SELECT c.id, CAST(count(m.id) AS BIGINT) AS message_count FROM chats c LEFT JOIN msgs m ON m.chat_id = c.id
GROUP BY c.id""")
def q_chat_message_count(spark, sf_dir):
    return ch.message_counts(chats(spark, sf_dir), messages(spark, sf_dir, ids=False))


_ROWS_SQL = _W + """
, m AS (SELECT id AS message_id, chat_id, role, content, created_at,
               CAST(row_number() OVER (PARTITION BY chat_id ORDER BY created_at, id) - 1 AS BIGINT) AS msg_pos
        FROM msgs),
a AS (SELECT a.id AS attachment_id, a.message_id, a.filename,
             CAST(a.id AS VARCHAR) || '.' || CASE WHEN contains(a.filename, '.')
                  THEN split_part(a.filename, '.', -1) ELSE '' END AS stored_filename,
             CASE WHEN starts_with(coalesce(a.content_type, ''), 'image/') THEN 'image' ELSE 'text' END AS file_type,
             CAST(row_number() OVER (PARTITION BY a.message_id ORDER BY a.id) - 1 AS BIGINT) AS att_pos
      FROM atts a)
SELECT c.id AS chat_id, m.msg_pos, m.message_id, m.role, m.content, m.created_at, a.att_pos, a.attachment_id,
       a.filename, a.stored_filename, a.file_type
FROM chats c LEFT JOIN (m LEFT JOIN a USING (message_id)) ON m.chat_id = c.id"""


@register("chat_with_messages", _ROWS_SQL)
def q_chat_with_messages(spark, sf_dir):
    return ch.chat_with_messages(chats(spark, sf_dir), messages(spark, sf_dir), attachments(spark, sf_dir))


@register("owned_messages", _W + """
, req AS (SELECT 'user-' || o_custkey AS user_id, o_orderkey AS chat_id FROM orders
          UNION ALL SELECT 'user-' || o_custkey, o_orderkey + 1 FROM orders)
SELECT r.user_id, r.chat_id, m.id AS message_id, m.content
FROM req r JOIN msgs m ON m.chat_id = r.chat_id
WHERE EXISTS (SELECT 1 FROM chats c WHERE c.id = r.chat_id AND c.user_id = r.user_id)""")
def q_owned_messages(spark, sf_dir):
    o = load_table(spark, sf_dir, "orders")
    user = F.concat(F.lit("user-"), F.col("o_custkey").cast("string")).alias("user_id")
    req = o.select(user, F.col("o_orderkey").alias("chat_id")).unionByName(
        o.select(user, (F.col("o_orderkey") + 1).alias("chat_id")))
    allowed = ch.owned_by(req, chats(spark, sf_dir))
    m = messages(spark, sf_dir).select(F.col("id").alias("message_id"), "chat_id", "content")
    return allowed.join(m, "chat_id").select("user_id", "chat_id", "message_id", "content")


def _deleted(spark, sf_dir):
    return chats(spark, sf_dir).filter(F.col("o_orderstatus") == "F").select("id")


@register("cascade_delete", _W + """
SELECT m.id, m.chat_id, m.content FROM msgs m
WHERE m.chat_id NOT IN (SELECT id FROM chats WHERE o_orderstatus = 'F')""")
def q_cascade_delete(spark, sf_dir):
    _, keep = ch.cascade_delete(chats(spark, sf_dir), messages(spark, sf_dir), _deleted(spark, sf_dir))
    return keep.select("id", "chat_id", "content")


@register("cascade_delete_chats", _W + """
SELECT id, user_id FROM chats WHERE id NOT IN (SELECT id FROM chats WHERE o_orderstatus = 'F')""")
def q_cascade_delete_chats(spark, sf_dir):
    keep, _ = ch.cascade_delete(chats(spark, sf_dir), messages(spark, sf_dir, ids=False), _deleted(spark, sf_dir))
    return keep.select("id", "user_id")


@register("cascade_delete_attachments", _W + """
SELECT a.id, a.message_id FROM atts a
WHERE a.message_id NOT IN (SELECT m.id FROM msgs m JOIN chats c ON c.id = m.chat_id WHERE c.o_orderstatus = 'F')""")
def q_cascade_delete_attachments(spark, sf_dir):
    _, _, keep = ch.cascade_delete(chats(spark, sf_dir), messages(spark, sf_dir), _deleted(spark, sf_dir),
                                   attachments(spark, sf_dir))
    return keep.select("id", "message_id")


# New messages: one per order with key divisible by 5, for the chat of a sixth of
# that key (so some chats are unknown), sent a day after the order.
_NEW_SQL = """
, n AS (SELECT o_orderkey AS k, o_orderkey // 6 AS chat_id, 'Order ' || o_orderkey AS content, 'user' AS role,
               o_orderdate + INTERVAL 1 DAY AS created_at FROM orders WHERE o_orderkey % 5 = 0),
known AS (SELECT * FROM n WHERE chat_id IN (SELECT id FROM chats)),
added AS (SELECT (SELECT max(id) FROM msgs) + row_number() OVER (ORDER BY created_at, k) AS id, chat_id, content, created_at
          FROM known)
"""


def _new_messages(spark, sf_dir):
    o = load_table(spark, sf_dir, "orders").filter(F.col("o_orderkey") % 5 == 0)
    return o.select(F.col("o_orderkey").alias("k"), F.floor(F.col("o_orderkey") / 6).alias("chat_id"),
                    F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")).alias("content"),
                    F.lit("user").alias("role"), (F.col("o_orderdate") + F.expr("INTERVAL 1 DAY")).alias("created_at"))


def _append(spark, sf_dir):
    return ch.append_messages(chats(spark, sf_dir), messages(spark, sf_dir), _new_messages(spark, sf_dir), ["created_at", "k"])


@register("append_messages", _W + _NEW_SQL + """
SELECT id, chat_id, content FROM msgs UNION ALL SELECT CAST(id AS BIGINT), chat_id, content FROM added""")
def q_append_messages(spark, sf_dir):
    return _append(spark, sf_dir)[1].select("id", "chat_id", "content")


@register("append_updated_at", _W + _NEW_SQL + """
SELECT c.id, greatest(c.updated_at, coalesce(l.t, c.updated_at)) AS updated_at
FROM chats c LEFT JOIN (SELECT chat_id, max(created_at) AS t FROM added GROUP BY chat_id) l ON l.chat_id = c.id""")
def q_append_updated_at(spark, sf_dir):
    return _append(spark, sf_dir)[0].select("id", "updated_at")


@register("create_chats", _W + """
, n AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS r FROM customer)
SELECT id, title, user_id, user_email, updated_at FROM chats
UNION ALL
SELECT CAST((SELECT max(id) FROM chats) + r AS BIGINT), 'New Chat', 'user-' || c_custkey, 'user-' || c_custkey || '@example.com',
       TIMESTAMP '2024-01-01 00:00:00' FROM n""")
def q_create_chats(spark, sf_dir):
    c = load_table(spark, sf_dir, "customer")
    user = F.concat(F.lit("user-"), F.col("c_custkey").cast("string"))
    base = chats(spark, sf_dir)
    new = c.select("c_custkey", F.lit("New Chat").alias("title"), user.alias("user_id"),
                   F.concat(user, F.lit("@example.com")).alias("user_email"), F.col("c_name").alias("user_name"),
                   F.lit("2024-01-01 00:00:00").cast(base.schema["created_at"].dataType).alias("created_at"))
    return ch.create_chats(base, new, ["c_custkey"]).select("id", "title", "user_id", "user_email", "updated_at")


@register("create_attachments", _W + """
, n AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS r FROM documents)
SELECT id, message_id, CAST(id AS VARCHAR) || '.' || CASE WHEN contains(filename, '.') THEN split_part(filename, '.', -1)
       ELSE '' END AS stored_filename FROM atts
UNION ALL
SELECT CAST((SELECT max(id) FROM atts) + r AS BIGINT), doc_id, CAST((SELECT max(id) FROM atts) + r AS VARCHAR) || '.txt' FROM n""")
def q_create_attachments(spark, sf_dir):
    d = load_table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("message_id"), F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("filename"),
        F.lit("text/plain").alias("content_type"))
    return ch.create_attachments(attachments(spark, sf_dir), d, ["message_id"]).select("id", "message_id", "stored_filename")


@register("user_chats_page", _W + """
SELECT user_id, id, updated_at, rank FROM (
  SELECT user_id, id, updated_at,
         CAST(row_number() OVER (PARTITION BY user_id ORDER BY updated_at DESC, id ASC) AS BIGINT) AS rank
  FROM chats) WHERE rank <= 50""")
def q_user_chats_page(spark, sf_dir):
    return ch.user_chats_page(chats(spark, sf_dir)).select("user_id", "id", "updated_at", "rank")


@register("conversation_payload", _W + """
SELECT chat_id, CAST(to_json({'messages': list({'role': role, 'content': content} ORDER BY created_at, id)})
                     AS VARCHAR) AS payload
FROM msgs GROUP BY chat_id""")
def q_conversation_payload(spark, sf_dir):
    return conversation_payload(messages(spark, sf_dir))


@register("chat_title", _W + r"""
, f AS (SELECT chat_id, arg_min(content, (created_at, id)) AS first FROM msgs WHERE role = 'user' GROUP BY chat_id),
t AS (SELECT c.id, c.created_at, regexp_replace(coalesce(f.first, ''), '^[\s\x{FEFF}\x85\p{Z}]+|[\s\x{FEFF}\x85\p{Z}]+$', '', 'g') AS t FROM chats c LEFT JOIN f ON f.chat_id = c.id)
SELECT id, CASE WHEN length(t) = 0 THEN 'New Chat ' || strftime(created_at, '%Y-%m-%d %H:%M:%S')
                WHEN length(t) > 50 THEN substr(t, 1, 50) || '...' ELSE t END AS title
FROM t""")
def q_chat_title(spark, sf_dir):
    return ch.chat_titles_from_messages(chats(spark, sf_dir), messages(spark, sf_dir))


@register("attachment_info", _W + """
SELECT id, message_id, filename,
       CAST(id AS VARCHAR) || '.' || CASE WHEN contains(filename, '.') THEN split_part(filename, '.', -1)
                                          ELSE '' END AS stored_filename,
       '/uploads/' || CAST(id AS VARCHAR) || '.' || CASE WHEN contains(filename, '.')
                                                         THEN split_part(filename, '.', -1) ELSE '' END AS file_path,
       CASE WHEN starts_with(coalesce(content_type, ''), 'image/') THEN 'image' ELSE 'text' END AS file_type
FROM atts""")
def q_attachment_info(spark, sf_dir):
    return attachments(spark, sf_dir)


@register("chat_updated_at", _W + """
SELECT c.id, CASE WHEN l.latest IS NULL THEN c.updated_at ELSE greatest(c.updated_at, l.latest) END AS updated_at
FROM chats c LEFT JOIN (SELECT chat_id, max(created_at) AS latest FROM msgs GROUP BY chat_id) l
ON l.chat_id = c.id""")
def q_chat_updated_at(spark, sf_dir):
    return ch.apply_messages(chats(spark, sf_dir), messages(spark, sf_dir, ids=False)).select("id", "updated_at")


def _title_updates(spark, sf_dir):
    return load_table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("chat_id"), F.concat(F.lit("Renamed "), F.col("l_linenumber").cast("string")).alias("title"),
        F.col("l_shipdate").alias("ts"), F.col("l_linenumber").alias("seq"))


_TITLES_SQL = """
, u AS (SELECT l_orderkey AS chat_id, 'Renamed ' || l_linenumber AS title, l_shipdate AS ts,
               l_linenumber AS seq FROM lineitem),
last AS (SELECT chat_id, arg_max(title, (ts, seq)) AS title, max(ts) AS ts FROM u GROUP BY chat_id)
"""


@register("chat_titles", _W + _TITLES_SQL + """
SELECT c.id, coalesce(last.title, c.title) AS title, coalesce(last.ts, c.updated_at) AS updated_at
FROM chats c LEFT JOIN last ON last.chat_id = c.id""")
def q_chat_titles(spark, sf_dir):
    return ch.apply_titles(chats(spark, sf_dir), _title_updates(spark, sf_dir)).select("id", "title", "updated_at")


def _store(spark, sf_dir):
    """A store of the chat tables under a name of its own."""
    return cs.create_store(f"chat_{uuid.uuid4().hex[:12]}", shared_dir(spark, "chat_store"), chats(spark, sf_dir), messages(spark, sf_dir),
                           attachments(spark, sf_dir), parts=8, buckets=8)


@register("ordered_messages", _W + """
SELECT chat_id, CAST(row_number() OVER (PARTITION BY chat_id ORDER BY created_at, id) - 1 AS BIGINT) AS msg_pos, id, role, content
FROM msgs""")
def q_ordered_messages(spark, sf_dir):
    return cs.ordered_messages(spark, _store(spark, sf_dir)).select("chat_id", "msg_pos", "id", "role", "content")


@register("chat_store_rows", _ROWS_SQL)
def q_chat_store_rows(spark, sf_dir):
    return cs.chat_rows(spark, _store(spark, sf_dir))


@register("chat_store_changes", _W + _NEW_SQL + _TITLES_SQL + """
, l AS (SELECT chat_id, max(created_at) AS t FROM added GROUP BY chat_id),
n2 AS (SELECT chat_id, count(*) AS n FROM (SELECT chat_id FROM msgs UNION ALL SELECT chat_id FROM added) GROUP BY chat_id),
na AS (SELECT m.chat_id, count(*) AS n FROM atts a JOIN msgs m ON m.id = a.message_id GROUP BY m.chat_id)
SELECT c.id, coalesce(last.title, c.title) AS title,
       coalesce(last.ts, greatest(c.updated_at, coalesce(l.t, c.updated_at))) AS updated_at,
       CAST(coalesce(n2.n, 0) AS BIGINT) AS message_count, CAST(coalesce(na.n, 0) AS BIGINT) AS attachment_count
FROM chats c LEFT JOIN l ON l.chat_id = c.id LEFT JOIN last ON last.chat_id = c.id LEFT JOIN n2 ON n2.chat_id = c.id
LEFT JOIN na ON na.chat_id = c.id
WHERE c.o_orderstatus <> 'F'""")
def q_chat_store_changes(spark, sf_dir):
    """New messages, title updates and a cascading delete, written back to the stored tables and read again."""
    store = _store(spark, sf_dir)
    cs.append(spark, store, _new_messages(spark, sf_dir), ["created_at", "k"])
    cs.rename(spark, store, _title_updates(spark, sf_dir))
    cs.delete(spark, store, _deleted(spark, sf_dir))
    files = store.table(spark, "attachments").groupBy("chat_id").agg(F.count(F.lit(1)).alias("attachment_count"))
    return (store.table(spark, "chats").select("id", "title", "updated_at").join(cs.message_counts(spark, store), "id")
            .join(files, F.col("id") == F.col("chat_id"), "left")
            .select("id", "title", "updated_at", "message_count", F.coalesce("attachment_count", F.lit(0)).alias("attachment_count")))
