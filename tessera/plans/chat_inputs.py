"""Chat tables derived from the benchmark tables.

chats: one per order (id = order key, owner = its customer, created/updated at
the order date); messages: one per conversation turn (chat = conversation id,
id = rank by (conv_id, turn) from 1, created 2024-01-01 + conv_id hours + turn
minutes); attachments: one per page (id = page_id + 1, attached to message
page_id + 1, name and content type by ``page_id % 3``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.chats import attachment_rows
from ..operators.ordering import assign_ids
from ..sources.tables import load_table


def chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = load_table(spark, sf_dir, "orders")
    user = F.concat(F.lit("user-"), F.col("o_custkey").cast("string"))
    return o.select(F.col("o_orderkey").alias("id"),
                    F.concat(F.lit("Chat "), F.col("o_orderkey").cast("string")).alias("title"),
                    user.alias("user_id"), F.concat(user, F.lit("@example.com")).alias("user_email"),
                    F.concat(F.lit("Customer "), F.col("o_custkey").cast("string")).alias("user_name"),
                    F.col("o_orderdate").alias("created_at"), F.col("o_orderdate").alias("updated_at"),
                    "o_orderstatus")


def messages(spark: SparkSession, sf_dir: str, ids: bool = True) -> DataFrame:
    """Messages; ``ids=False`` leaves the id column out, and with it the numbering."""
    c = load_table(spark, sf_dir, "conversations")
    created = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(
        hours=F.col("conv_id"), mins=F.col("turn"))
    m = c.select("conv_id", "turn", F.col("conv_id").alias("chat_id"), F.col("text").alias("content"), "role",
                 created.alias("created_at"))
    if not ids:
        return m.drop("conv_id", "turn")
    # only the keys are numbered (and written); the text joins by them
    keys = assign_ids(c.select("conv_id", "turn"), ["conv_id", "turn"], start=1)
    return m.join(keys, ["conv_id", "turn"]).drop("conv_id", "turn")


def attachments(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = load_table(spark, sf_dir, "pages")
    k = F.col("page_id") % 3
    files = p.select(
        (F.col("page_id") + 1).alias("id"), (F.col("page_id") + 1).alias("message_id"),
        F.concat(F.lit("page-"), F.col("page_id").cast("string"),
                 F.when(k == 0, ".html").when(k == 1, ".png").otherwise("")).alias("filename"),
        F.when(k == 0, "text/html").when(k == 1, "image/png").alias("content_type"))
    return attachment_rows(files)


CHATS_SQL = """
chats AS (
  SELECT o_orderkey AS id, 'Chat ' || o_orderkey AS title, 'user-' || o_custkey AS user_id,
         'user-' || o_custkey || '@example.com' AS user_email, 'Customer ' || o_custkey AS user_name,
         o_orderdate AS created_at, o_orderdate AS updated_at, o_orderstatus
  FROM orders),
msgs AS (
  SELECT CAST(row_number() OVER (ORDER BY conv_id, turn) AS BIGINT) AS id, conv_id AS chat_id, text AS content,
         role, TIMESTAMP '2024-01-01 00:00:00' + to_hours(conv_id) + to_minutes(turn) AS created_at
  FROM conversations),
atts AS (
  SELECT page_id + 1 AS id, page_id + 1 AS message_id,
         'page-' || page_id || CASE page_id % 3 WHEN 0 THEN '.html' WHEN 1 THEN '.png' ELSE '' END AS filename,
         CASE page_id % 3 WHEN 0 THEN 'text/html' WHEN 1 THEN 'image/png' END AS content_type
  FROM pages)
"""
