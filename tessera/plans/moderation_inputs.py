"""Chat-completions messages derived from ``conversations``.

Rules (so the data has runs, tool turns, multi-part and image-only content and
order errors): a first user turn of conversations with ``conv_id % 7 = 3`` is a
tool turn; assistant turns with ``turn % 4 = 3`` are user turns; other assistant
turns of conversations with ``conv_id % 3 = 0`` are tool turns. User turns with
``turn % 10 = 4`` carry only an image part; other user turns with
``turn % 4 = 2`` carry a text part and an image part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.jsonfmt import json_string
from ..sources.tables import load_table


def _role():
    c, t, r = F.col("conv_id"), F.col("turn"), F.col("role")
    return (F.when((t == 0) & (c % 7 == 3) & (r == "user"), "tool")
            .when((r == "assistant") & (t % 4 == 3), "user")
            .when((r == "assistant") & (c % 3 == 0), "tool")
            .otherwise(r))


def chat_messages_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(conv_id, pos, message)`` with ``message`` a JSON object text."""
    conv = load_table(spark, sf_dir, "conversations").withColumn("r", _role())
    image = F.concat(F.lit('{"type":"image_url","image_url":{"url":"https://img.example/'),
                     F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string"),
                     F.lit('.png"}}'))
    text_part = F.concat(F.lit('{"type":"text","text":'), json_string("text"), F.lit("}"))
    content = (F.when((F.col("r") == "user") & (F.col("turn") % 10 == 4), F.concat(F.lit("["), image, F.lit("]")))
               .when((F.col("r") == "user") & (F.col("turn") % 4 == 2),
                     F.concat(F.lit("["), text_part, F.lit(","), image, F.lit("]")))
               .otherwise(json_string("text")))
    msg = F.concat(F.lit('{"role":'), json_string("r"), F.lit(',"content":'), content, F.lit("}"))
    return conv.select("conv_id", F.col("turn").alias("pos"), msg.alias("message"))


MESSAGES_SQL = """
m AS (
  SELECT conv_id, turn,
         CASE WHEN turn = 0 AND conv_id % 7 = 3 AND role = 'user' THEN 'tool'
              WHEN role = 'assistant' AND turn % 4 = 3 THEN 'user'
              WHEN role = 'assistant' AND conv_id % 3 = 0 THEN 'tool'
              ELSE role END AS r, text
  FROM conversations),
t AS (
  SELECT conv_id, turn, CASE WHEN r = 'tool' THEN 'assistant' ELSE r END AS role,
         CASE WHEN r = 'tool' THEN '<tool output> ' || text || ' </tool_output>' ELSE text END AS content
  FROM m WHERE NOT (r = 'user' AND turn % 10 = 4) AND r <> 'system'),
f AS (
  SELECT *, CASE WHEN lag(role) OVER w IS NULL OR lag(role) OVER w <> role THEN 1 ELSE 0 END AS st
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
g AS (
  SELECT *, sum(st) OVER (PARTITION BY conv_id ORDER BY turn
                          ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1 AS grp FROM f),
c AS (
  SELECT conv_id, CAST(grp AS BIGINT) AS grp, any_value(role) AS role,
         string_agg(content, chr(10) || chr(10) ORDER BY turn) AS content
  FROM g GROUP BY conv_id, grp),
n AS (
  SELECT conv_id, count(*) AS n_groups, bool_or((role = 'user') <> (grp % 2 = 0)) AS bad
  FROM c GROUP BY conv_id)
"""
