"""Join helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..session import write_once

BROADCAST_BYTES = 32 << 20

def null_safe_equal(left: list[Column], right: list[Column]) -> Column:
    cond = F.lit(True)
    for a, b in zip(left, right):
        cond = cond & a.eqNullSafe(b)
    return cond


def shipped(df: DataFrame, name: str, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` stored once, and marked for broadcast if its rows measure ``limit`` bytes at most;
    beyond that the join shuffles."""
    rows = write_once(df, name)
    size = rows.agg(F.sum(F.octet_length(F.to_json(F.struct(*rows.columns)))).alias("n")).first()["n"] or 0
    return F.broadcast(rows) if size <= limit else rows


def numbered(df: DataFrame, name: str, row_col: str = "_r") -> DataFrame:
    """``df`` stored once with a number for each row."""
    return write_once(df.withColumn(row_col, F.monotonically_increasing_id()), name, "zstd")


def marked(rows: DataFrame, keys: DataFrame, key: str, out_col: str, row_col: str = "_r") -> DataFrame:
    """Add the boolean ``out_col``: whether ``keys`` has the row's ``key`` (a null key is in none).

    ``rows`` are stored with their numbers (:func:`numbered`). Only keys and numbers are
    shuffled; the answers come back as one bit a row, 64 rows to a word, so that wide rows stay where they are.
    """
    found = rows.select(key, row_col).join(keys.select(key), key, "left_semi")
    words = found.groupBy(F.shiftright(row_col, 6).alias("_word")).agg(
        F.expr(f"bit_or(shiftleft(1L, cast({row_col} & 63 AS int)))").alias("_bits"))
    joined = rows.withColumn("_word", F.shiftright(row_col, 6)).join(shipped(words, "words", 4 * BROADCAST_BYTES), "_word", "left")
    return joined.select(*rows.columns, F.coalesce(F.expr(f"bit_get(_bits, cast({row_col} & 63 AS int)) = 1"), F.lit(False)).alias(out_col))
