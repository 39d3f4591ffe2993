"""JSON text helpers built from Spark's own JSON writer."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def json_string(c) -> Column:
    """The JSON string literal of a text column (quoted and escaped)."""
    col = F.col(c) if isinstance(c, str) else c
    j = F.to_json(F.struct(col.alias("t")))
    # '{"t":' + literal + '}'
    return F.when(col.isNotNull(), j.substr(F.lit(6), F.length(j) - 6))
