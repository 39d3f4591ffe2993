"""Exact decimal helpers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def pct_truncated(delta: str, base: str, scale: int = 4) -> Column:
    """100 * delta / base truncated toward zero to ``scale`` decimals.

    ``delta`` and ``base`` are SQL expressions over two-decimal money values.
    Computed exactly with integral division on DECIMAL(38,0) (``div`` truncates
    toward zero), never through a double; null when base is 0 or null.
    """
    num = f"CAST(CAST(({delta}) AS DECIMAL(38,2)) * {10 ** (4 + scale)} AS DECIMAL(38,0))"
    den = f"CAST(CAST(({base}) AS DECIMAL(38,2)) * 100 AS DECIMAL(38,0))"
    return F.expr(
        f"CAST(CAST(CASE WHEN {den} <> 0 THEN {num} div {den} END AS DECIMAL(38,0))"
        f" * CAST(1E-{scale} AS DECIMAL(18,{scale})) AS DECIMAL(18,{scale}))")


def money(c) -> Column:
    """Cast a two-decimal money value to DECIMAL(18,2) before any arithmetic."""
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(18,2)")


def pct_truncated_sql(delta: str, base: str, scale: int = 4) -> str:
    """DuckDB form of :func:`pct_truncated` (HUGEINT ``//`` truncates toward zero)."""
    num = f"CAST(CAST(({delta}) AS DECIMAL(38,2)) * {10 ** (4 + scale)} AS HUGEINT)"
    den = f"CAST(CAST(({base}) AS DECIMAL(38,2)) * 100 AS HUGEINT)"
    return (f"CAST(CAST(CASE WHEN {den} <> 0 THEN {num} // {den} END AS DECIMAL(38,0))"
            f" * CAST(1E-{scale} AS DECIMAL(18,{scale})) AS DECIMAL(18,{scale}))")
