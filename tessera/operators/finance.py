"""Market time-series jobs: daily change, previous-day change, quarter-over-quarter
revenue growth, and the growth leader with its close on the period end.

Prices and money are DECIMAL(18,2); percentages are truncated (not rounded) to
four decimals with exact decimal arithmetic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.numeric import pct_truncated


def daily_change(px: DataFrame) -> DataFrame:
    """Intraday change: ``close - open`` and its percent of ``open``."""
    return px.select(
        "ticker", "date", "open", "close",
        (F.col("close") - F.col("open")).cast("decimal(18,2)").alias("change"),
        pct_truncated("close - open", "open").alias("pct_change"),
    )


def prev_day_change(px: DataFrame) -> DataFrame:
    """Change against the previous trading day present for the ticker (the
    previous row by date), null on a ticker's first row."""
    w = Window.partitionBy("ticker").orderBy("date")
    return (px.select("ticker", "date", "close")
            .withColumn("prev_date", F.lag("date").over(w))
            .withColumn("prev_close", F.lag("close").over(w))
            .withColumn("change", (F.col("close") - F.col("prev_close")).cast("decimal(18,2)"))
            .withColumn("pct_change", pct_truncated("close - prev_close", "prev_close")))


def qoq_growth(fin: DataFrame) -> DataFrame:
    """Revenue growth against the ticker's previous reported quarter."""
    w = Window.partitionBy("ticker").orderBy("fiscal_year", "fiscal_quarter")
    return (fin.select("ticker", "fiscal_year", "fiscal_quarter", "period_end", "revenue_m")
            .withColumn("prev_revenue_m", F.lag("revenue_m").over(w))
            .withColumn("growth_pct", pct_truncated("revenue_m - prev_revenue_m", "prev_revenue_m")))


def growth_leader(growth: DataFrame) -> DataFrame:
    """Per fiscal quarter, the ticker with the highest growth (ties: lowest ticker)."""
    w = Window.partitionBy("fiscal_year", "fiscal_quarter") \
        .orderBy(F.col("growth_pct").desc(), F.col("ticker").asc())
    return (growth.filter(F.col("growth_pct").isNotNull())
            .withColumn("_rn", F.row_number().over(w))
            .filter("_rn = 1").drop("_rn"))


def growth_with_close(fin: DataFrame, px: DataFrame, companies: DataFrame | None = None) -> DataFrame:
    """Quarter leader joined with the close on its period end (inner equi join on
    ticker and period_end = date) and, when given, the company name and sector."""
    lead = growth_leader(qoq_growth(fin))
    closes = px.select("ticker", F.col("date").alias("period_end"), "close")
    out = lead.join(closes, ["ticker", "period_end"], "inner")
    if companies is not None:
        out = out.join(companies.select("ticker", "name", "sector"), "ticker", "left")
    return out
