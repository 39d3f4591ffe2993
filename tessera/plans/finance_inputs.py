"""Market tables derived from ``orders ⋈ customer ⋈ nation ⋈ region``.

ticker = customer nation (``N00``..``N24``); a trading day is an order date;
open/close are the first/last order of the day by order key, high/low the
extremes, volume the order count; quarterly revenue is the sum of order prices,
and a quarter ends on the ticker's last trading day in it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.numeric import money
from ..sources.tables import load_table


def _ticker(col: str):
    return F.concat(F.lit("N"), F.lpad(F.col(col).cast("string"), 2, "0"))


def priced_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = load_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    c = load_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    return (o.join(c, o.o_custkey == c.c_custkey)
            .select(_ticker("c_nationkey").alias("ticker"), "o_orderkey",
                    F.to_date("o_orderdate").alias("date"), money("o_totalprice").alias("price")))


def daily_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (priced_orders(spark, sf_dir).groupBy("ticker", "date").agg(
        F.min_by("price", "o_orderkey").alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", "o_orderkey").alias("close"),
        F.count(F.lit(1)).alias("volume")))


def financials(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.quarter("date")
    return (priced_orders(spark, sf_dir)
            .groupBy("ticker", F.year("date").alias("fiscal_year"), q.alias("q"))
            .agg(F.sum("price").cast("decimal(18,2)").alias("revenue_m"), F.max("date").alias("period_end"))
            .select("ticker", "fiscal_year",
                    F.concat(F.lit("Q"), F.col("q").cast("string")).alias("fiscal_quarter"),
                    "period_end", "revenue_m"))


def companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = load_table(spark, sf_dir, "nation")
    r = load_table(spark, sf_dir, "region")
    return (n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey)
            .select(F.col("n_nationkey").cast("bigint").alias("company_id"),
                    _ticker("n_nationkey").alias("ticker"),
                    F.col("n_name").alias("name"), F.col("r_name").alias("sector")))


MARKET_SQL = """
po AS (
  SELECT 'N' || lpad(CAST(c_nationkey AS VARCHAR), 2, '0') AS ticker, o_orderkey,
         CAST(o_orderdate AS DATE) AS date, CAST(o_totalprice AS DECIMAL(18,2)) AS price
  FROM orders JOIN customer ON o_custkey = c_custkey),
px AS (
  SELECT ticker, date, arg_min(price, o_orderkey) AS open, max(price) AS high, min(price) AS low,
         arg_max(price, o_orderkey) AS close, CAST(count(*) AS BIGINT) AS volume
  FROM po GROUP BY ticker, date),
fin AS (
  SELECT ticker, year(date) AS fiscal_year, 'Q' || CAST(quarter(date) AS VARCHAR) AS fiscal_quarter,
         max(date) AS period_end,
         CAST(sum(price) AS DECIMAL(18,2)) AS revenue_m
  FROM po GROUP BY ALL),
companies AS (
  SELECT CAST(n_nationkey AS BIGINT) AS company_id, 'N' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS ticker,
         n_name AS name, r_name AS sector
  FROM nation JOIN region ON n_regionkey = r_regionkey)
"""
