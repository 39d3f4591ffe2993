"""Billing inputs derived from the benchmark tables.

usage rows come from ``lineitem`` (sku = part, quantity, ship time, supplier as
endpoint/workspace, flags into the nested structs); the list price table from
``part``: one row valid until 1998-01-01, an open-ended row after it for parts
of size <= 40 (larger parts have no price after the cut, so their later usage is
unpriced), and an overlapping promotion 1997-07-01..1998-07-01 for parts of
size <= 5 (their usage in that span is priced twice).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources.tables import load_table

PRICE_CUT = "1998-01-01 00:00:00"


def usage_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = load_table(spark, sf_dir, "lineitem")
    return li.select(
        F.concat(F.lit("SKU-"), F.col("l_partkey").cast("string")).alias("sku_name"),
        F.to_date("l_shipdate").alias("usage_date"),
        (F.col("l_shipdate") + F.make_dt_interval(hours=F.col("l_linenumber"))).alias("usage_end_time"),
        F.when(F.col("l_returnflag") == "R", "STORAGE_SPACE")
         .when(F.col("l_returnflag") == "A", "NETWORK_BYTES")
         .otherwise("COMPUTE_TIME").alias("usage_type"),
        F.when(F.col("l_linestatus") == "O", "MODEL_SERVING").otherwise("JOBS")
         .alias("billing_origin_product"),
        F.col("l_quantity").cast("decimal(18,2)").alias("usage_quantity"),
        F.concat(F.lit("ws-"), F.col("l_suppkey").cast("string")).alias("workspace_id"),
        F.struct(
            F.concat(F.lit("ep-"), F.col("l_suppkey").cast("string")).alias("endpoint_id"),
            F.concat(F.lit("endpoint-"), F.col("l_suppkey").cast("string")).alias("endpoint_name"),
            F.concat(F.lit("app-"), F.col("l_orderkey").cast("string")).alias("app_id"),
            F.concat(F.lit("app-name-"), F.col("l_linenumber").cast("string")).alias("app_name"),
        ).alias("usage_metadata"),
        F.struct(F.when(F.col("l_discount") >= 0.05, "GPU").otherwise("CPU").alias("serving_type"))
         .alias("product_features"),
        F.struct(F.concat(F.lit("sp-"), F.col("l_suppkey").cast("string")).alias("run_as"))
         .alias("identity_metadata"),
    )


def list_price_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = load_table(spark, sf_dir, "part")
    base = F.col("p_retailprice").cast("decimal(18,2)")
    sku = F.concat(F.lit("SKU-"), F.col("p_partkey").cast("string")).alias("sku_name")

    def rows(df, start, end, price):
        return df.select(
            sku,
            F.lit(start).cast("timestamp_ntz").alias("price_start_time"),
            (F.lit(end).cast("timestamp_ntz") if end else F.lit(None).cast("timestamp_ntz"))
            .alias("price_end_time"),
            F.struct(F.struct(price.cast("decimal(18,2)").alias("default")).alias("effective_list"))
            .alias("pricing"),
        )

    first = rows(part, "1990-01-01 00:00:00", PRICE_CUT, base)
    later = rows(part.filter(F.col("p_size") <= 40), PRICE_CUT, None,
                 base + F.col("p_size").cast("decimal(18,2)"))
    promo = rows(part.filter(F.col("p_size") <= 5), "1997-07-01 00:00:00", "1998-07-01 00:00:00",
                 base - F.lit(1).cast("decimal(18,2)"))
    return first.unionByName(later).unionByName(promo)


def hot_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usage of which a third has the SKU ``HOT`` (orders whose key, without its last three bits, is
    divisible by three)."""
    app = F.regexp_extract("usage_metadata.app_id", "([0-9]+)", 1).cast("long")
    return usage_table(spark, sf_dir).withColumn("sku_name", F.when(F.floor(app / 8) % 3 == 0, "HOT").otherwise(F.col("sku_name")))


def hot_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """List prices with a version of ``HOT`` for each day with an order, valid for two days (so they overlap)."""
    days = load_table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("d")).distinct()
    start = F.col("d").cast("timestamp_ntz")
    price = F.struct(F.struct(F.dayofmonth("d").cast("decimal(18,2)").alias("default")).alias("effective_list")).alias("pricing")
    hot = days.select(F.lit("HOT").alias("sku_name"), start.alias("price_start_time"),
                      (start + F.make_dt_interval(days=F.lit(2))).alias("price_end_time"), price)
    return list_price_table(spark, sf_dir).unionByName(hot)


USAGE_SQL = """
usage AS (
  SELECT 'SKU-' || CAST(l_partkey AS VARCHAR) AS sku_name,
         CAST(l_shipdate AS DATE) AS usage_date,
         l_shipdate + to_hours(CAST(l_linenumber AS BIGINT)) AS usage_end_time,
         CASE l_returnflag WHEN 'R' THEN 'STORAGE_SPACE' WHEN 'A' THEN 'NETWORK_BYTES'
              ELSE 'COMPUTE_TIME' END AS usage_type,
         CASE WHEN l_linestatus = 'O' THEN 'MODEL_SERVING' ELSE 'JOBS' END AS billing_origin_product,
         CAST(l_quantity AS DECIMAL(18,2)) AS usage_quantity,
         'ws-' || CAST(l_suppkey AS VARCHAR) AS workspace_id,
         {'endpoint_id': 'ep-' || CAST(l_suppkey AS VARCHAR),
          'endpoint_name': 'endpoint-' || CAST(l_suppkey AS VARCHAR),
          'app_id': 'app-' || CAST(l_orderkey AS VARCHAR),
          'app_name': 'app-name-' || CAST(l_linenumber AS VARCHAR)} AS usage_metadata,
         {'serving_type': CASE WHEN l_discount >= 0.05 THEN 'GPU' ELSE 'CPU' END} AS product_features,
         {'run_as': 'sp-' || CAST(l_suppkey AS VARCHAR)} AS identity_metadata
  FROM lineitem),
list_prices AS (
  SELECT 'SKU-' || CAST(p_partkey AS VARCHAR) AS sku_name,
         TIMESTAMP '1990-01-01 00:00:00' AS price_start_time,
         TIMESTAMP '1998-01-01 00:00:00' AS price_end_time,
         {'effective_list': {'default': CAST(p_retailprice AS DECIMAL(18,2))}} AS pricing
  FROM part
  UNION ALL
  SELECT 'SKU-' || CAST(p_partkey AS VARCHAR), TIMESTAMP '1998-01-01 00:00:00', NULL::TIMESTAMP,
         {'effective_list': {'default': CAST(CAST(p_retailprice AS DECIMAL(18,2))
                                              + CAST(p_size AS DECIMAL(18,2)) AS DECIMAL(18,2))}}
  FROM part WHERE p_size <= 40
  UNION ALL
  SELECT 'SKU-' || CAST(p_partkey AS VARCHAR), TIMESTAMP '1997-07-01 00:00:00',
         TIMESTAMP '1998-07-01 00:00:00',
         {'effective_list': {'default': CAST(CAST(p_retailprice AS DECIMAL(18,2))
                                              - CAST(1 AS DECIMAL(18,2)) AS DECIMAL(18,2))}}
  FROM part WHERE p_size <= 5)
"""
