"""Billing queries over the derived usage and price tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.billing import read_usage, usage_cost, write_usage
from ..session import shared_dir
from .billing_inputs import USAGE_SQL, hot_prices, hot_usage, list_price_table, usage_table
from ..sources.tables import load_table
from .catalog import register

# Pinned anchor so results do not depend on the run date; the look-back then
# reaches into the promotion overlap and past the price cut.
AS_OF = "1998-07-15"

_SELECT = """
SELECT u.usage_metadata.endpoint_id AS endpoint_id, u.usage_metadata.endpoint_name AS endpoint_name,
       u.usage_metadata.app_id AS app_id, u.usage_metadata.app_name AS app_name,
       u.sku_name, u.usage_date, u.product_features.serving_type AS serving_type,
       u.usage_type, u.billing_origin_product, u.usage_quantity,
       u.identity_metadata.run_as AS run_as,
       CAST(u.usage_quantity * p.pricing.effective_list.default AS DECIMAL(38,4)) AS cost,
       u.workspace_id
FROM usage u {join} list_prices p ON p.sku_name = u.sku_name {on_extra}
WHERE {where}
"""
_WINDOW = ("u.usage_end_time >= p.price_start_time AND (p.price_end_time IS NULL "
           "OR u.usage_end_time < p.price_end_time)")
_LOOKBACK = f"u.usage_date >= DATE '{AS_OF}' - INTERVAL 30 DAY"


@register("usage_cost", "WITH " + USAGE_SQL + _SELECT.format(
    join="LEFT JOIN", on_extra="", where=_WINDOW + " AND " + _LOOKBACK))
def q_usage_cost(spark, sf_dir):
    return usage_cost(usage_table(spark, sf_dir), list_price_table(spark, sf_dir),
                      workspace=None, as_of=AS_OF, days=30)


@register("usage_cost_keep_unpriced", "WITH " + USAGE_SQL + _SELECT.format(
    join="LEFT JOIN", on_extra="AND " + _WINDOW, where=_LOOKBACK))
def q_usage_cost_keep_unpriced(spark, sf_dir):
    return usage_cost(usage_table(spark, sf_dir), list_price_table(spark, sf_dir),
                      workspace=None, as_of=AS_OF, days=30, keep_unpriced=True)


@register("usage_cost_workspace", "WITH " + USAGE_SQL + _SELECT.replace(""",
       u.workspace_id""", "").format(join="JOIN", on_extra="", where=_WINDOW + f" AND u.usage_date >= DATE '{AS_OF}' - INTERVAL 400 DAY "
                                     "AND u.workspace_id = 'ws-7'"))
def q_usage_cost_workspace(spark, sf_dir):
    """One workspace over 400 days, from usage stored by month."""
    path = shared_dir(spark, "usage")
    write_usage(usage_table(spark, sf_dir), path)
    return usage_cost(read_usage(spark, path, AS_OF, 400), list_price_table(spark, sf_dir), workspace="ws-7", as_of=AS_OF, days=400)


@register("usage_cost_periods", "WITH " + USAGE_SQL + _SELECT.format(
    join="JOIN", on_extra="", where=_WINDOW + " AND date_trunc('month', u.usage_date) IN "
    "(SELECT date_trunc('month', CAST(o_orderdate AS DATE)) FROM orders WHERE month(o_orderdate) = 7 AND year(o_orderdate) % 2 = 0)"))
def q_usage_cost_periods(spark, sf_dir):
    """Usage of the Julys of even years with orders: the months are known at run time only."""
    path = shared_dir(spark, "usage")
    write_usage(usage_table(spark, sf_dir), path)
    periods = load_table(spark, sf_dir, "orders").where((F.month("o_orderdate") == 7) & (F.year("o_orderdate") % 2 == 0)) \
        .select(F.trunc("o_orderdate", "MM").alias("usage_month")).distinct()
    return usage_cost(read_usage(spark, path, periods=periods), list_price_table(spark, sf_dir), as_of=AS_OF, days=None)


_HOT_SQL = USAGE_SQL.replace("usage AS (", "plain_usage AS (").replace("list_prices AS (", "plain_prices AS (") + """,
usage AS (SELECT * REPLACE (CASE WHEN (CAST(substr(usage_metadata.app_id, 5) AS BIGINT) // 8) % 3 = 0 THEN 'HOT' ELSE sku_name END
                            AS sku_name) FROM plain_usage),
list_prices AS (SELECT * FROM plain_prices UNION ALL
  SELECT 'HOT', CAST(d AS TIMESTAMP), CAST(d AS TIMESTAMP) + INTERVAL 2 DAY,
         {'effective_list': {'default': CAST(day(d) AS DECIMAL(18,2))}}
  FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders))
"""


@register("usage_cost_hot_sku", "WITH " + _HOT_SQL + _SELECT.format(join="JOIN", on_extra="", where=_WINDOW))
def q_usage_cost_hot_sku(spark, sf_dir):
    """All usage; one SKU has a third of it and a price version a day."""
    return usage_cost(hot_usage(spark, sf_dir), hot_prices(spark, sf_dir), as_of=AS_OF, days=None, bins=512)
