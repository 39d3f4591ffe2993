"""Usage cost: usage rows priced by the list price valid at the usage end time.

Semantics of the billing query:
* usage ⟕ list_prices on ``sku_name`` with the validity window in ``WHERE``;
  the ``WHERE`` rejects null prices, so the left join behaves as an inner join
  (Catalyst rewrites it so); unpriced usage disappears and overlapping price
  rows fan out. ``keep_unpriced=True`` moves the window into ``ON``.
* validity is half-open: ``start <= t AND (end IS NULL OR t < end)``.
* trailing window: ``usage_date >= as_of - days`` (inclusive).

A SKU with many price versions, or with a large share of the usage, is cut by time:
with ``bins``, both sides also meet on a bin of the usage end time, so a usage row
is compared with the versions of its bin only and a hot SKU spreads over the bins.
SKUs with few versions have one bin: their prices are not repeated for each bin.

:func:`write_usage` stores usage in folders by month; :func:`read_usage` prunes
them by the look-back, a join with billing periods prunes them at run time.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .joins import shipped

FEW_VERSIONS = 8       # a SKU with so many price versions is not cut by time
OUTPUT = ["endpoint_id", "endpoint_name", "app_id", "app_name", "sku_name", "usage_date",
          "serving_type", "usage_type", "billing_origin_product", "usage_quantity", "run_as",
          "cost"]


def _binned(usage: DataFrame, prices: DataFrame, bins: int) -> tuple[DataFrame, DataFrame]:
    """Both sides with the bin of their time. The usage's time span is cut into as many equal parts as
    the SKU has price versions, at most ``bins``; a SKU with few versions has one bin. A usage row is in
    one bin, and a price row in each that its validity touches, so versions that follow each
    other make at most twice as many rows as there are versions."""
    span = usage.agg(F.min("usage_end_time").alias("lo"), F.max("usage_end_time").alias("hi"))
    span = span.select(*[F.unix_micros(F.col(c).cast("timestamp")).alias(c) for c in ("lo", "hi")]).first()
    lo, hi = span["lo"] or 0, span["hi"] or 0
    valid = F.col("price_start_time").isNotNull() & (F.col("price_end_time").isNull() | (F.col("price_start_time") < F.col("price_end_time")))
    many = (prices.where(valid & F.col("p_sku").isNotNull()).groupBy(F.col("p_sku").alias("b_sku")).agg(F.count(F.lit(1)).alias("n"))
            .where(F.col("n") > FEW_VERSIONS).select("b_sku", F.least("n", F.lit(bins)).alias("bins")))
    many = shipped(many, "many_versions")
    width = F.ceil(F.lit(hi - lo + 1) / F.coalesce("bins", F.lit(1)))

    def place(t: Column) -> Column:
        micros = F.unix_micros(t.cast("timestamp"))
        inside = F.greatest(F.lit(lo), F.least(F.lit(hi), F.coalesce(micros, F.lit(hi))))
        return F.floor((inside - lo) / width).cast("int")

    start, end = place(F.col("price_start_time")), place(F.col("price_end_time"))
    cut = (prices.where(valid).join(many, F.col("p_sku") == F.col("b_sku"), "left")
           .withColumn("p_bin", F.explode(F.sequence(start, end))).drop("b_sku", "bins"))
    dealt = (usage.join(many, F.col("sku_name") == F.col("b_sku"), "left")
             .withColumn("bin", F.when(F.col("usage_end_time").isNotNull(), place(F.col("usage_end_time")))).drop("b_sku", "bins"))
    return dealt.alias("u"), cut.alias("p")


def usage_month(date: str | Column) -> Column:
    return F.trunc(date, "MM")


def write_usage(usage: DataFrame, path: str) -> None:
    """Store usage below ``path`` in folders by ``usage_month``. No row is shuffled: each task sorts its
    rows by month and writes those of a month to a file of its own."""
    usage.withColumn("usage_month", usage_month("usage_date")).write.mode("overwrite").partitionBy("usage_month").parquet(path)


def read_usage(spark: SparkSession, path: str, as_of: str | dt.date | None = None, days: int | None = None,
               periods: DataFrame | None = None) -> DataFrame:
    """Stored usage. With ``days``, only the folders of the look-back are listed for the scan; with
    ``periods`` (column ``usage_month``), only those of the periods are read, which the
    scan learns at run time (dynamic partition pruning)."""
    usage = spark.read.parquet(path).withColumn("usage_month", F.col("usage_month").cast("date"))
    if days is not None:
        anchor = F.current_date() if as_of is None else F.lit(as_of).cast("date")
        usage = usage.where(F.col("usage_month") >= usage_month(F.date_sub(anchor, int(days))))
    if periods is not None:
        usage = usage.join(periods.select("usage_month").distinct(), "usage_month", "left_semi")
    return usage.drop("usage_month")


def usage_cost(usage: DataFrame, prices: DataFrame, workspace: str | None = None,
               as_of: str | dt.date | None = None, days: int | None = 30,
               keep_unpriced: bool = False, bins: int | None = None) -> DataFrame:
    """Price every usage row; see module docstring.

    ``workspace=None`` keeps every workspace and adds ``workspace_id`` to the
    output. ``as_of=None`` means today. ``days=None`` drops the look-back filter.
    """
    u = usage
    if workspace is not None:
        u = u.filter(F.col("workspace_id") == F.lit(workspace))
    if days is not None:
        anchor = F.current_date() if as_of is None else F.lit(as_of).cast("date")
        # Filter on the raw column so it reaches the scan (and partition pruning
        # when the usage table is partitioned by usage_date).
        u = u.filter(F.col("usage_date") >= F.date_sub(anchor, int(days)))
    u = u.select(
        F.col("usage_metadata.endpoint_id").alias("endpoint_id"),
        F.col("usage_metadata.endpoint_name").alias("endpoint_name"),
        F.col("usage_metadata.app_id").alias("app_id"),
        F.col("usage_metadata.app_name").alias("app_name"),
        "sku_name", "usage_date",
        F.col("product_features.serving_type").alias("serving_type"),
        "usage_type", "billing_origin_product", "usage_quantity",
        F.col("identity_metadata.run_as").alias("run_as"),
        "usage_end_time", "workspace_id",
    ).alias("u")
    p = prices.select(
        F.col("sku_name").alias("p_sku"), "price_start_time", "price_end_time",
        F.col("pricing.effective_list.default").alias("list_price"),
    ).alias("p")
    cond = ((F.col("u.sku_name") == F.col("p.p_sku"))
            & (F.col("u.usage_end_time") >= F.col("p.price_start_time"))
            & (F.col("p.price_end_time").isNull()
               | (F.col("u.usage_end_time") < F.col("p.price_end_time"))))
    if bins:
        u, p = _binned(u, p, bins)
        cond = cond & (F.col("u.bin") == F.col("p.p_bin"))
    # A list price table is small next to usage; it is broadcast only after its
    # size is checked, otherwise the equi key drives a sort-merge join.
    joined = u.join(p, cond, "left" if keep_unpriced else "inner")
    cols = [F.col(c) for c in OUTPUT[:-1]]
    cols.append((F.col("usage_quantity") * F.col("list_price")).cast("decimal(38,4)").alias("cost"))
    if workspace is None:
        cols.append(F.col("workspace_id"))
    return joined.select(*cols)
