import datetime as dt
import os
import random
import re
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F, types as T

from tessera.operators import billing
from tessera.operators.billing import usage_cost

USAGE = T.StructType([
    T.StructField("sku_name", T.StringType()),
    T.StructField("usage_date", T.DateType()),
    T.StructField("usage_end_time", T.TimestampType()),
    T.StructField("usage_type", T.StringType()),
    T.StructField("billing_origin_product", T.StringType()),
    T.StructField("usage_quantity", T.DecimalType(18, 2)),
    T.StructField("workspace_id", T.StringType()),
    T.StructField("usage_metadata", T.StructType([T.StructField(n, T.StringType()) for n in
                                                  ["endpoint_id", "endpoint_name", "app_id", "app_name"]])),
    T.StructField("product_features", T.StructType([T.StructField("serving_type", T.StringType())])),
    T.StructField("identity_metadata", T.StructType([T.StructField("run_as", T.StringType())])),
])
PRICES = T.StructType([
    T.StructField("sku_name", T.StringType()),
    T.StructField("price_start_time", T.TimestampType()),
    T.StructField("price_end_time", T.TimestampType()),
    T.StructField("pricing", T.StructType([T.StructField("effective_list", T.StructType(
        [T.StructField("default", T.DecimalType(18, 2))]))])),
])

AS_OF = dt.date(2024, 3, 31)
T0 = dt.datetime(2024, 3, 1)
T1 = dt.datetime(2024, 3, 10)


def _u(sku, day, end, qty, ws="w1"):
    return (sku, day, end, "COMPUTE", "JOBS", D(qty), ws, ("e", "en", "a", "an"), ("GPU",), ("me",))


def test_usage_cost_cases(spark):
    usage = spark.createDataFrame([
        _u("A", dt.date(2024, 3, 5), T0, "2.00"),            # end == start: kept
        _u("A", dt.date(2024, 3, 12), T1, "3.00"),           # end == price end: next row only
        _u("B", dt.date(2024, 3, 20), T1, "1.00"),           # no price row: dropped
        _u("C", dt.date(2024, 3, 1), T1, "1.00"),            # exactly 30 days old: kept, priced twice
        _u("C", dt.date(2024, 2, 29), T1, "1.00"),           # 31 days old: dropped
        _u("A", dt.date(2024, 3, 5), T0, "9.00", ws="w2"),   # other workspace
    ], USAGE)
    prices = spark.createDataFrame([
        ("A", T0, T1, ((D("1.50"),),)),
        ("A", T1, None, ((D("2.00"),),)),                     # open-ended
        ("C", dt.datetime(2024, 1, 1), None, ((D("1.00"),),)),
        ("C", dt.datetime(2024, 2, 1), None, ((D("3.00"),),)),  # overlaps: fan-out
    ], PRICES)
    out = usage_cost(usage, prices, workspace="w1", as_of=AS_OF)
    rows = sorted((r.sku_name, str(r.usage_date), str(r.cost)) for r in out.collect())
    assert rows == [("A", "2024-03-05", "3.0000"), ("A", "2024-03-12", "6.0000"),
                    ("C", "2024-03-01", "1.0000"), ("C", "2024-03-01", "3.0000")]
    assert "workspace_id" not in out.columns
    kept = usage_cost(usage, prices, workspace="w1", as_of=AS_OF, keep_unpriced=True)
    assert sorted(r.sku_name for r in kept.filter("cost IS NULL").collect()) == ["B"]


def test_left_join_becomes_inner(spark):
    usage = spark.createDataFrame([_u("A", dt.date(2024, 3, 5), T0, "2.00")], USAGE)
    prices = spark.createDataFrame([("A", T0, None, ((D("1.50"),),))], PRICES)
    plan = usage_cost(usage, prices, as_of=AS_OF)._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftOuter" not in plan


def _hot_case(spark):
    rng = random.Random(4)
    day = lambda d: dt.datetime(2024, 1, 1) + dt.timedelta(days=d)
    usage = [_u(rng.choice(["H", "H", "H", "A", "B", "N"]), (t := day(rng.uniform(0, 90))).date(), t, "1.00") for _ in range(300)]
    usage += [_u("H", day(0).date(), None, "1.00"), _u(None, day(1).date(), day(1), "1.00"), _u("H", day(90).date(), day(90), "2.00")]
    prices = [("H", day(d), day(d + rng.choice([1, 1, 2])), ((D(d + 1),),)) for d in range(-3, 95)]
    prices += [("A", day(-500), None, ((D(5),),)), ("A", day(40), None, ((D(6),),)), ("B", day(20), day(20), ((D(1),),)),
               ("B", day(30), day(10), ((D(1),),)), ("B", None, None, ((D(1),),)), ("H", day(200), None, ((D(1),),)), ("H", day(90), None, ((D(9),),))]
    return spark.createDataFrame(usage, USAGE), spark.createDataFrame(prices, PRICES)


@pytest.mark.parametrize("keep", [False, True])
def test_bins_give_the_same_rows(spark, keep):
    usage, prices = _hot_case(spark)
    rows = lambda **a: sorted(map(str, usage_cost(usage, prices, as_of=AS_OF, days=None, keep_unpriced=keep, **a).collect()))
    want = rows()
    assert len(want) > 200
    for bins in (1, 7, 1000):
        assert rows(bins=bins) == want
    assert usage_cost(usage.limit(0), prices, as_of=AS_OF, bins=8).count() == 0


def test_bins_compare_few_versions(spark):
    usage, prices = _hot_case(spark)
    u, p = billing._binned(usage, prices.withColumnRenamed("sku_name", "p_sku"), 90)
    met = u.join(p, (F.col("u.sku_name") == F.col("p.p_sku")) & (F.col("u.bin") == F.col("p.p_bin"))).count()
    assert met < usage.join(prices, "sku_name").count() / 10


def test_stored_usage_is_pruned_by_month(spark, tmp_path):
    usage, prices = _hot_case(spark)
    path = str(tmp_path / "usage")
    billing.write_usage(usage, path)
    assert sorted(x for x in os.listdir(path) if x.startswith("usage_month")) == [f"usage_month=2024-0{m}-01" for m in (1, 2, 3)]
    plain = usage_cost(usage, prices, as_of=AS_OF, days=40)
    recent = usage_cost(billing.read_usage(spark, path, AS_OF, 40), prices, as_of=AS_OF, days=40)
    assert sorted(map(str, recent.collect())) == sorted(map(str, plain.collect()))
    scan = recent._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*usage_month#\d+ >= ", scan) or "2024-02-01" in scan
    months = spark.createDataFrame([(dt.date(2024, 2, 1), "x"), (dt.date(2024, 2, 1), "y"), (dt.date(2030, 1, 1), "x")], "usage_month date, k string")
    some = billing.read_usage(spark, path, periods=months.where("k = 'x'"))
    assert sorted(map(str, some.select(*usage.columns).collect())) == sorted(
        map(str, usage.where("month(usage_date) = 2").collect()))
    assert "dynamicpruning" in some._jdf.queryExecution().executedPlan().toString().lower()


def test_prices_of_few_versions_are_not_repeated(spark):
    usage, prices = _hot_case(spark)
    plain = spark.createDataFrame([(f"S{i}", T0, None, ((D(1),),)) for i in range(200)], PRICES)
    both = prices.unionByName(plain).withColumnRenamed("sku_name", "p_sku")
    _, p = billing._binned(usage, both, 512)
    versions = {r.p_sku: r["count"] for r in p.groupBy("p_sku").count().collect()}
    assert all(versions[f"S{i}"] == 1 for i in range(200)) and versions["A"] == 2
    assert versions["H"] <= 3 * 100


def test_stored_usage_is_not_shuffled(spark, tmp_path):
    usage, _ = _hot_case(spark)
    usage = usage.repartition(3)
    billing.write_usage(usage, str(tmp_path / "usage"))
    files = [f for f in os.listdir(tmp_path / "usage" / "usage_month=2024-02-01") if f.endswith(".parquet")]
    assert len(files) == 3  # one of each task
