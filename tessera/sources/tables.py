"""Benchmark table scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()

# Tables whose rows carry real per-row work (text, vectors) or volume. Dimension
# tables (region, nation, supplier, labels, benchmark) are left as scanned.
LARGE = {"customer", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages",
         "conversations"}


def spread(df: DataFrame) -> DataFrame:
    """Round-robin the rows over the default parallelism when the scan itself has
    fewer partitions than that (a small table in one row group is read by one
    task however many cores there are). A scan with enough splits, as of any
    large table, is returned as is, however few files it has."""
    par = df.sparkSession.sparkContext.defaultParallelism
    # asked from the JVM's own plan; df.rdd would plan the scan again, for Python
    splits = df._jdf.queryExecution().toRdd().getNumPartitions()
    return df.repartition(par) if splits < par else df


def load_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Parquet scan of one table; Catalyst prunes columns and pushes filters
    through the round-robin exchange into the scan."""
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return spread(df) if name in LARGE else df
