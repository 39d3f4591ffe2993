"""Table sinks and catalog DDL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def _lit(s: str) -> str:
    """A SQL string literal with quotes and backslashes escaped."""
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def ensure_schema(spark: SparkSession, name: str) -> None:
    spark.sql(f"CREATE SCHEMA IF NOT EXISTS {name}")


def overwrite_table(df: DataFrame, name: str, partition_by: list[str] | None = None,
                    fmt: str = "parquet", path: str | None = None) -> None:
    """Full refresh, below ``path`` if given (else in the warehouse). Comments and properties do not survive it: re-apply them
    with :func:`apply_metadata` after every overwrite."""
    w = df.write.mode("overwrite").format(fmt)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if path:
        w = w.option("path", path)
    w.saveAsTable(name)


def apply_metadata(spark: SparkSession, table: str, meta: DataFrame, table_key: str | None = None) -> int:
    """Attach the table comment and every column comment from
    :func:`read_table_metadata` rows (filtered to ``table_key``, default the
    last part of ``table``). Returns the number of statements run."""
    key = table_key or table.split(".")[-1]
    rows = meta.filter(F.col("table") == key).collect()   # one row per column: small
    cols = {f.name.lower() for f in spark.table(table).schema.fields}
    n = 0
    for r in rows:
        if r.column is None and r.description is not None:
            spark.sql(f"COMMENT ON TABLE {table} IS {_lit(r.description)}")
            n += 1
        elif r.column is not None and r.column.lower() in cols:
            spark.sql(f"ALTER TABLE {table} ALTER COLUMN `{r.column}` COMMENT {_lit(r.comment or '')}")
            n += 1
    return n


def ensure_table_property(spark: SparkSession, table: str, key: str, value: str) -> bool:
    """Set a table property unless it already has that value; True when set."""
    props = spark.sql(f"SHOW TBLPROPERTIES {table}")
    if props.filter((F.col("key") == key) & (F.col("value") == value)).limit(1).count():
        return False
    spark.sql(f"ALTER TABLE {table} SET TBLPROPERTIES ({_lit(key)} = {_lit(value)})")
    return True
