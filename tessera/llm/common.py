"""Helpers shared by the document operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, shared_dir, ship_package

# ASCII white space of the word rule ``[^\x20\x09-\x0D]+``; ``bytes.split()``
# without arguments splits on exactly these six bytes.
WHITE = b" \t\n\x0b\x0c\r"


def prepare(spark: SparkSession) -> SparkSession:
    """Ship the package to the Python workers and register the shared folder."""
    ship_package(spark)
    ensure_checkpoint_dir(spark)
    return spark


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet below the shared folder and read it back.

    Later passes reuse the rows, an executor that is lost costs only its running
    tasks, and values that depend on the run (partition ids, random draws) are
    frozen at the moment they are written.
    """
    path = shared_dir(df.sparkSession, "llm", name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def utf8(col: Column | str) -> Column:
    """The text's UTF-8 bytes; a null text counts as empty."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit("")).cast("binary")


def held_out(id_col: str) -> Column:
    """Rows that no model may learn from: crc32 of the id as text leaves 2 modulo 4.
    A null id counts as the empty string."""
    return F.crc32(utf8(F.col(id_col).cast("string"))) % 4 == 2


def bounded_sample(df: DataFrame, group: str, id_col: str, size: int, seed: int) -> DataFrame:
    """At most ``size`` rows of each group, pseudo-random by the id and the same in every run.

    Groups are classes or languages, so their counts are a few rows. Of a large
    group only about twice as many rows as needed, those with the least hashes,
    go on to the exact cut; no task gets a whole group.
    """
    counts = df.groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
    draw = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(id_col)), 1) / float(1 << 63)
    near = (df.join(F.broadcast(counts), group).withColumn("_draw", draw)
            .where(F.col("_draw") <= 2.0 * size / F.col("_n") + 1e-9))
    by = Window.partitionBy(group).orderBy("_draw", id_col)
    return near.withColumn("_k", F.row_number().over(by)).where(F.col("_k") <= size).drop("_n", "_k")


def number_within(df: DataFrame, groups: list[str], salt: Column, order: list[Column],
                  out: str) -> DataFrame:
    """Add gapless positions from 0 within each group, splitting large groups.

    ``salt`` cuts a group into ordered blocks. Block sizes are counted with
    partial aggregation, their running sum gives each block its offset, and
    only the rows of one block are numbered in one window. ``df`` must return
    the same rows each time it is read (a stored table).
    """
    rows = df.withColumn("_salt", salt)
    sizes = rows.groupBy(*groups, "_salt").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*groups).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    block = Window.partitionBy(*groups, "_salt").orderBy(*order)
    return (rows.join(starts, [*groups, "_salt"])
            .withColumn(out, F.col("_start") + F.row_number().over(block) - 1)
            .drop("_salt", "_start"))
