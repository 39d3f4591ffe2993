"""Connected components of an edge table, without gathering edges anywhere.

Alternating large-star and small-star steps (Kiveris et al., 2014) turn any
graph into stars around each component's least node in a number of rounds that
grows with the logarithm of its size. Each step is a partial aggregation and a
join; a hub's edges are dealt over many tasks by the skew join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return (both.join(least, "a").where("b > a")
            .select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    return (down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .union(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct())


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def component_roots(edges: DataFrame) -> DataFrame:
    """``edges`` has columns ``a`` and ``b`` (long, no nulls). Returns ``node``, ``root``
    for each node that is not its component's least one. No edges give no rows."""
    now = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                 .where("a <> b").distinct(), "edges")
    mark = _mark(now)
    while mark[0]:
        after = stored(_small_star(_large_star(now)), "edges")
        seen, now = mark, after
        mark = _mark(now)
        if mark == seen:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
