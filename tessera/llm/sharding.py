"""Uniform shuffle of a table into shards of exact sizes.

A random permutation of all rows is drawn in two local steps. How many rows each
input partition sends to each shard follows a multivariate hypergeometric law:
the matrix of counts is drawn exactly on the driver, its row sums being the
partition sizes and its column sums the shard sizes. Each partition then deals
its own rows in random order by its row of the matrix, the rows are exchanged,
and each shard is put into random order again.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import number_within, prepare, stored, utf8

#: Rows of a shard that one window numbers, and the least number of such blocks.
BLOCK_ROWS, LEAST_BLOCKS = 100_000, 16


def communication_matrix(partition_rows: np.ndarray, shard_rows: np.ndarray, seed: int) -> np.ndarray:
    """Counts of rows from each partition (row) to each shard (column), drawn from
    the law that a uniform permutation of all rows has. Sums are exact."""
    rng = np.random.default_rng(seed)
    left = np.array(shard_rows, dtype=np.int64)
    out = np.zeros((len(partition_rows), len(left)), dtype=np.int64)
    for k, n in enumerate(partition_rows):
        # column by column, so that totals beyond numpy's multivariate limit work
        need, rest = int(n), int(left.sum())
        for s, room in enumerate(left):
            rest -= int(room)
            take = min(need, int(room)) if rest == 0 else _draw(rng, int(room), rest, need)
            out[k, s] = take
            need -= take
        left -= out[k]
    return out


def _draw(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """One hypergeometric count. Beyond the range of numpy's generator (a billion
    rows on a side) a ratio-of-uniforms rejection from the same law is used."""
    if n == 0 or good == 0:
        return 0
    if max(good, bad) < 10**9:
        return int(rng.hypergeometric(good, bad, n))
    total, low, high = good + bad, max(0, n - bad), min(n, good)
    mean = n * good / total
    spread = math.sqrt(mean * (bad / total) * ((total - n) / (total - 1)) + 0.5)
    width = math.sqrt(8 / math.e) * spread + 3 - 2 * math.sqrt(3 / math.e)

    def weight(k: int) -> float:
        return -sum(map(math.lgamma, (k + 1, good - k + 1, n - k + 1, bad - n + k + 1)))

    top = weight((n + 1) * (good + 1) // (total + 2))
    while True:
        u, v = rng.random(2)
        k = math.floor(mean + 0.5 + width * (v - 0.5) / u)
        if low <= k <= high and 2 * math.log(u) <= weight(k) - top:
            return k


def shard_rows(total: int, shards: int) -> np.ndarray:
    """Shard sizes that differ by one row at most."""
    return total // shards + (np.arange(shards) < total % shards)


def shuffle_into_shards(rows: DataFrame, shards: int, seed: int = 0) -> DataFrame:
    """Add ``shard`` (0 to shards - 1) and ``slot`` (gapless from 0 in each shard).

    Each placement of the rows into shards of sizes at most one apart, and each
    order within a shard, is equally likely. All rows take part: rows with null
    columns and repeated rows are rows like any other, and an empty table gives
    an empty result. ``rows`` is written to the shared folder first, so keep it
    narrow (ids and sizes, not texts). Its columns may have any names but those
    starting with ``_``; columns named ``shard`` or ``slot`` are replaced. Only
    partition sizes and the matrix reach the driver.
    """
    spark = prepare(rows.sparkSession)
    kept = stored(rows.drop("shard", "slot").withColumn("_part", F.spark_partition_id())
                  .withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))),
                  "sharding")
    sizes = sorted((r["_part"], r["count"]) for r in kept.groupBy("_part").count().collect())
    total = sum(n for _, n in sizes)
    matrix = communication_matrix(np.array([n for _, n in sizes], dtype=np.int64), shard_rows(total, shards), seed)
    plan = spark.sparkContext.broadcast({p: m.astype(np.int64) for (p, _), m in zip(sizes, matrix, strict=True)})

    def deal(batches):
        dealt: dict[int, np.ndarray] = {}
        for b in batches:
            part, at = b.column("_part").to_numpy(), b.column("_at").to_numpy()
            shard = np.empty(len(part), dtype=np.int32)
            for p in np.unique(part):
                if p not in dealt:
                    counts = plan.value[int(p)]
                    dealt = {p: np.random.default_rng([seed, int(p)]).permutation(
                        np.repeat(np.arange(shards, dtype=np.int32), counts))}
                own = part == p
                shard[own] = dealt[p][at[own]]
            yield b.append_column("shard", pa.array(shard, pa.int32()))

    schema = T.StructType([*kept.schema.fields, T.StructField("shard", T.IntegerType())])
    out = (kept.mapInArrow(deal, schema)
           .withColumn("_key", F.xxhash64(F.lit(seed), "_part", "_at")))
    blocks = max(LEAST_BLOCKS, total // (shards * BLOCK_ROWS))
    numbered = number_within(out, ["shard"], F.pmod(F.col("_key"), F.lit(blocks)),
                             [F.col("_key"), F.col("_part"), F.col("_at")], "slot")
    return numbered.drop("_part", "_at", "_key")


def document_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's id, size (UTF-8 bytes, none for a null text, plus 8) and text checksum."""
    return docs.select(F.col(id_col).alias("doc_id"),
                       (F.octet_length(utf8(text_col)) + 8).cast("long").alias("size"),
                       F.crc32(utf8(text_col)).alias("text_crc32"))


def shard_documents(docs: DataFrame, shards: int = 24, seed: int = 0) -> DataFrame:
    """Digest rows of all documents with their shard and slot; law ``rows``: shard
    counts are at most one apart. Equal texts are not held together: the method
    places each row on its own."""
    placed = shuffle_into_shards(document_rows(docs), shards, seed)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard",
                         F.col("slot").cast("long"), F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, placed: DataFrame, path: str, id_col: str = "doc_id") -> None:
    """Write the documents themselves, one folder per shard. Ids must be unique."""
    places = placed.select(F.col("doc_id").alias(id_col), "shard", "slot")
    (docs.join(places, id_col).repartition("shard", F.floor(F.col("slot") / BLOCK_ROWS))
     .sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path))
