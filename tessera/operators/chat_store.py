"""Stored chat tables whose joins and lookups need no exchange, and changes written back.

Chats, messages and attachments are tables of the session's catalog, all bucketed by
the chat, with the same number of buckets, sorted by chat and time, and below folders of
``part``, a hash of the chat. Joins and counts by chat read matching buckets, a
lookup of one chat reads one bucket of one folder, and a change rewrites only the
folders of the chats that it touches (dynamic partition overwrite).

A chat is one bucket, so one with a large share of all messages is read by one task (as
a stream, in order); :func:`~tessera.operators.chats.chat_with_messages` over plain tables spreads it.
"""

from __future__ import annotations

from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..session import write_once
from . import chats as ch

KEYS = {"chats": "id", "messages": "chat_id", "attachments": "chat_id"}
SORTED = {"chats": ["id"], "messages": ["chat_id", "created_at", "id"], "attachments": ["chat_id", "message_id", "id"]}


@dataclass(frozen=True)
class ChatStore:
    """Tables ``<name>_chats``, ``<name>_messages`` and ``<name>_attachments`` below ``path``."""

    name: str
    path: str
    parts: int = 16
    buckets: int = 8

    def table(self, spark: SparkSession, kind: str) -> DataFrame:
        return spark.table(f"{self.name}_{kind}").drop("part")

    def part(self, key: str | Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.parts)).cast("int")

    def of_parts(self, spark: SparkSession, kind: str, parts: list[int]) -> DataFrame:
        return spark.table(f"{self.name}_{kind}").where(F.col("part").isin(parts))


def create_store(name: str, path: str, chats: DataFrame, msgs: DataFrame, atts: DataFrame, parts: int = 16,
                 buckets: int = 8) -> ChatStore:
    """Store the three tables. Attachments get the chat of their message; those of unknown
    messages have none (null) and stay in the table."""
    store = ChatStore(name, path, parts, buckets)
    owner = msgs.select(F.col("id").alias("message_id"), "chat_id")
    for kind, df in (("chats", chats), ("messages", msgs), ("attachments", atts.join(owner, "message_id", "left"))):
        key = KEYS[kind]
        # dealt by the bucket's own hash: each task writes one bucket, one file a folder
        (df.withColumn("part", F.coalesce(store.part(key), F.lit(0))).repartition(buckets, key)
         .write.mode("overwrite").format("parquet").partitionBy("part").bucketBy(buckets, key).sortBy(*SORTED[kind])
         .option("path", f"{path}/{kind}").saveAsTable(f"{name}_{kind}"))
    return store


# ------------------------------------------------------------------- reading

def message_counts(spark: SparkSession, store: ChatStore) -> DataFrame:
    return ch.message_counts(store.table(spark, "chats"), store.table(spark, "messages"))


def ordered_messages(spark: SparkSession, store: ChatStore, chat_id=None) -> DataFrame:
    """Messages with their place in their chat, oldest first (tie: lower id): ``(chat_id, msg_pos, id,
    role, content, created_at)``. Of one chat, from one bucket of one folder, if ``chat_id`` is given."""
    m = spark.table(f"{store.name}_messages")
    if chat_id is not None:
        m = m.where((F.col("part") == store.part(F.lit(chat_id).cast(m.schema["chat_id"].dataType))) & (F.col("chat_id") == F.lit(chat_id)))
    w = Window.partitionBy("chat_id").orderBy("created_at", "id")
    return m.select("chat_id", (F.row_number().over(w) - 1).cast("bigint").alias("msg_pos"), "id", "role", "content", "created_at")


def chat_rows(spark: SparkSession, store: ChatStore) -> DataFrame:
    """The rows of :func:`~tessera.operators.chats.chat_with_messages`: chats and messages meet bucket by bucket.
    So do their attachments, whose key begins with the chat, in a session with
    ``spark.sql.requireAllClusterKeysForCoPartition=false``; else that join deals both sides by (chat, message)."""
    chats = store.table(spark, "chats").select(F.col("id").alias("chat_id"))
    m = ordered_messages(spark, store).withColumnRenamed("id", "message_id")
    w = Window.partitionBy("chat_id", "message_id").orderBy("attachment_id")
    a = store.table(spark, "attachments").select("chat_id", "message_id", F.col("id").alias("attachment_id"), "filename", "stored_filename",
                                                 "file_type")
    a = a.withColumn("att_pos", (F.row_number().over(w) - 1).cast("bigint"))
    return (chats.join(m, "chat_id", "left").join(a, ["chat_id", "message_id"], "left")
            .select("chat_id", "msg_pos", "message_id", "role", "content", "created_at", "att_pos", "attachment_id", "filename",
                    "stored_filename", "file_type"))


# ------------------------------------------------------------------- changes

@contextmanager
def _dynamic(spark: SparkSession):
    name = "spark.sql.sources.partitionOverwriteMode"
    before = spark.conf.get(name)
    spark.conf.set(name, "dynamic")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _touched(store: ChatStore, keys: DataFrame, key: str) -> list[int]:
    """The folders of the keys (at most ``parts`` numbers)."""
    return sorted(r.p for r in keys.select(store.part(key).alias("p")).where("p is not null").distinct().collect())


def _put(spark: SparkSession, store: ChatStore, kind: str, parts: list[int], rows: DataFrame) -> None:
    """Replace the given folders of a table by ``rows``, which are all of theirs."""
    table = f"{store.name}_{kind}"
    new = write_once(rows.select(*spark.table(table).columns), "chat_rows")  # the folders are read until here
    with _dynamic(spark):
        new.repartition(store.buckets, KEYS[kind]).write.mode("overwrite").insertInto(table)
    left = {r.part for r in new.select("part").distinct().collect()}
    for p in parts:
        if p not in left:  # no row is left, and an overwrite leaves such folders alone
            folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{store.path}/{kind}/part={p}")
            folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
    spark.catalog.refreshTable(table)


def append(spark: SparkSession, store: ChatStore, new: DataFrame, order: list[str]) -> None:
    """Add ``new`` messages (see :func:`~tessera.operators.chats.append_messages`): files are added to the folders of
    their chats, and those chats' folders are written with the new ``updated_at``."""
    known = write_once(new.join(store.table(spark, "chats").select(F.col("id").alias("chat_id")), "chat_id", "left_semi"), "new_messages")
    parts = _touched(store, known, "chat_id")
    if not parts:
        return
    table = f"{store.name}_messages"
    rows = ch.numbered_after(spark.table(table), known, order).withColumn("part", store.part("chat_id"))
    write_once(rows.select(*spark.table(table).columns), "chat_rows").repartition(store.buckets, "chat_id") \
        .write.mode("append").insertInto(table)
    spark.catalog.refreshTable(table)
    _put(spark, store, "chats", parts, ch.apply_messages(store.of_parts(spark, "chats", parts), known))


def rename(spark: SparkSession, store: ChatStore, updates: DataFrame) -> None:
    """Apply title updates (see :func:`~tessera.operators.chats.apply_titles`) to the folders of their chats."""
    parts = _touched(store, updates, "chat_id")
    if parts:
        _put(spark, store, "chats", parts, ch.apply_titles(store.of_parts(spark, "chats", parts), updates))


def delete(spark: SparkSession, store: ChatStore, deleted: DataFrame) -> None:
    """Take the chats of ``deleted`` (column ``id``) out, with their messages and attachments."""
    gone = write_once(deleted.select("id").distinct(), "deleted_chats")
    parts = _touched(store, gone, "id")
    for kind in ("attachments", "messages", "chats") if parts else ():
        key = KEYS[kind]
        rows = store.of_parts(spark, kind, parts)
        _put(spark, store, kind, parts, rows.join(gone.withColumnRenamed("id", "_gone"), F.col(key) == F.col("_gone"), "left_anti"))


def drop_store(spark: SparkSession, store: ChatStore) -> None:
    """Take the tables out of the catalog (their files stay)."""
    for kind in KEYS:
        spark.sql(f"DROP TABLE IF EXISTS {store.name}_{kind}")
