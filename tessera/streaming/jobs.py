"""Streaming jobs.

* :func:`stream_chunks` - chunks of new files, appended (S1/S2); :func:`refresh_chunks`
  replaces the chunks (and embeddings, V6) of documents that come again (S1),
  :func:`compact_chunks` folds its batches into one committed version.
* :func:`merge_deltas_stream` - delta merging, each micro-batch as a batch job with
  a small state table of open runs and next positions, and event-time timers (S3).
* :func:`filter_events_stream` - stateless event filter (S4).
* :func:`moderate_stream` - moderation of request rows through
  ``foreachBatch``: each micro-batch runs the batch jobs unchanged (S5).

Sinks write below the shared checkpoint folder (``spark.checkpoint.dir``), and
every query keeps its checkpoint there, so a restarted query resumes where it
stopped.
"""

from __future__ import annotations

import datetime
import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..operators.chunking import chunk_documents
from ..operators.joins import shipped
from ..operators.messages import END_OF_REQUEST, delta_state_schema, filter_stream_events, merge_deltas_step
from ..operators.moderation import explode_requests, verdict
from ..operators.retrieval import embed
from ..session import shared_dir

def _trigger(writer, trigger: str, interval: str = "1 second"):
    if trigger == "available_now":
        return writer.trigger(availableNow=True)
    if trigger == "continuous":
        return writer.trigger(processingTime=interval)
    raise ValueError("trigger must be 'available_now' or 'continuous'")


def stream_chunks(docs_stream: DataFrame, out_path: str, checkpoint: str, trigger: str = "available_now",
                  interval: str = "1 second", **chunk_args):
    """Chunk every new document of a streaming ``(doc_name, doc_uri, size, text)``
    source and append to a parquet folder (the file sink's log makes each
    micro-batch commit once). Returns the started query."""
    chunks = chunk_documents(docs_stream, **chunk_args)
    w = chunks.writeStream.format("parquet").option("path", out_path).option("checkpointLocation", checkpoint)
    return _trigger(w, trigger, interval).start()


def latest_versions(docs: DataFrame, version_col: str = "version") -> DataFrame:
    """The newest row of each ``doc_uri``; of equal versions the one with the greatest hash of its
    columns, so that every run keeps the same. Rows without a ``doc_uri`` all stay.

    Only keys and hashes are shuffled to find the documents that come more than
    once; they are few as a rule, and are then broadcast to the rows.
    """
    columns = docs.columns
    keyed = docs.withColumn("_key", F.struct(F.col(version_col).alias("v"), F.sha2(F.to_json(F.struct(*columns)), 256).alias("h")))
    often = (keyed.where(F.col("doc_uri").isNotNull()).groupBy("doc_uri")
             .agg(F.max("_key").alias("_top"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n"))
    marked = keyed.join(shipped(often, "often"), "doc_uri", "left").select(*columns, "_key", "_top")
    one = Window.partitionBy("doc_uri").orderBy("_key")  # rows that equal each other in all columns
    newest = (marked.where(F.col("_top").isNotNull() & F.col("_key").eqNullSafe(F.col("_top")))
              .withColumn("_row", F.row_number().over(one)).where("_row = 1"))
    return marked.where(F.col("_top").isNull()).select(*columns).unionByName(newest.select(*columns))


def refresh_chunks(docs_stream: DataFrame, path: str, checkpoint: str, trigger: str = "available_now",
                   interval: str = "1 second", version_col: str = "version", embed_fn: Callable | None = None,
                   deleted_col: str | None = None, compact_every: int = 0, **chunk_args):
    """Chunk every new or changed document and replace what the table had of it.

    Each micro-batch writes its chunks and the list of its documents below its
    own ``batch=<id>`` folder (a replayed batch rewrites it); :func:`current_chunks`
    reads, for each document, the chunks of its newest version. Nothing already
    written is rewritten, so a batch costs as much as its documents.
    ``version_col`` (a modification time or sequence number) orders the versions of
    a document, in one batch or in many; a null is older than any other, and of
    equal versions the later batch counts. With ``embed_fn`` (as of
    :func:`~tessera.operators.retrieval.embed`) the chunks carry their embeddings, so the
    table is the vector index's source and only changed documents are embedded. A
    row whose ``deleted_col`` is true takes its document out. After every
    ``compact_every`` batches the table is compacted. Returns the started query.
    """
    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        docs = latest_versions(batch, version_col)
        live = docs.where(~F.coalesce(F.col(deleted_col), F.lit(False))).drop(deleted_col) if deleted_col else docs
        chunks = chunk_documents(live, **chunk_args)
        if embed_fn is not None:
            chunks = embed(chunks, "content", embed_fn)
        chunks.write.mode("overwrite").parquet(f"{path}/chunks/batch={batch_id}")
        # the list comes last: a batch is visible once its list is complete
        docs.select("doc_uri", F.col(version_col).alias("version")).write.mode("overwrite").parquet(f"{path}/docs/batch={batch_id}")
        if compact_every and (batch_id + 1) % compact_every == 0:
            compact_chunks(spark, path)

    w = docs_stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return _trigger(w, trigger, interval).start()


def _folder(spark: SparkSession, path: str):
    """(file system, path) of a folder on whatever store it is."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _numbers(spark: SparkSession, path: str, name: str) -> list[int]:
    """The numbers of the complete ``name=<n>`` folders below ``path``."""
    fs, p = _folder(spark, path)
    if not fs.exists(p):
        return []
    found = [str(x.getPath().getName()) for x in fs.listStatus(p)]
    done = [int(x.split("=")[1]) for x in found if x.startswith(f"{name}=")]
    return sorted(n for n in done if fs.exists(_folder(spark, f"{path}/{name}={n}/_SUCCESS")[1]))


def _state(spark: SparkSession, path: str) -> tuple[int, int, list[int]]:
    """(version, last batch in it, batches that came later); version 0 is the empty table."""
    versions = _numbers(spark, f"{path}/versions", "v")
    version = versions[-1] if versions else 0
    last = spark.read.parquet(f"{path}/versions/v={version}").first()["last_batch"] if version else -1
    return version, last, [n for n in _numbers(spark, f"{path}/docs", "batch") if n > last]


def _parts(spark: SparkSession, path: str, name: str, version: int, batches: list[int]) -> DataFrame | None:
    """The rows of ``name`` in the version's folder and in the batches after it, with their ``batch``."""
    parts = [spark.read.parquet(f"{path}/compact/v={version}/{name}")] if version else []
    if batches:
        folders = [f"{path}/{name}/batch={n}" for n in batches]
        parts.append(spark.read.option("basePath", f"{path}/{name}").parquet(*folders).withColumn("batch", F.col("batch").cast("long")))
    return parts[0].unionByName(parts[-1]) if len(parts) == 2 else parts[0] if parts else None


def _current(spark: SparkSession, path: str, version: int, batches: list[int]) -> tuple[DataFrame, DataFrame]:
    """(chunks, list of documents) as they stand, with their ``batch``."""
    docs = _parts(spark, path, "docs", version, batches).select("doc_uri", "version", "batch")
    last = docs.groupBy("doc_uri").agg(F.max(F.struct("version", "batch")).alias("top")).select("doc_uri", "top.version", "top.batch")
    chunks = _parts(spark, path, "chunks", version, batches)
    # what is out of date is little as a rule: the chunks stay where they are
    old = (docs.join(last.withColumnRenamed("batch", "_last").drop("version"), "doc_uri").where("batch <> _last")
           .select("doc_uri", "batch").distinct())
    return chunks.join(shipped(old, "outdated"), ["doc_uri", "batch"], "left_anti").select(*chunks.columns), last


def current_chunks(spark: SparkSession, path: str) -> DataFrame:
    """The table that :func:`refresh_chunks` keeps: each document's latest chunks. A
    document whose latest text is blank, or that was deleted, has none. Documents
    without a ``doc_uri`` replace nothing and keep all their chunks."""
    version, _, batches = _state(spark, path)
    if not version and not batches:
        raise ValueError(f"no batch has been written below {path}")
    return _current(spark, path, version, batches)[0].drop("batch")


def compact_chunks(spark: SparkSession, path: str) -> int:
    """Write the table as it stands as one folder, commit it by a version file, and delete what the
    version before it had replaced (readers of that version can finish). Returns
    the version. Run one compaction at a time; batches may go on meanwhile."""
    version, last, batches = _state(spark, path)
    if not batches:
        return version
    chunks, docs = _current(spark, path, version, batches)
    new = f"{path}/compact/v={version + 1}"
    chunks.write.mode("overwrite").parquet(f"{new}/chunks")
    docs.write.mode("overwrite").parquet(f"{new}/docs")
    spark.createDataFrame([(batches[-1],)], "last_batch long").coalesce(1).write.mode("overwrite").parquet(f"{path}/versions/v={version + 1}")
    old = [f"{path}/{name}/batch={n}" for name in ("chunks", "docs") for n in _numbers(spark, f"{path}/docs", "batch") if n <= last]
    for gone in [*old, f"{path}/compact/v={version - 1}"]:
        fs, p = _folder(spark, gone)
        fs.delete(p, True)
    return version + 1


def merge_deltas_stream(events: DataFrame, path: str, checkpoint: str, key: str = "request_id", order_cols: list[str] | None = None,
                        trigger: str = "available_now", interval: str = "1 second", time_col: str | None = None,
                        idle_seconds: float | None = None, delay_seconds: float = 0.0):
    """Streaming form of :func:`~tessera.operators.messages.merge_deltas`: items are written below
    ``path/items``, see :func:`merged_items`. Returns the started query.

    Events of one request must arrive in order across micro-batches; inside a
    micro-batch they are sorted by ``order_cols``. Each micro-batch is a batch job over
    range partitions, so a request that holds most events is spread over all tasks;
    carried between batches is a table with a row per request: its next position
    and its open run. A run closes on a done item, on ``response.completed``, or, with
    ``idle_seconds``, once the watermark (the greatest ``time_col`` of all events so far, less
    ``delay_seconds``) is that much after the request's last event; the next position
    stays until ``response.completed``, so events that come later go on from it. A
    replayed batch starts from the state before it and rewrites its items.
    """
    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        done = [n for n in _numbers(spark, f"{path}/state", "batch") if n < batch_id]
        schema = delta_state_schema(batch, key)
        state = spark.read.schema(schema).parquet(f"{path}/state/batch={done[-1]}") if done else spark.createDataFrame([], schema)
        latest = batch.agg(F.max(time_col)).first()[0] if time_col else None
        if time_col and done:
            before = spark.read.parquet(f"{path}/clock/batch={done[-1]}").first()["latest"]
            latest = max((x for x in (latest, before) if x is not None), default=None)
        watermark = latest - datetime.timedelta(seconds=delay_seconds) if latest is not None else None
        items, new = merge_deltas_step(batch, state, key, order_cols, time_col, watermark, idle_seconds)
        items.write.mode("overwrite").parquet(f"{path}/items/batch={batch_id}")
        spark.createDataFrame([(latest,)], "latest timestamp").coalesce(1).write.mode("overwrite").parquet(f"{path}/clock/batch={batch_id}")
        # the state comes last: a batch counts once its state is complete
        new.write.mode("overwrite").parquet(f"{path}/state/batch={batch_id}")
        for n in done[:-1]:
            for name in ("state", "clock"):
                fs, p = _folder(spark, f"{path}/{name}/batch={n}")
                fs.delete(p, True)

    return _trigger(events.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint), trigger, interval).start()


def merged_items(spark: SparkSession, path: str) -> DataFrame:
    """The items that :func:`merge_deltas_stream` has closed so far."""
    return spark.read.parquet(f"{path}/items").drop("batch")


def filter_events_stream(events: DataFrame, answer_node: str = "response_agent") -> DataFrame:
    """Stateless: the batch filter applies to a stream as is."""
    return filter_stream_events(events, answer_node)


def moderate_stream(requests: DataFrame, model: Callable, out_path: str, checkpoint: str,
                    trigger: str = "available_now", id_col: str = "conv_id", request_col: str = "request",
                    **verdict_args):
    """Moderate a stream of request rows: each micro-batch runs the batch
    :func:`~tessera.operators.moderation.verdict` job and overwrites its own
    ``batch=<id>`` folder, so a replayed batch rewrites instead of duplicating."""
    def run(batch: DataFrame, batch_id: int) -> None:
        v = verdict(explode_requests(batch, id_col, request_col), model, **verdict_args)
        v.write.mode("overwrite").parquet(os.path.join(out_path, f"batch={batch_id}"))

    w = requests.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return _trigger(w, trigger).start()


def run_to_completion(query) -> None:
    """Wait until an ``availableNow`` query has read all its input, however long that
    takes; raise its error if it failed. The caller may stop the query."""
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()


def stream_from_table(spark: SparkSession, df: DataFrame, name: str, partitions: int | None = None) -> tuple[str, object]:
    """Write a DataFrame once below the shared folder and return a file-stream
    reader over it (used to replay derived data as a stream)."""
    path = shared_dir(spark, "streams", name)
    (df.repartition(partitions) if partitions else df).write.parquet(path)
    return path, spark.readStream.schema(df.schema).parquet(path)
