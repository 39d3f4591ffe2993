"""Streaming queries: each runs an ``availableNow`` stream over the benchmark
tables into a folder below the shared checkpoint folder and returns the
result read back as a batch DataFrame."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import shared_dir, write_once
from ..sources.tables import load_table
from ..streaming import jobs
from ..operators.messages import END_OF_REQUEST
from ..operators.moderation import keyword_guard
from ..operators.retrieval import bucket_counts
from .catalog import ORACLES, register
from .doc_inputs import DOCS_SQL, chunks_sql, document_columns
from .message_inputs import agent_events, stream_events
from .retrieval_queries import embedding_sql, embedding_text
from .moderation_queries import CONVERSATION_VERDICT_SQL, GUARD_TERMS, _requests, conversation_requests


@register("stream_chunks", "WITH " + DOCS_SQL + "," + chunks_sql() + " SELECT * FROM chunks")
def q_stream_chunks(spark, sf_dir):
    # the table itself, be it one file or a folder of part files (a stream takes one file only by a pattern)
    base = sf_dir.rstrip("/")
    schema = spark.read.parquet(f"{base}/documents.parquet").schema
    src = spark.readStream.schema(schema).parquet(f"{base}/document[s].parquet")
    out, ckpt = shared_dir(spark, "stream_chunks", "out"), shared_dir(spark, "stream_chunks", "ckpt")
    jobs.run_to_completion(jobs.stream_chunks(document_columns(src).drop("doc_id"), out, ckpt))
    return spark.read.parquet(out)


@register("stream_chunks_continuous", ORACLES["stream_chunks"])
def q_stream_chunks_continuous(spark, sf_dir):
    """A source folder that grows in three steps while the query runs; it stops once all input is committed."""
    docs = document_columns(load_table(spark, sf_dir, "documents"))
    src, out, ckpt = (shared_dir(spark, "stream_chunks_continuous", x) for x in ("src", "out", "ckpt"))
    part = [docs.where(F.pmod(F.col("doc_id"), F.lit(3)) == k).drop("doc_id") for k in range(3)]
    part[0].write.parquet(src)
    query = jobs.stream_chunks(spark.readStream.schema(part[0].schema).parquet(src), out, ckpt, "continuous", "200 milliseconds")
    try:
        for more in part[1:]:
            more.write.mode("append").parquet(src)
        query.processAllAvailable()
    finally:
        query.stop()
    return spark.read.parquet(out)


def _replayed(spark, name, events, bounds, **options):
    """Replay ``events`` in as many streams as ``bounds`` cut them into (each goes on from the state of
    the one before), in the order of (conv, turn, sub)."""
    src, out, ckpt = (shared_dir(spark, name, x) for x in ("src", "out", "ckpt"))
    at = F.struct("conv", "turn", "sub")
    bound = [F.struct(*[F.lit(x).cast("bigint") for x in b]) for b in bounds]
    for lo, hi in zip([None, *bound], [*bound, None]):
        part = events.where((at >= lo if lo is not None else F.lit(True)) & (at < hi if hi is not None else F.lit(True)))
        part.write.mode("append").parquet(src)
        stream = spark.readStream.schema(part.schema).parquet(src)
        jobs.run_to_completion(jobs.merge_deltas_stream(stream, out, ckpt, "request_id", ["conv", "turn", "sub"], **options))
    return jobs.merged_items(spark, out)


def _delta_events(spark, sf_dir, request):
    """Stream events of all conversations with ``conv``, ``turn`` and ``sub`` as longs, and the greatest conversation."""
    ev = stream_events(spark, sf_dir).withColumn("conv", F.col("request_id").cast("bigint")) \
        .withColumn("turn", F.col("turn").cast("bigint")).withColumn("sub", F.col("sub").cast("bigint"))
    ev = write_once(ev.withColumn("request_id", request), "stream_events")
    return ev, ev.agg(F.max("conv").alias("n")).first()["n"] or 0


def _ends(ev):
    """The end of each request, after its last event."""
    last = ev.groupBy("request_id").agg(F.max(F.struct("conv", "turn", "sub")).alias("at"))
    none = F.lit(None).cast("string")
    ends = last.select("request_id", F.col("at.conv").alias("conv"), F.col("at.turn").alias("turn"), (F.col("at.sub") + 1).alias("sub"),
                       F.lit(END_OF_REQUEST).alias("type"), none.alias("item_id"), none.alias("delta"), none.alias("text"))
    return write_once(ends, "request_ends")  # read for every part


@register("merge_deltas_stream", """
SELECT conv_id AS request_id,
       CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS BIGINT) AS out_pos,
       CASE WHEN role = 'assistant' THEN 'delta' ELSE 'done' END AS kind,
       'item-' || conv_id || '-' || turn || CASE WHEN role = 'assistant' THEN '-0' ELSE '' END AS item_id,
       text
FROM conversations""")
def q_merge_deltas_stream(spark, sf_dir):
    """Three micro-batches that cut conversations within a turn; every request ends."""
    ev, n = _delta_events(spark, sf_dir, F.col("request_id").cast("bigint"))
    return _replayed(spark, "merge_deltas", ev.unionByName(_ends(ev)), [(n // 3, 1, 6), (2 * n // 3, 1, 8)])


# A third of the conversations are one request; runs go across their borders.
_HOT_SQL = """
WITH ev AS (SELECT CASE WHEN conv_id % 3 = 0 THEN 0 ELSE conv_id END AS request_id, conv_id, turn, role, text FROM conversations),
m AS (SELECT *, CASE WHEN role = 'assistant' AND lag(role) OVER (PARTITION BY request_id ORDER BY conv_id, turn) = 'assistant'
                THEN 0 ELSE 1 END AS fresh FROM ev),
r AS (SELECT *, sum(fresh) OVER (PARTITION BY request_id ORDER BY conv_id, turn) - 1 AS out_pos FROM m)
SELECT request_id, CAST(out_pos AS BIGINT) AS out_pos, CASE WHEN min(role) = 'assistant' THEN 'delta' ELSE 'done' END AS kind,
       arg_min('item-' || conv_id || '-' || turn || CASE WHEN role = 'assistant' THEN '-0' ELSE '' END, (conv_id, turn)) AS item_id,
       string_agg(text, '' ORDER BY conv_id, turn) AS text
FROM r GROUP BY request_id, out_pos"""


def _hot():
    return F.when(F.col("request_id") % 3 == 0, 0).otherwise(F.col("request_id")).cast("bigint")


@register("merge_deltas_hot", _HOT_SQL)
def q_merge_deltas_hot(spark, sf_dir):
    """One request holds a third of all events."""
    ev, n = _delta_events(spark, sf_dir, _hot())
    return _replayed(spark, "merge_deltas_hot", ev.unionByName(_ends(ev)), [(n // 2, 1, 4)])


@register("merge_deltas_timeout", _HOT_SQL)
def q_merge_deltas_timeout(spark, sf_dir):
    """No request ends: events are a second apart within a conversation, conversations a minute, and a
    last heartbeat an hour later moves the watermark beyond all open runs."""
    ev, n = _delta_events(spark, sf_dir, _hot())
    start = F.lit("2024-01-01 00:00:00").cast("timestamp")
    timed = ev.withColumn("at", F.timestamp_micros(F.unix_micros(start) + F.col("conv") * 60_000_000 + F.col("turn") * 1_000_000))
    none = F.lit(None).cast("string")
    tick = timed.groupBy().agg(F.max("at").alias("at")).where("at is not null").select(
        F.lit(-1).cast("bigint").alias("request_id"), F.lit(n + 1).cast("bigint").alias("conv"), F.lit(0).cast("bigint").alias("turn"),
        F.lit(0).cast("bigint").alias("sub"), F.lit("response.heartbeat").alias("type"), none.alias("item_id"), none.alias("delta"),
        none.alias("text"), (F.col("at") + F.expr("interval 1 hour")).alias("at"))
    # a run of the hot request stays open for three conversations at most: idle for ten minutes means abandoned
    return _replayed(spark, "merge_deltas_timeout", timed.unionByName(tick), [(n // 2, 1, 4), (n + 1, 0, 0)], time_col="at", idle_seconds=600)


@register("stream_filter_stream", ORACLES["stream_filter"])
def q_stream_filter_stream(spark, sf_dir):
    _, stream = jobs.stream_from_table(spark, agent_events(spark, sf_dir), "agent_events")
    out, ckpt = shared_dir(spark, "stream_filter", "out"), shared_dir(spark, "stream_filter", "ckpt")
    q = (jobs.filter_events_stream(stream).writeStream.format("parquet").option("path", out)
         .option("checkpointLocation", ckpt).trigger(availableNow=True).start())
    jobs.run_to_completion(q)
    return spark.read.parquet(out)


@register("moderate_stream", ORACLES["request_verdict"])
def q_moderate_stream(spark, sf_dir):
    _, stream = jobs.stream_from_table(spark, _requests(spark, sf_dir), "requests")
    out, ckpt = shared_dir(spark, "moderate", "out"), shared_dir(spark, "moderate", "ckpt")
    jobs.run_to_completion(jobs.moderate_stream(stream, keyword_guard({**GUARD_TERMS, "the": "S6"}), out, ckpt))
    return spark.read.parquet(out).drop("batch")


@register("moderate_stream_conversations", CONVERSATION_VERDICT_SQL)
def q_moderate_stream_conversations(spark, sf_dir):
    """Requests with all turns of their conversations, and malformed ones."""
    _, stream = jobs.stream_from_table(spark, conversation_requests(spark, sf_dir), "conversation_requests")
    out, ckpt = shared_dir(spark, "moderate_conversations", "out"), shared_dir(spark, "moderate_conversations", "ckpt")
    jobs.run_to_completion(jobs.moderate_stream(stream, keyword_guard(GUARD_TERMS), out, ckpt))
    return spark.read.parquet(out).drop("batch")


_REFRESHED_SQL = ("WITH " + DOCS_SQL.replace(
    "CAST(strlen(text) AS BIGINT) AS size, text",
    "CAST(strlen(CASE WHEN source = 'src7' THEN text || ' Revised.' WHEN source = 'src9' THEN '' ELSE text END) AS BIGINT) AS size, "
    "CASE WHEN source = 'src7' THEN text || ' Revised.' WHEN source = 'src9' THEN '' ELSE text END AS text")
    + "," + chunks_sql())


@register("refresh_chunks", _REFRESHED_SQL + " SELECT id, doc_uri, size, content FROM chunks")
def q_refresh_chunks(spark, sf_dir):
    """All documents, then those of src7 again with a sentence more and those of src9 blank.
    Either batch also holds an older version of the documents of src7 and src9."""
    d = load_table(spark, sf_dir, "documents")
    base = document_columns(d).drop("doc_id")
    changed = document_columns(
        d.filter(F.col("source").isin("src7", "src9"))
        .withColumn("text", F.when(F.col("source") == "src7", F.concat("text", F.lit(" Revised."))).otherwise(F.lit("")))).drop("doc_id")
    src, out, ckpt = (shared_dir(spark, "refresh_chunks", x) for x in ("src", "out", "ckpt"))
    again = document_columns(d.filter(F.col("source").isin("src7", "src9"))).drop("doc_id")
    older = document_columns(d.filter(F.col("source").isin("src7", "src9")).withColumn("text", F.lit("Draft."))).drop("doc_id")
    for number, (docs, old) in enumerate(((base, older), (changed, again)), 1):
        both = docs.withColumn("version", F.lit(2 * number)).unionByName(old.withColumn("version", F.lit(2 * number - 1)))
        both.write.mode("append").parquet(src)
        stream = spark.readStream.schema(both.schema).parquet(src)
        jobs.run_to_completion(jobs.refresh_chunks(stream, out, ckpt))
    return jobs.current_chunks(spark, out).select("id", "doc_uri", "size", "content")


@register("refresh_index", _REFRESHED_SQL.replace("FROM documents)", "FROM documents WHERE source <> 'src3')")
          + embedding_sql("chunks") + "SELECT id, doc_uri, embedding FROM embedded")
def q_refresh_index(spark, sf_dir):
    """The embedded chunks after three streams: all documents; those of src7 with a sentence more
    and of src9 blank; those of src3 deleted. The table is compacted after the first
    two, so the result comes from a compacted version, which has been compacted again, and a batch."""
    d = load_table(spark, sf_dir, "documents")
    text = (F.when(F.col("source") == "src7", F.concat("text", F.lit(" Revised.")))
            .when(F.col("source") == "src9", F.lit("")).otherwise(F.col("text")))
    src, out, ckpt = (shared_dir(spark, "refresh_index", x) for x in ("src", "out", "ckpt"))
    steps = [(d, False), (d.filter(F.col("source").isin("src7", "src9")).withColumn("text", text), False),
             (d.filter(F.col("source") == "src3"), True)]
    for version, (rows, deleted) in enumerate(steps):
        docs = document_columns(rows).drop("doc_id").withColumn("version", F.lit(version)).withColumn("deleted", F.lit(deleted))
        docs.write.mode("append").parquet(src)
        stream = spark.readStream.schema(docs.schema).parquet(src)
        jobs.run_to_completion(jobs.refresh_chunks(stream, out, ckpt, embed_fn=bucket_counts, deleted_col="deleted"))
        if not deleted:
            jobs.compact_chunks(spark, out)
    return jobs.current_chunks(spark, out).select("id", "doc_uri", embedding_text("embedding").alias("embedding"))
