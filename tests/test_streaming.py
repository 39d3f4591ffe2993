import datetime
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import messages as msg
from tessera.operators import moderation as mod
from tessera.session import shared_dir
from tessera.streaming import jobs


def _stream_of(spark, df, name, parts=2):
    path, stream = jobs.stream_from_table(spark, df, name, parts)
    return stream


def test_continuous_chunk_refresh(spark):
    docs = spark.createDataFrame([("a.txt", "/v/a.txt", 3, "x" * 700), ("b.txt", "/v/b.txt", 1, "y")],
                                 "doc_name string, doc_uri string, size bigint, text string")
    src = _stream_of(spark, docs, "docs")
    out, ckpt = shared_dir(spark, "t", "out"), shared_dir(spark, "t", "ckpt")
    q = jobs.stream_chunks(src, out, ckpt, trigger="continuous", interval="200 milliseconds")
    q.processAllAvailable()
    q.stop()
    assert spark.read.parquet(out).count() == 4  # ceil(700/342) + 1


def test_filter_stream_equals_batch(spark):
    ev = spark.createDataFrame([("updates", "search", "assistant", "u1", None),
                                ("updates", "response_agent", "assistant", "u2", None),
                                ("messages", "response_agent", "assistant", "m1", None),
                                ("messages", "search", "assistant", "m3", None)],
                               "mode string, node string, role string, content string, tool_calls string")
    q = (jobs.filter_events_stream(_stream_of(spark, ev, "ev")).writeStream.format("memory")
         .queryName("filtered_events").trigger(availableNow=True).start())
    jobs.run_to_completion(q)
    got = sorted(r.content for r in spark.table("filtered_events").collect())
    assert got == sorted(r.content for r in msg.filter_stream_events(ev).collect())


def test_moderate_stream_equals_batch(spark):
    convs = {1: [{"role": "user", "content": "a bomb"}], 2: [{"role": "user", "content": "hi"},
                                                            {"role": "assistant", "content": "yo"}],
             3: [{"role": "assistant", "content": "x"}]}
    reqs = spark.createDataFrame([(k, json.dumps({"messages": v})) for k, v in convs.items()],
                                 "conv_id long, request string")
    model = mod.keyword_guard({"bomb": "S9"})
    out, ckpt = shared_dir(spark, "mod", "out"), shared_dir(spark, "mod", "ckpt")
    jobs.run_to_completion(jobs.moderate_stream(_stream_of(spark, reqs, "reqs", 3), model, out, ckpt))
    got = sorted(tuple(r) for r in spark.read.parquet(out).select("conv_id", "decision", "reject_reason",
                                                                   "reject_message").collect())
    exp = sorted(tuple(r) for r in mod.verdict(mod.explode_requests(reqs), model).collect())
    assert got == exp and len(got) == 3


DELTA, DONE, BEAT, END = msg.TEXT_DELTA, msg.ITEM_DONE, "response.heartbeat", msg.END_OF_REQUEST
EVENTS = "request_id long, seq long, type string, item_id string, delta string, text string, at timestamp"


def plain_merge(parts, idle=None):
    """The items of a stream's parts, event by event."""
    out, state, clock = [], {}, None
    for part in parts:
        ended = set()
        for req, _, kind, item, delta, text, at in sorted(part, key=lambda e: e[1]):
            clock = at if clock is None or at > clock else clock
            if kind == BEAT:
                continue
            pos, run, last = state.get(req, (0, None, at))
            if kind == DELTA:
                run = (run[0], run[1] + delta) if run else (item, delta)
            else:
                if run:
                    out.append((req, pos, "delta", *run))
                    pos, run = pos + 1, None
                if kind == DONE:
                    out.append((req, pos, "done", item, text))
                    pos += 1
                else:
                    ended.add(req)
            state[req] = (pos, run, max(last, at))
        for req in list(state):
            pos, run, last = state[req]
            if run and (req in ended or idle and (clock - last).total_seconds() >= idle):
                out.append((req, pos, "delta", *run))
                state[req] = (pos + 1, None, last)
            if req in ended:
                del state[req]
    return sorted(out), {req: (pos, run) for req, (pos, run, _) in state.items()}


@pytest.mark.parametrize("idle", [None, 100])
def test_merge_deltas_stream_matches_brute_force(spark, idle):
    rng, parts, seq = random.Random(7), [], 0
    start = datetime.datetime(2024, 1, 1)
    for k in range(4):
        part = []
        for _ in range(rng.choice([0, 25, 60])):
            seq += 1
            kind = rng.choices([DELTA, DONE, BEAT, END], [10, 3, 1, 0.7])[0]
            req = rng.choice([0, 0, 0, 1, 2, 3, 4])
            part.append((req, seq, kind, f"i{seq}" if kind in (DELTA, DONE) else None, f"d{seq} " if kind == DELTA else None,
                         f"t{seq}" if kind == DONE else None, start + datetime.timedelta(seconds=8 * seq + 300 * (k == 3))))
        parts.append(part)
    src, out, ckpt = (shared_dir(spark, "md", x) for x in ("src", "out", "ckpt"))
    for part in parts:
        spark.createDataFrame(part, EVENTS).repartition(3).write.mode("append").parquet(src)
        jobs.run_to_completion(jobs.merge_deltas_stream(spark.readStream.schema(EVENTS).parquet(src), out, ckpt, "request_id", ["seq"],
                                                        time_col="at" if idle else None, idle_seconds=idle))
    items, state = plain_merge([p for p in parts if p], idle)
    assert sorted(tuple(r) for r in jobs.merged_items(spark, out).collect()) == items and len(items) > 10
    last = jobs._numbers(spark, f"{out}/state", "batch")
    assert len(last) <= 2
    got = {r.request_id: (r.next_pos, (r.open_id, r.open_text) if r.open else None)
           for r in spark.read.parquet(f"{out}/state/batch={last[-1]}").collect()}
    assert got == state


def test_replayed_batch_rewrites_its_items(spark):
    ev = spark.createDataFrame([(1, 1, DELTA, "a", "x", None, None), (1, 2, DONE, "b", None, "t", None), (1, 3, DELTA, "c", "y", None, None)], EVENTS)
    out = shared_dir(spark, "md", "out")
    for _ in range(2):  # the same batch from a checkpoint that does not know it yet
        src = _stream_of(spark, ev, "again", 1)
        jobs.run_to_completion(jobs.merge_deltas_stream(src, out, shared_dir(spark, "md", "ckpt"), "request_id", ["seq"]))
        assert sorted(tuple(r) for r in jobs.merged_items(spark, out).collect()) == [(1, 0, "delta", "a", "x"), (1, 1, "done", "b", "t")]


def test_hot_request_is_spread(spark):
    """No task of the delta merge reads most rows though one request has nearly all."""
    ev = spark.range(4000).select(F.when(F.col("id") % 50 == 0, F.col("id")).otherwise(-1).alias("request_id"), F.col("id").alias("seq"),
                                  F.when(F.col("id") % 9 == 0, DONE).otherwise(DELTA).alias("type"), F.col("id").cast("string").alias("item_id"),
                                  F.lit("d").alias("delta"), F.lit("t").alias("text"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        runs = msg._delta_runs(ev, (DELTA, DONE), "request_id", ["seq"])
        parts = runs.where("request_id = -1").groupBy(F.spark_partition_id().alias("p")).count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(parts) >= 3 and max(r["count"] for r in parts) < 0.6 * sum(r["count"] for r in parts)


def test_refresh_keeps_the_newest_version_of_a_batch(spark):
    schema = "doc_name string, doc_uri string, size bigint, text string, version int"
    # the newest version comes first, in the middle and last of its document; two rows have no uri
    first = [("a", "/a", 1, "a new", 3), ("a", "/a", 1, "a old", 1), ("b", "/b", 1, "b old", 1), ("b", "/b", 1, "b new", 2),
             ("b", "/b", 1, "b none", None), ("c", "/c", 1, "c old", 1), ("c", "/c", 1, "c new", 2), ("n", None, 1, "n one", 1),
             ("n", None, 1, "n two", 2), ("d", "/d", 1, "gone", 1), ("d", "/d", 1, "", 2)]
    second = [("a", "/a", 1, "a late", 2), ("c", "/c", 1, "c same", 2), ("b", "/b", 1, "b next", 4), ("b", "/b", 1, "b mid", 3)]
    src, out, ckpt = (shared_dir(spark, "refresh", x) for x in ("src", "out", "ckpt"))
    for rows in (first, second):
        df = spark.createDataFrame(rows, schema).coalesce(1)
        df.write.mode("append").parquet(src)
        jobs.run_to_completion(jobs.refresh_chunks(spark.readStream.schema(schema).parquet(src), out, ckpt))
        got = sorted(r.content for r in jobs.current_chunks(spark, out).collect())
        assert got == (["a new", "b new", "c new", "n one", "n two"] if rows is first else
                       ["a new", "b next", "c same", "n one", "n two"])


def test_refreshed_index_equals_a_rebuild_after_compaction(spark):
    embedded = lambda texts: [[float(len(t)), 1.0] for t in texts]
    schema = "doc_name string, doc_uri string, size bigint, text string, version int, gone boolean"
    steps = [[("a", "/a", 1, "a one", 1, False), ("b", "/b", 1, "b one", 1, None), ("c", "/c", 1, "x" * 300, 1, False), ("n", None, 1, "n", 1, False)],
             [("a", "/a", 1, "a two", 2, False), ("a", "/a", 1, "a two", 2, False), ("b", "/b", 1, None, 2, True)],
             [("c", "/c", 1, "c short", 2, False), ("b", "/b", 1, "late", 1, False), ("d", "/d", 1, "d", 1, False)],
             [("b", "/b", 1, "b back", 3, False), ("n", None, 1, "n", 1, False)]]
    want = [["a one", "b one", "n", "x" * 300], ["a two", "n", "x" * 300],
            ["a two", "c short", "d", "n"], ["a two", "b back", "c short", "d", "n", "n"]]
    src, out, ckpt = (shared_dir(spark, "index", x) for x in ("src", "out", "ckpt"))
    for k, (rows, texts) in enumerate(zip(steps, want)):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(src)
        jobs.run_to_completion(jobs.refresh_chunks(spark.readStream.schema(schema).parquet(src), out, ckpt, embed_fn=embedded,
                                                   deleted_col="gone", compact_every=2 if k else 0))
        got = jobs.current_chunks(spark, out).collect()
        assert sorted(r.content for r in got) == sorted(texts)
        assert all(list(r.embedding) == [len(r.content), 1.0] for r in got)
        if k == 0:
            before = jobs.current_chunks(spark, out)  # a reader of the version before
    assert jobs._state(spark, out)[0] == 2 and jobs._state(spark, out)[2] == []
    assert jobs.compact_chunks(spark, out) == 2  # nothing new: no new version
    # folders that the version before had replaced are gone, its own are still there
    assert jobs._numbers(spark, f"{out}/docs", "batch") == [2, 3] and os.path.exists(f"{out}/compact/v=1")
    assert before.columns == got[0].__fields__


def test_no_batch_yet(spark):
    with pytest.raises(ValueError):
        jobs.current_chunks(spark, shared_dir(spark, "index", "none"))


def test_texts_are_not_shuffled_to_find_versions(spark):
    docs = spark.createDataFrame([("a", 1, "x" * 50, {"k": 1}), ("a", 2, "y", {"k": 2}), ("b", 1, "z", None)],
                                 "doc_uri string, version int, text string, extra map<string,int>")
    assert sorted(r.text for r in jobs.latest_versions(docs).collect()) == ["y", "z"]


def test_requests_hold_all_turns(spark):
    import __spark_entry__ as e
    from tessera.plans.moderation_inputs import chat_messages_json
    from tessera.plans.moderation_queries import GUARD_TERMS, conversation_requests
    from tests.conftest import SF001
    turns = {r.conv_id: r["count"] for r in chat_messages_json(spark, SF001).groupBy("conv_id").count().collect()}
    reqs = {r.conv_id: r.request for r in conversation_requests(spark, SF001).collect()}
    assert {k: len(json.loads(v)["messages"]) for k, v in reqs.items() if k >= 0} == turns and max(turns.values()) > 1
    got = sorted(map(tuple, e.queries()["moderate_stream_conversations"](spark, SF001).select(
        "conv_id", "decision", "reject_reason", "reject_message").where("conv_id >= 0").collect()), key=str)
    exp = mod.verdict(chat_messages_json(spark, SF001), mod.keyword_guard(GUARD_TERMS)).collect()
    assert got == sorted(map(tuple, exp), key=str)
