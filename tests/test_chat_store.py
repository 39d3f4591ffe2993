import datetime
import os
import re
import uuid

import pytest
from pyspark.sql import functions as F

from tessera.operators import chat_store as cs
from tessera.operators import chats as ch

T0 = datetime.datetime(2024, 1, 1)


def tables(spark, n=60):
    chats = spark.createDataFrame([(k, f"t{k}", f"u{k % 7}", T0, T0) for k in range(n)],
                                  "id long, title string, user_id string, created_at timestamp, updated_at timestamp")
    msgs = spark.createDataFrame([(k, k % 17, f"m{k}", "user", T0 + datetime.timedelta(minutes=(k * 37) % 50)) for k in range(200)],
                                 "id long, chat_id long, content string, role string, created_at timestamp")
    atts = spark.createDataFrame([(k, k * 3, f"f{k}", f"s{k}", f"p{k}", "text") for k in range(80)],
                                 "id long, message_id long, filename string, stored_filename string, file_path string, file_type string")
    return chats, msgs, atts


@pytest.fixture()
def store(spark, tmp_path):
    out = cs.create_store(f"t_{uuid.uuid4().hex[:8]}", str(tmp_path), *tables(spark), parts=5, buckets=4)
    yield out
    cs.drop_store(spark, out)


@pytest.fixture()
def no_broadcast(spark):
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.requireAllClusterKeysForCoPartition": "false"}
    for name, value in conf.items():
        spark.conf.set(name, value)
    yield
    for name in conf:
        spark.conf.unset(name)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def files(store, kind):
    top = f"{store.path}/{kind}"
    return {f"{p}/{f}" for p in os.listdir(top) if p.startswith("part=") for f in os.listdir(f"{top}/{p}") if f.endswith(".parquet")}


def test_joins_and_counts_need_no_exchange(spark, store, no_broadcast):
    for df in (cs.message_counts(spark, store), cs.chat_rows(spark, store), cs.ordered_messages(spark, store)):
        assert "Exchange" not in plan(df)
    chats, msgs, atts = tables(spark)
    assert rows(cs.chat_rows(spark, store)) == rows(ch.chat_with_messages(chats, msgs, atts))
    assert rows(cs.message_counts(spark, store)) == rows(ch.message_counts(chats, msgs))


def test_lookup_reads_one_bucket_of_one_folder(spark, store):
    one = cs.ordered_messages(spark, store, 5)
    text = plan(one)
    assert "SelectedBucketsCount: 1 out of 4" in text and re.search(r"PartitionFilters: \[.*part#\d+ = \d", text)
    want = [r.id for r in tables(spark)[1].where("chat_id = 5").orderBy("created_at", "id").collect()]
    assert [r.id for r in one.orderBy("msg_pos").collect()] == want
    assert cs.ordered_messages(spark, store, 999).count() == 0


def test_appended_messages_touch_their_folders_only(spark, store):
    new = spark.createDataFrame([(3, "later", "user", T0 + datetime.timedelta(days=2), 1), (3, "first", "user", T0 + datetime.timedelta(days=1), 2),
                                 (999, "unknown", "user", T0, 3)], "chat_id long, content string, role string, created_at timestamp, k long")
    before, old_files = {k: files(store, k) for k in cs.KEYS}, spark.table(f"{store.name}_chats").select("id", "part").collect()
    cs.append(spark, store, new, ["created_at", "k"])
    chats, msgs, _ = tables(spark)
    want = ch.append_messages(chats, msgs, new, ["created_at", "k"])
    assert rows(store.table(spark, "messages").select(*msgs.columns)) == rows(want[1])
    assert rows(store.table(spark, "chats").select(*chats.columns)) == rows(want[0].select(*chats.columns))
    part = {r.id: r.part for r in old_files}[3]
    assert before["messages"] <= files(store, "messages")  # only new files
    assert all(f.startswith(f"part={part}/") for f in before["chats"] ^ files(store, "chats"))
    assert "SelectedBucketsCount: 1 out of 4" in plan(cs.ordered_messages(spark, store, 3))
    cs.append(spark, store, new.where("chat_id = 999"), ["k"])  # nothing to do
    assert store.table(spark, "messages").count() == 202


def test_renames_and_deletes_are_written_back(spark, store, no_broadcast):
    updates = spark.createDataFrame([(4, "new", T0, 1), (4, "newer", T0, 2), (999, "x", T0, 1)], "chat_id long, title string, ts timestamp, seq long")
    before = files(store, "chats")
    cs.rename(spark, store, updates)
    titles = {r.id: r.title for r in store.table(spark, "chats").collect()}
    assert titles[4] == "newer" and len(titles) == 60 and titles[5] == "t5"
    assert before & files(store, "chats")
    gone = [r.id for r in spark.table(f"{store.name}_chats").where("part = 2").collect()] + [5]  # a folder that gets empty
    deleted = spark.createDataFrame([(k,) for k in [*gone, 5, 999, None]], "id long")
    cs.delete(spark, store, deleted)
    chats, msgs, atts = tables(spark)
    want = ch.cascade_delete(ch.apply_titles(chats, updates), msgs, deleted.where("id is not null"), atts)
    assert rows(store.table(spark, "chats").select(*want[0].columns)) == rows(want[0])
    assert rows(store.table(spark, "messages").select(*msgs.columns)) == rows(want[1])
    assert rows(store.table(spark, "attachments").select(*atts.columns)) == rows(want[2])
    assert not os.path.exists(f"{store.path}/chats/part=2")
    assert "Exchange" not in plan(cs.chat_rows(spark, store))


def test_only_keys_are_numbered(spark):
    """Texts of new messages don't go through the numbering's checkpoint."""
    _, msgs, _ = tables(spark)
    new = spark.createDataFrame([(1, "text", 5), (2, "text", 5), (2, "text", 4)], "chat_id long, content string, k long")
    out = ch.numbered_after(msgs, new, ["k", "chat_id"])
    assert [(r.id, r.chat_id, r.k) for r in out.orderBy("id").collect()] == [(200, 2, 4), (201, 1, 5), (202, 2, 5)]
    assert "content" not in re.findall(r"Scan ExistingRDD\[([^\]]*)", plan(out))[0]
