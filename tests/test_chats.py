import datetime as dt

import pytest
from pyspark.sql import functions as F

from tessera.operators import chats as ch
from tessera.operators.ordering import assign_ids, position_in_group

T = dt.datetime(2024, 1, 1)


def _chats(spark):
    rows = [(1, "a", "u1", T), (2, "b", "u1", T), (3, "c", "u1", T + dt.timedelta(hours=1)), (4, "d", "u2", T)]
    return spark.createDataFrame(rows, "id long, title string, user_id string, updated_at timestamp") \
        .withColumn("created_at", F.col("updated_at"))


def _msgs(spark):
    rows = [(10, 1, "hello", "user", T), (11, 1, "hi", "assistant", T), (12, 3, "x" * 60, "user", T)]
    return spark.createDataFrame(rows, "id long, chat_id long, content string, role string, created_at timestamp")


def test_counts_and_titles(spark):
    counts = {r.id: r.message_count for r in ch.message_counts(_chats(spark), _msgs(spark)).collect()}
    assert counts == {1: 2, 2: 0, 3: 1, 4: 0}
    titles = {r.id: r.title for r in ch.chat_titles_from_messages(_chats(spark), _msgs(spark)).collect()}
    assert titles[1] == "hello" and titles[3] == "x" * 50 + "..." and titles[2] == "New Chat 2024-01-01 00:00:00"


def test_paging(spark):
    page = ch.user_chats_page(_chats(spark), user_id="u1").orderBy("rank").collect()
    assert [r.id for r in page] == [3, 1, 2]                     # tie on updated_at: lower id first
    assert ch.user_chats_page(_chats(spark), skip=5, user_id="u1").count() == 0
    assert [r.id for r in ch.user_chats_page(_chats(spark), skip=1, limit=1, user_id="u1").collect()] == [1]
    with pytest.raises(ValueError):
        ch.user_chats_page(_chats(spark), limit=101)


def test_ownership_and_delete(spark):
    req = spark.createDataFrame([(1, "u1"), (4, "u1"), (9, "u1")], "chat_id long, user_id string")
    assert [r.chat_id for r in ch.owned_by(req, _chats(spark)).collect()] == [1]
    dele = spark.createDataFrame([(1,)], "id long")
    keep_c, keep_m = ch.cascade_delete(_chats(spark), _msgs(spark), dele)
    assert sorted(r.id for r in keep_c.collect()) == [2, 3, 4] and [r.id for r in keep_m.collect()] == [12]


def test_attachments_and_nesting(spark):
    files = spark.createDataFrame([(1, 10, "a.png", "image/png"), (2, 10, "README", None), (3, 11, "x.tar.gz", "text/plain")],
                                  "id long, message_id long, filename string, content_type string")
    att = ch.attachment_rows(files)
    got = {r.id: (r.stored_filename, r.file_type, r.file_path) for r in att.collect()}
    assert got == {1: ("1.png", "image", "/uploads/1.png"), 2: ("2.", "text", "/uploads/2."),
                   3: ("3.gz", "text", "/uploads/3.gz")}
    nested = {r.chat_id: r.messages for r in ch.nest_chat(ch.chat_with_messages(_chats(spark), _msgs(spark), att)).collect()}
    assert nested[2] == [] and [m.id for m in nested[1]] == [10, 11]
    assert [a.id for a in nested[1][0].attachments] == [1, 2] and [a.id for a in nested[1][1].attachments] == [3]


def test_apply_messages_and_titles(spark):
    new = spark.createDataFrame([(99, 2, "n", "user", T + dt.timedelta(days=1))],
                                "id long, chat_id long, content string, role string, created_at timestamp")
    up = {r.id: r.updated_at for r in ch.apply_messages(_chats(spark), new).collect()}
    assert up[2] == T + dt.timedelta(days=1) and up[1] == T
    upd = spark.createDataFrame([(1, "x", T + dt.timedelta(hours=5), 1), (1, "y", T + dt.timedelta(hours=5), 2),
                                 (77, "z", T, 1)], "chat_id long, title string, ts timestamp, seq int")
    t = {r.id: r.title for r in ch.apply_titles(_chats(spark), upd).collect()}
    assert t == {1: "y", 2: "b", 3: "c", 4: "d"}


def test_assign_ids_many_partitions(spark):
    df = spark.range(0, 5000).select((F.col("id") % 7).alias("g"), (F.col("id") * 7919 % 5000).alias("o"))
    out = assign_ids(df, ["g", "o"], start=1, num_partitions=13).collect()
    exp = sorted((r.g, r.o) for r in out)
    assert sorted((r.id, r.g, r.o) for r in out) == [(i + 1, g, o) for i, (g, o) in enumerate(exp)]
    pos = position_in_group(df, ["g"], ["o"], "p").collect()
    by_g = {}
    for r in pos:
        by_g.setdefault(r.g, []).append((r.o, r.p))
    for g, items in by_g.items():
        assert [p for _, p in sorted(items)] == list(range(len(items)))


def test_runs_hot_group_many_partitions(spark):
    from tessera.operators.ordering import runs
    # one group holds most rows and spans many range partitions
    rows = [(0 if i < 900 else i % 7, i, "ab"[(i // 3) % 2] if i % 50 else "c") for i in range(1000)]
    df = spark.createDataFrame(rows, "g long, o long, lab string")
    got = {(r.g, r.o): (r.p, r.run) for r in
           runs(position_in_group(df, ["g"], ["o"], "p"), ["g"], ["o"], "lab", "run", ).collect()}
    exp = {}
    by_g = {}
    for g, o, lab in sorted(rows):
        by_g.setdefault(g, []).append((o, lab))
    for g, items in by_g.items():
        run, prev = -1, None
        for p, (o, lab) in enumerate(items):
            if lab != prev:
                run += 1
            prev = lab
            exp[(g, o)] = (p, run)
    assert got == exp
