"""What large tables would shuffle or number must stay small."""

import hashlib
import random
import re

import numpy as np
from pyspark.sql import functions as F

from tessera.operators import messages as msg, retrieval as rv
from tessera.operators.joins import numbered


def test_index_rows_are_not_shuffled_to_be_synced(spark):
    """Repeated and null keys too: all rows of a key are replaced, rows without a key are kept."""
    before = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b2"), (3, "c"), (None, "n"), (5, "e")], "id long, content string")
    after = spark.createDataFrame([(1, "a"), (2, "b"), (4, "d"), (4, "d"), (None, "n"), (5, None)], "id long, content string")
    emb = lambda df: df.withColumn("embedding", F.array(F.length("content").cast("float")))
    index, source = numbered(rv.sync_index(None, before, embed_with=emb), "index"), numbered(after, "source")
    changes = rv.changed_keys(index, source, "id", ["content"])
    feed = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert feed(changes) == feed(rv.snapshot_diff(before, after).select("id", "_change_type"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        new = rv.sync_index(index, source, changes, embed_with=emb, row_col="_r")
        plan = new._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "hashpartitioning" not in plan and "SortMergeJoin" not in plan
    assert new.columns == ["id", "content", "embedding", "synced"]
    want = [(1, "a", False), (2, "b", True), (4, "d", True), (4, "d", True), (5, None, True), (None, "n", False)]
    assert feed(new.select("id", "content", "synced")) == sorted(want, key=str)


def test_many_rows_are_marked_by_their_keys(spark):
    rows = numbered(spark.range(0, 1000, 1, 3).select((F.col("id") % 100).alias("k"), "id"), "rows")
    keys = spark.range(300).selectExpr("CASE WHEN id % 2 = 0 THEN id END AS k")
    from tessera.operators.joins import marked
    got = marked(rows, keys, "k", "found").collect()
    assert len(got) == 1000 and all(r.found == (r.k % 2 == 0) for r in got)


def test_only_pieces_of_deltas_are_numbered(spark, monkeypatch):
    events = spark.range(0, 3000, 1, 3).select(
        (F.col("id") % 3).alias("request_id"), F.col("id").alias("seq"),
        F.when(F.col("id") % 500 == 0, msg.ITEM_DONE).otherwise(msg.TEXT_DELTA).alias("type"), F.concat(F.lit("i"), "id").alias("item_id"),
        F.when(F.col("id") % 7 > 0, F.concat(F.col("id").cast("string"), F.lit(" "))).alias("delta"), F.lit(None).cast("string").alias("text"))
    numbered_rows, runs = [], msg.runs
    monkeypatch.setattr(msg, "runs", lambda df, *a, **k: (numbered_rows.append(df.count()), runs(df, *a, **k))[1])
    got = sorted(map(tuple, msg.merge_deltas(events).collect()))
    assert numbered_rows[0] < 300
    want = []
    for req in range(3):
        pos, run = 0, None
        for i in [*range(req, 3000, 3), None]:
            if i is None or i % 500 == 0:
                if run:
                    want.append((req, pos, "delta", *run))
                    pos, run = pos + 1, None
                if i is not None:
                    want.append((req, pos, "done", f"i{i}", f"{i} " if i % 7 else ""))
                    pos += 1
            else:
                run = (run[0] if run else f"i{i}", (run[1] if run else "") + (f"{i} " if i % 7 else ""))
    assert got == sorted(want)


def test_buckets_of_odd_words_equal_the_definition():
    rng = random.Random(1)
    chars = "aB1_ -\t\n\x0b\x1c\x1d\x1f\x85\u00a0\u2003éİßΣ。中٣²\u200b\u0301'\x00"
    texts = ["", "  ", "—", "a—b—", "_", *("".join(rng.choices(chars, k=rng.randrange(40))) for _ in range(300))]
    want = np.zeros((len(texts), 16))
    for row, text in zip(want, texts):
        for token in re.split(r"[\W_]+", text.lower()):
            if token:
                row[int.from_bytes(hashlib.md5(token.encode()).digest()[:4], "big") % 16] += 1
    assert (rv.bucket_counts(texts, 16) == want).all()
    assert rv.bucket_counts([], 16).shape == (0, 16) and rv.bucket_counts([""], 16).tolist() == [[0.0] * 16]
