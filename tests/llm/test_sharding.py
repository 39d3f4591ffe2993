import zlib
from collections import Counter

import numpy as np
from tessera.llm import sharding


def test_matrix_has_exact_sums():
    parts, shards = np.array([0, 5, 17, 1, 100]), sharding.shard_rows(123, 7)
    m = sharding.communication_matrix(parts, shards, 3)
    assert (m >= 0).all() and (m.sum(axis=1) == parts).all() and (m.sum(axis=0) == shards).all()


def test_draws_follow_the_law():
    draws = np.array([sharding.communication_matrix(np.array([30, 70]), sharding.shard_rows(100, 4), s)[0] for s in range(2000)])
    assert np.abs(draws.mean(axis=0) - 7.5).max() < 0.2
    want = 30 * 0.25 * 0.75 * 70 / 99
    assert np.abs(draws.var(axis=0) - want).max() < 0.5


def test_large_populations_follow_the_law():
    rng = np.random.default_rng(1)
    good, bad, n = 3 * 10**9, 6 * 10**9, 10_000
    x = np.array([sharding._draw(rng, good, bad, n) for _ in range(2000)])
    assert abs(x.mean() - n / 3) < 5 and abs(x.var() / (n * 2 / 9) - 1) < 0.12


def test_documents_land_in_near_equal_gapless_shards(spark):
    rows = [(i, f"text {i % 40}é") for i in range(500)] + [(None, None), (7, "text 7é"), (3, "")]
    docs = spark.createDataFrame([(*r, 1, "s") for r in rows], "doc_id long, text string, shard int, slot string").repartition(5)
    got = sharding.shard_documents(docs).collect()
    sizes = Counter(r["shard"] for r in got)
    assert set(sizes) == set(range(24)) and max(sizes.values()) - min(sizes.values()) <= 1
    for s, n in sizes.items():
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(n))
    want = Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    assert {r["law"] for r in got} == {"rows"} and {r["grown_shard"] for r in got} == {None}


def test_placement_is_uniform(spark):
    rows = spark.range(0, 60, 1, 3).withColumnRenamed("id", "k")
    places, slots = np.zeros((60, 4)), np.zeros((60, 15))
    for seed in range(24):
        for r in sharding.shuffle_into_shards(rows, 4, seed).collect():
            places[r["k"], r["shard"]] += 1
            slots[r["k"], r["slot"]] += 1
    assert ((places - 6) ** 2 / 6).sum() / (60 * 3) < 1.5  # a chi-square by its freedom
    assert ((slots - 1.6) ** 2 / 1.6).sum() / (60 * 14) < 1.3


def test_empty_and_few_rows(spark):
    assert sharding.shard_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    got = sharding.shard_documents(spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")).collect()
    assert len(got) == 2 and all(r["slot"] == 0 for r in got)


def test_columns_of_the_result_names_are_replaced(spark):
    rows = spark.createDataFrame([(k, "x", -1.0) for k in range(9)], "id long, shard string, slot double")
    got = sharding.shuffle_into_shards(rows, 2, 1)
    assert sorted(got.columns) == ["id", "shard", "slot"]
    assert sorted((r["shard"], r["slot"]) for r in got.collect()) == [(0, k) for k in range(5)] + [(1, k) for k in range(4)]


def test_shards_are_written(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"t{i}") for i in range(50)], "doc_id long, text string")
    placed = sharding.shard_documents(docs, 4)
    sharding.write_shards(docs, placed, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert {(r["doc_id"], r["text"], r["shard"], r["slot"]) for r in back.collect()} == \
        {(r["doc_id"], f"t{r['doc_id']}", r["shard"], r["slot"]) for r in placed.collect()}


def test_replay_of_one_seed(spark):
    """Matrix, dealing and slots again, row by row."""
    seed, shards, parts = 5, 4, [list(range(0, 21)), list(range(21, 42)), list(range(42, 63))]
    rows = spark.range(0, 63, 1, 3).withColumnRenamed("id", "k")
    rng, left, shard_of = np.random.default_rng(seed), [16, 16, 16, 15], {}
    for p, own in enumerate(parts):
        deck, need = [], len(own)
        for s in range(shards):
            others = sum(left[s + 1:])
            take = int(rng.hypergeometric(left[s], others, need)) if need and left[s] and others else min(need, left[s])
            left[s] -= take
            need -= take
            deck += [s] * take
        assert need == 0
        for at, s in enumerate(np.random.default_rng([seed, p]).permutation(np.array(deck, dtype=np.int32))):
            shard_of[own[at]] = int(s)
    assert left == [0] * 4
    keyed = spark.createDataFrame([(k, p, at) for p, own in enumerate(parts) for at, k in enumerate(own)], "k long, p int, at long")
    key = {r["k"]: (r["key"] % sharding.LEAST_BLOCKS, r["key"], r["p"], r["at"])
           for r in keyed.selectExpr("*", f"xxhash64({seed}, p, at) AS key").collect()}
    want = set()
    for s in range(shards):
        own = sorted((k for k in shard_of if shard_of[k] == s), key=key.__getitem__)
        want |= {(k, s, slot) for slot, k in enumerate(own)}
    got = {(r["k"], r["shard"], r["slot"]) for r in sharding.shuffle_into_shards(rows, shards, seed).collect()}
    assert got == want
