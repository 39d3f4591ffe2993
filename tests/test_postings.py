import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import postings as ps
from tessera.operators import retrieval as rv


def corpus(spark, n=400, seed=3):
    rng = np.random.default_rng(seed)
    rare = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(n):
        words = ["the"] * int(rng.integers(1, 4)) + rng.choice(rare[:60], rng.integers(1, 30)).tolist()
        if i % 40 == 7:
            words += [f"topic{i // 80}"] * int(rng.integers(1, 6))
        rows.append((f"id-{i:05d}", " ".join(words)))
    rows += [("id-copy", rows[7][1]), ("id-copy", rows[7][1]), ("id-null", None), ("id-blank", " \n")]
    return rows, spark.createDataFrame(rows, "id string, content string").repartition(5)


@pytest.fixture(scope="module")
def case(spark):
    rows, df = corpus(spark)
    queries = spark.createDataFrame([(1, "the topic0"), (2, "topic2 w5"), (3, "w1 w2 w3 the"), (4, "unknown"), (5, None), (6, "topic4")],
                                    "qid long, text string")
    return rows, df, queries


def found(df):
    return sorted((r.qid, r["rank"], r.doc, round(r.score, 8)) for r in df.collect())


def test_small_blocks_give_the_same_rows(spark, case, monkeypatch):
    rows, df, queries = case
    want = found(rv.keyword_topk(queries, df, 5))
    assert {q for q, *_ in want} == {1, 2, 3, 6}
    for docs, gathered, block in ((8, 3, 2), (1, 1, 2048), (1000, 64, 1)):
        monkeypatch.setattr(ps, "BLOCK_DOCS", docs)
        monkeypatch.setattr(ps, "GATHERED", gathered)
        monkeypatch.setattr(rv, "QUERY_BLOCK", block)
        assert found(rv.keyword_topk(queries, df, 5)) == want


def test_blocks_are_skipped(spark, case, monkeypatch):
    monkeypatch.setattr(ps, "BLOCK_DOCS", 8)
    _, df, queries = case
    few = rv.skipped_blocks(queries, ps.build_postings(df), 1).first()
    most = rv.skipped_blocks(queries, ps.build_postings(df), 1000).first()
    assert few.met == most.met and few.skipped > 0 and most.skipped == 0
    assert rv.skipped_blocks(queries.limit(0), ps.build_postings(df), 1).first() == (0, 0)


def test_index_is_stored_and_opened(spark, case, tmp_path):
    rows, df, queries = case
    index = ps.build_postings(df, str(tmp_path / "a"))
    again = ps.open_postings(spark, index.path)
    assert again == index and again.n_docs == len(rows)
    assert found(rv.search_postings(queries, again, 5)) == found(rv.keyword_topk(queries, df, 5))
    # a term's rows hold each of its documents once; bounds are the highest weights
    table = index.table(spark, "rows")
    df_the = sum("the" in (t or "") for _, t in rows)
    assert table.where("term = 'the'").agg(F.sum(F.size("docs"))).first()[0] == df_the
    assert table.where(F.array_max("weights") != F.col("best")).count() == 0
    assert table.groupBy("term", "block").count().where("count > 1").count() == 0


def test_search_reads_the_terms_of_its_queries_only(spark, case):
    _, df, queries = case
    index = ps.build_postings(df)
    scorer, rows = ps.keyword_side(queries.where("qid = 6"), index, "qid", "text")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [(bucket" in plan
    assert {r.term for r in rows.collect()} == {"topic4"}


def test_ranks_of_candidates_count_ties_by_id():
    rng = np.random.default_rng(5)
    for _ in range(50):
        n, nq = int(rng.integers(1, 60)), 3
        q, doc = rng.integers(0, nq, n), rng.permutation(200)[:n]
        score = np.round(rng.integers(-3, 4, n) / 7, 9)
        pick = rng.random(n) < 0.4
        import pandas as pd
        targets = rv._Targets(np.array([10, 11, 12]), pd.DataFrame({"qid": 10 + q[pick], "doc": doc[pick], "score": score[pick]}))
        if not pick.any():
            continue
        got = targets.ahead(q, score, doc)
        want = [sum(1 for a, s, d in zip(q, score, doc) if a == tq and (-s, d) < (-ts, td))
                for tq, td, ts in zip(targets.q, targets.doc, targets.score)]
        assert got.tolist() == want


def test_wanted_pairs():
    import pandas as pd
    pairs = rv._Pairs(np.array([5, 6, 7]), pd.DataFrame({"qid": [5, 7, 7, 9], "doc": [30, 30, 10, 30]}))
    row, q = pairs.among(np.array([40, 30, 10, 30]))
    assert sorted(zip(row.tolist(), q.tolist())) == [(1, 0), (1, 2), (2, 2), (3, 0), (3, 2)]
    assert pairs.among(np.array([1, 2]))[0].tolist() == []


def test_many_query_blocks_of_hybrid_search(spark, case, monkeypatch):
    rows, df, _ = case
    rng = np.random.default_rng(6)
    docs = df.where("id <> 'id-copy'").withColumn("embedding", F.array(*[(F.pmod(F.xxhash64("id"), F.lit(7 + k)) - 3).cast("double") for k in range(4)]))
    queries = spark.createDataFrame([(q, f"w{q % 50} the", rng.normal(size=4).tolist()) for q in range(40)],
                                    "qid long, text string, qvec array<double>")
    whole = rv.hybrid_topk(queries, docs, 3)
    want = sorted(map(tuple, whole.drop("fused").collect()))
    assert "LocalTableScan" not in whole._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.setattr(rv, "QUERY_BLOCK", 6)
    blocks = rv.hybrid_topk(queries, docs, 3)
    assert "LocalRelation" not in blocks._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, blocks.drop("fused").collect())) == want and len(want) == 120


def test_empty_corpus(spark):
    empty = spark.createDataFrame([], "id string, content string")
    q = spark.createDataFrame([(1, "a")], "qid long, text string")
    assert rv.keyword_topk(q, empty).count() == 0
    assert rv.keyword_topk(q, spark.createDataFrame([("x", " ")], "id string, content string")).count() == 0


def test_no_text_is_shuffled(spark, case, tmp_path):
    """Only codes, places and counts of the query terms meet by block, each block as one row."""
    rows, df, queries = case
    index = ps.build_postings(df, str(tmp_path / "a"))
    assert [r.id for r in index.table(spark, "docs").orderBy("n").collect()] == sorted(i for i, _ in rows)
    scorer, found_rows = ps.keyword_side(queries, index, "qid", "text")
    gathered = ps.gathered_blocks(found_rows, index)
    assert "string" not in [t for _, t in gathered.dtypes] and gathered.groupBy("block").count().where("count > 1").count() == 0
    lengths = {r.block: len(r.lengths) for r in gathered.collect()}
    assert sum(lengths.values()) == index.n_docs == len(rows)
