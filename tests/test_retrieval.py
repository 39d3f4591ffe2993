import hashlib
import json
import math
import re

import numpy as np
from pyspark.sql import functions as F

from tessera.operators import retrieval as rv


def _brute_cosine(qs, vs, k):
    out = {}
    for qid, q in qs.items():
        q = np.asarray(q, float)
        sc = []
        for vid, v in vs.items():
            v = np.asarray(v, float)
            sc.append((-(q @ v) / (np.linalg.norm(q) * np.linalg.norm(v)), vid))
        out[qid] = [vid for _, vid in sorted(sc)[:k]]
    return out


def test_vector_topk_matches_brute_force(spark):
    rng = np.random.default_rng(7)
    vs = {i: rng.normal(size=8).tolist() for i in range(300)}
    qs = {100 + j: rng.normal(size=8).tolist() for j in range(5)}
    vdf = spark.createDataFrame(list(vs.items()), "id long, embedding array<double>").repartition(7)
    qdf = spark.createDataFrame(list(qs.items()), "qid long, qvec array<double>")
    got = {}
    for r in rv.vector_topk(qdf, vdf, k=3).orderBy("qid", "rank").collect():
        got.setdefault(r.qid, []).append(r.id)
    assert got == _brute_cosine(qs, vs, 3)


def _bm25_brute(queries, docs, k1=1.2, b=0.75):
    tok = lambda s: [t for t in re.split(r"[^\w]+|_", s.lower()) if t]
    dt = {d: tok(t) for d, t in docs.items()}
    n, avgdl = len(dt), sum(map(len, dt.values())) / len(dt)
    out = {}
    for q, text in queries.items():
        sc = {}
        for term in set(tok(text)):
            df = sum(term in ts for ts in dt.values())
            if not df:
                continue
            idf = math.log(1 + (n - df + 0.5) / (df + 0.5))
            for d, ts in dt.items():
                tf = ts.count(term)
                if tf:
                    sc[d] = sc.get(d, 0) + idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * len(ts) / avgdl))
        out[q] = sc
    return out


DOCS = {1: "the cat sat on the mat", 2: "dogs and cats", 3: "the quick brown fox", 4: "cat cat cat",
        5: "nothing here", 6: "Über café crème"}
QUERIES = {10: "cat on mat", 11: "quick dog", 12: "café"}


def test_bm25_matches_brute_force(spark):
    d = spark.createDataFrame(list(DOCS.items()), "id long, content string")
    q = spark.createDataFrame(list(QUERIES.items()), "qid long, text string")
    got = {(r.qid, r.doc): r.score for r in rv.keyword_topk(q, d, k=100).collect()}
    exp = {(qq, dd): s for qq, m in _bm25_brute(QUERIES, DOCS).items() for dd, s in m.items()}
    assert got.keys() == exp.keys()
    assert all(abs(got[x] - exp[x]) < 1e-9 for x in exp)
    top = [r.doc for r in rv.keyword_topk(q, d, k=2).filter("qid = 10").orderBy("rank").collect()]
    assert top == [x[1] for x in sorted((-s, dd) for (qq, dd), s in exp.items() if qq == 10)][:2]


def _ranks(scores):
    """{doc: rank} of {doc: score}, higher first, ties by doc, scores rounded."""
    order = sorted(scores, key=lambda d: (-round(scores[d], 9), d))
    return {d: i + 1 for i, d in enumerate(order)}


def _hybrid_case(spark, n_docs, n_queries, seed, ids=int):
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(30)]
    docs = {ids(i): " ".join(rng.choice(words, rng.integers(0, 12))) for i in range(n_docs)}
    queries = {100 + j: " ".join(rng.choice(words, rng.integers(0, 4))) for j in range(n_queries)}
    vec = {d: rng.integers(-2, 3, 4).astype(float).tolist() for d in docs}
    qvec = {q: rng.integers(-2, 3, 4).astype(float).tolist() for q in queries}
    kind = "long" if ids is int else "string"
    ddf = spark.createDataFrame([(d, t, vec[d]) for d, t in docs.items()], f"id {kind}, content string, embedding array<double>")
    qdf = spark.createDataFrame([(q, t, qvec[q]) for q, t in queries.items()], "qid long, text string, qvec array<double>")
    return docs, queries, vec, qvec, ddf.repartition(5), qdf


def _hybrid_brute(docs, queries, vec, qvec, k, c):
    unit = lambda v: np.asarray(v) / (np.linalg.norm(v) or 1.0)
    out, bm = {}, _bm25_brute(queries, docs)
    for q in queries:
        rv_, rk_ = _ranks({d: float(unit(vec[d]) @ unit(qvec[q])) for d in docs}), _ranks(bm[q])
        fused = {d: 1 / (c + rv_[d]) + (1 / (c + rk_[d]) if d in rk_ else 0) for d in docs}
        best = sorted(fused, key=lambda d: (-round(fused[d], 12), d))[:k]
        out[q] = [(d, rv_[d], rk_.get(d)) for d in best]
    return out


def test_hybrid_matches_brute_force_rrf(spark, monkeypatch):
    monkeypatch.setattr(rv, "SLICE_ROWS", 7)
    for block, c, ids in ((2048, 3, int), (4, 1, lambda i: f"id-{i:03d}")):
        monkeypatch.setattr(rv, "QUERY_BLOCK", block)
        docs, queries, vec, qvec, ddf, qdf = _hybrid_case(spark, 150, 9, 3, ids)
        got = {}
        for r in rv.hybrid_topk(qdf, ddf, k=3, rrf_k=c).orderBy("qid", "rank").collect():
            got.setdefault(r.qid, []).append((r.doc, r.rank_v, r.rank_k))
        assert got == _hybrid_brute(docs, queries, vec, qvec, 3, c)


def test_partitions_forward_at_most_k_rows_per_query(spark, monkeypatch):
    monkeypatch.setattr(rv, "SLICE_ROWS", 7)
    docs, queries, vec, qvec, ddf, qdf = _hybrid_case(spark, 150, 6, 5)
    scorer, corpus = rv._dense(qdf, ddf, "qid", "qvec", "id", "embedding")
    rows = corpus.mapInPandas(rv._partition_topk(scorer, 3, 9), "qid long, doc long, score double").groupBy(
        "qid", F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in rows) <= 3


def test_no_queries_and_no_docs(spark):
    _, _, _, _, ddf, qdf = _hybrid_case(spark, 4, 2, 1)
    assert rv.hybrid_topk(qdf.limit(0), ddf).count() == 0 and rv.hybrid_topk(qdf, ddf.limit(0)).count() == 0
    assert rv.keyword_topk(qdf.limit(0), ddf).count() == 0 and rv.vector_topk(qdf, ddf.limit(0)).count() == 0


def test_bucket_counts():
    m = rv.bucket_counts(["A b a_b", ""], 16)
    assert m.sum(axis=1).tolist() == [4.0, 0.0] and m[0].max() >= 2


def test_bucket_counts_of_any_script_and_distinct_tokens_once(monkeypatch):
    rng = np.random.default_rng(2)
    letters = list("aZ_é .İß²½Ⅷ中\n\x85\u3000-ſǺ١9")
    texts = ["".join(rng.choice(letters, 40)) for _ in range(200)] + ["", "one two one"] * 3
    want = np.zeros((len(texts), 16), dtype=np.float32)
    for row, text in enumerate(texts):
        for t in re.split(r"[\W_]+", text.lower()):
            if t:
                want[row, int(hashlib.md5(t.encode()).hexdigest()[:8], 16) % 16] += 1
    hashed, md5 = [], hashlib.md5
    monkeypatch.setattr(rv.hashlib, "md5", lambda b: hashed.append(b) or md5(b))
    got = rv.bucket_counts(texts, 16)
    assert got.dtype == np.float32 and np.array_equal(got, want) and len(hashed) == len(set(hashed))
    assert rv.bucket_counts([], 16).shape == (0, 16)


def test_facts_json_and_blank_drop(spark):
    hits = spark.createDataFrame([(1, 7, 1), (1, 8, 2), (1, 9, 3)], "qid long, doc long, rank int")
    chunks = spark.createDataFrame([(7, "u", "first é", "m"), (8, "u", "   ", "m"), (9, "u", 'third "q"', "m")],
                                   "id long, doc_uri string, content string, metadata string")
    q = spark.createDataFrame([(1,), (2,)], "qid long")
    facts = rv.retrieve_facts(hits.withColumn("score", F.lit(0.5)), chunks)
    assert {(r.id, r.rank, r.score) for r in facts.collect()} == {(7, 1, 0.5), (9, 3, 0.5)}
    rows = {r.qid: r for r in rv.facts_json(rv.retrieve_facts(hits, chunks), queries=q).collect()}
    assert json.loads(rows[1].facts) == {"fact_1": "first é", "fact_2": 'third "q"'}
    assert rows[1].facts.startswith('{\n  "fact_1": ') and rows[2].facts == "{}" and rows[2].n_facts == 0


def test_few_hits_are_shipped_to_the_chunks(spark):
    chunks = spark.range(1000).selectExpr("id", "'u' doc_uri", "concat('text ', id) content", "'m' metadata")
    hits = spark.range(4).groupBy((F.col("id") % 2).alias("qid")).agg(F.max("id").alias("doc")).withColumn("rank", F.lit(1))
    facts = rv.retrieve_facts(hits, chunks)
    plan = facts._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert sorted((r.qid, r.content, r.score) for r in facts.collect()) == [(0, "text 2", None), (1, "text 3", None)]


def test_snapshot_diff_and_sync(spark):
    before = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id long, content string")
    after = spark.createDataFrame([(1, "a"), (2, "B"), (4, "d")], "id long, content string")
    feed = sorted((r.id, r._change_type, r.content) for r in rv.snapshot_diff(before, after).collect())
    assert feed == [(2, "update_postimage", "B"), (2, "update_preimage", "b"), (3, "delete", "c"), (4, "insert", "d")]
    emb = lambda df: df.withColumn("embedding", F.array(F.length("content").cast("float")))
    idx = rv.sync_index(None, before, embed_with=emb)
    new = rv.sync_index(idx, after, rv.snapshot_diff(before, after), embed_with=emb)
    assert sorted((r.id, r.content, r.synced) for r in new.collect()) == [(1, "a", False), (2, "B", True), (4, "d", True)]


def test_embed_pluggable(spark):
    df = spark.createDataFrame([("a b",), ("c",)], "t string")
    out = rv.embed(df, "t", embed_fn=lambda texts: [[len(t), 1.0] for t in texts]).collect()
    assert sorted(r.embedding[0] for r in out) == [1.0, 3.0]
    default = rv.embed(df, "t", dim=16).collect()
    assert all(len(r.embedding) == 16 for r in default)
