"""Retrieval: embeddings, exact vector top-k, BM25 keyword top-k, reciprocal
rank fusion, facts JSON, change feed and index refresh, batch answers.

Scale notes
* Queries are taken in blocks of ``QUERY_BLOCK``; each block goes to the
  executors once and any number of blocks is answered. The corpus is never
  joined with them: each corpus partition scores a few hundred rows at a time,
  keeps one running top-k per query and forwards at most k rows per query.
* Document frequencies are counted for the block's terms only.
* Exact fusion needs no ranking of all (query, chunk) pairs: see
  :func:`hybrid_topk`.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F, types as T

from ..functions.jsonfmt import json_string
from ..functions.text import normalize_ws, tag_speaker
from ..session import shared_dir, write_once
from .joins import marked, null_safe_equal, numbered, shipped
from .postings import BM25_B, BM25_K1, TOKEN_SPLIT, Postings, build_postings, gathered_blocks, keyword_side

NUM_RESULTS = 2        # hits per search
RRF_K = 60             # reciprocal rank fusion constant
QUERY_BLOCK = 2048     # queries that are scored together
SLICE_ROWS = 512       # corpus rows that are scored at a time


# ---------------------------------------------------------------- embeddings

#: ASCII characters that are no letters or digits as spaces; bytes of other characters stay.
_ASCII_GAPS = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
_GAPS = re.compile(r"[\W_]+")


class _Buckets(dict):
    """Bucket of each token met so far."""

    def __init__(self, dim: int):
        self.dim = dim

    def __missing__(self, token: bytes) -> int:
        out = self[token] = int.from_bytes(hashlib.md5(token).digest()[:4], "big") % self.dim
        return out


def bucket_counts(texts: list[str], dim: int = 256) -> np.ndarray:
    """An embedding without a model: how often each hash bucket has a token of the
    text. A token's bucket is the first 32 bits of its MD5, modulo ``dim``. All texts are
    split at once, and each distinct word is looked at once: those with other characters than ASCII go
    through the regular expression and may hold no token or several."""
    spaced = pa.array([t.lower().encode().translate(_ASCII_GAPS) for t in texts], pa.large_string())
    split = pc.ascii_split_whitespace(spaced)
    words = split.flatten().dictionary_encode()
    known, buckets, sizes = _Buckets(dim), [], []
    for word in words.dictionary.to_pylist():
        tokens = (word,) if word and word.isascii() else [t for t in _GAPS.split(word) if t]
        buckets += [known[t.encode()] for t in tokens]
        sizes.append(len(tokens))
    buckets, sizes = np.array(buckets, dtype=np.int64), np.array(sizes, dtype=np.int64)
    which = np.asarray(words.indices)
    row = np.repeat(np.arange(len(texts)), np.asarray(pc.list_value_length(split)))
    n = sizes[which]
    # the tokens of a word lie next to each other
    nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    cell = np.repeat(row, n) * dim + buckets[np.repeat((np.cumsum(sizes) - sizes)[which], n) + nth]
    return np.bincount(cell, minlength=len(texts) * dim).reshape(-1, dim).astype(np.float32)


def embed(df: DataFrame, text_col: str, embed_fn: Callable | None = None, dim: int = 256,
          out_col: str = "embedding", fit_on: DataFrame | None = None) -> DataFrame:
    """Add ``out_col`` (array<float>) for ``text_col``.

    ``embed_fn(list[str]) -> 2-D array`` is called once per Arrow batch inside an
    Arrow UDF (load models at module level of the function's closure so a
    worker loads them once). Without one, a Spark ML pipeline (tokenize ->
    HashingTF(dim) -> IDF -> L2 normaliser) is fitted on ``fit_on`` (default
    ``df``) and applied; its IDF fit is a distributed aggregation.
    """
    if embed_fn is not None:
        @F.arrow_udf(T.ArrayType(T.FloatType()))
        def _embed(texts: pa.Array) -> pa.Array:
            vecs = np.asarray(embed_fn([t or "" for t in texts.to_pylist()]), dtype=np.float32).reshape(len(texts), -1)
            ends = np.arange(len(texts) + 1, dtype=np.int32) * vecs.shape[1]
            return pa.ListArray.from_arrays(ends, pa.array(vecs.ravel()))
        return df.withColumn(out_col, _embed(F.col(text_col)))
    model = hashing_embedder(fit_on if fit_on is not None else df, text_col, dim)
    return apply_embedder(model, df, text_col, out_col)


def hashing_embedder(df: DataFrame, text_col: str, dim: int = 256):
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import IDF, HashingTF, Normalizer, RegexTokenizer
    stages = [RegexTokenizer(inputCol="_etext", outputCol="_tok", pattern=TOKEN_SPLIT, toLowercase=True),
              HashingTF(inputCol="_tok", outputCol="_tf", numFeatures=dim),
              IDF(inputCol="_tf", outputCol="_idf"),
              Normalizer(inputCol="_idf", outputCol="_vec", p=2.0)]
    return Pipeline(stages=stages).fit(df.select(F.coalesce(F.col(text_col), F.lit("")).alias("_etext")))


def apply_embedder(model, df: DataFrame, text_col: str, out_col: str = "embedding") -> DataFrame:
    from pyspark.ml.functions import vector_to_array
    out = model.transform(df.withColumn("_etext", F.coalesce(F.col(text_col), F.lit(""))))
    return (out.withColumn(out_col, vector_to_array("_vec", "float32"))
            .drop("_etext", "_tok", "_tf", "_idf", "_vec"))


# ------------------------------------------------------------------ scoring

def _unit(m: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(m, axis=1, keepdims=True)
    n[n == 0] = 1.0
    return m / n


class DenseScorer:
    """Cosine of corpus vectors with a block of query vectors."""

    def __init__(self, qids: np.ndarray, matrix: np.ndarray):
        self.qids, self.matrix = qids, _unit(matrix)

    def tables(self, batches, floor: np.ndarray):
        """(ids, scores by query) of each slice of rows."""
        for part in _slices(batches):
            yield _array(part["id"]), _vectors(part["v"]) @ self.matrix.T


def _vectors(column) -> np.ndarray:
    return _unit(np.stack([np.asarray(x, dtype=np.float64) for x in column]))


def _slices(batches):
    for pdf in batches:
        for lo in range(0, len(pdf), SLICE_ROWS):
            yield pdf.iloc[lo:lo + SLICE_ROWS]


def _round(s: np.ndarray, digits: int | None) -> np.ndarray:
    return s if digits is None else np.round(s, digits)


def _partition_topk(scorer, k: int, digits: int | None):
    """One running top-k per query over a partition (score descending, id ascending)."""
    def run(batches):
        known = scorer.value
        floor = np.full(len(known.qids), -np.inf)
        held, pending = [], 0

        def cut():
            ids, q, s = (np.concatenate(x) for x in zip(*held))
            r = _round(s, digits)
            order = np.lexsort((ids, -r, q))
            ids, q, s, r = ids[order], q[order], s[order], r[order]
            place = np.arange(len(q)) - np.searchsorted(q, q)
            full = place == k - 1
            # below by more than any rounding: can't be among the k any more
            floor[q[full]] = r[full] - (0 if digits is None else 10.0 ** -digits)
            stay = place < k
            return [(ids[stay], q[stay], s[stay])]

        for ids, s in known.tables(batches, floor):
            row, q = np.nonzero((s >= floor[None, :]) & (s > -np.inf))
            held.append((ids[row], q, s[row, q]))
            pending += len(held[-1][0])
            if pending > max(64, 4 * k * len(floor)):
                held, pending = cut(), 0
        if held:
            (ids, q, s), = cut()
            yield pd.DataFrame({"qid": _column(known.qids[q]), "doc": _column(ids), "score": s})
    return run


def _block_topk(scorer, corpus: DataFrame, schema: str, k: int, digits: int | None) -> DataFrame:
    order = [F.col("score").desc() if digits is None else F.round("score", digits).desc(), F.col("doc").asc()]
    w = Window.partitionBy("qid").orderBy(*order)
    return (corpus.mapInPandas(_partition_topk(scorer, k, digits), schema)
            .withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
            .withColumn("rank", F.col("rank").cast("bigint")))


def _blocks(queries: DataFrame, qid: str):
    """The query set in blocks of about ``QUERY_BLOCK`` rows."""
    n = -(-queries.count() // QUERY_BLOCK)
    return [queries] if n <= 1 else [queries.filter(F.pmod(F.xxhash64(qid), F.lit(n)) == k) for k in range(n)]


def _schema(queries: DataFrame, qid: str, docs: DataFrame, did: str) -> str:
    return f"qid {queries.schema[qid].dataType.simpleString()}, doc {docs.schema[did].dataType.simpleString()}, score double"


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def _array(values) -> np.ndarray:
    """Ids as an array; strings as UTF-8 bytes, which compare fast and in Spark's order."""
    out = np.array(list(values))
    return np.char.encode(out, "utf-8") if out.dtype.kind == "U" else out


def _column(ids: np.ndarray) -> np.ndarray:
    """Ids as they were."""
    return np.char.decode(ids, "utf-8").astype(object) if ids.dtype.kind == "S" else ids


def _dense(block: DataFrame, docs: DataFrame, qid: str, qvec: str, vid: str, vvec: str):
    """(broadcast scorer, corpus rows) of a query block; None for no queries."""
    rows = block.select(F.col(qid).alias("q"), F.col(qvec).alias("v")).orderBy("q").collect()
    if not rows:
        return None
    scorer = DenseScorer(_array([r.q for r in rows]), np.array([np.asarray(r.v, dtype=np.float64) for r in rows]))
    return docs.sparkSession.sparkContext.broadcast(scorer), docs.select(F.col(vid).alias("id"), F.col(vvec).alias("v"))


def vector_topk(queries: DataFrame, vectors: DataFrame, k: int = NUM_RESULTS, qid: str = "qid",
                qvec: str = "qvec", vid: str = "id", vvec: str = "embedding") -> DataFrame:
    """Exact cosine top-k per query: ``(qid, id, score, rank)``; ties by lower id.
    Each partition forwards at most k rows per query."""
    schema = _schema(queries, qid, vectors, vid)
    parts = [_block_topk(*x, schema, k, None) for block in _blocks(queries, qid)
             if (x := _dense(block, vectors, qid, qvec, vid, vvec))]
    out = _union(parts) if parts else vectors.sparkSession.createDataFrame([], schema + ", rank long")
    return out.withColumnRenamed("doc", vid).withColumnRenamed("qid", qid)


def centroids(vectors: DataFrame, group_col: str, vec_col: str = "embedding", out_col: str = "qvec") -> DataFrame:
    """Mean vector per group (element-wise), as ``(group, out_col array<double>)``."""
    e = vectors.select(group_col, F.posexplode(vec_col).alias("_i", "_x"))
    per_dim = e.groupBy(group_col, "_i").agg(F.avg("_x").alias("_m"))
    return (per_dim.groupBy(group_col)
            .agg(F.array_sort(F.collect_list(F.struct("_i", "_m"))).alias("_l"))
            .select(group_col, F.transform("_l", lambda x: x["_m"]).alias(out_col)))


# ----------------------------------------------------------- keyword search

def search_postings(queries: DataFrame, index: Postings, k: int = NUM_RESULTS, qid: str = "qid",
                    qtext: str = "text") -> DataFrame:
    """BM25 top-k per query from a stored index: ``(qid, doc, score, rank)``;
    idf = ln(1 + (N - df + 0.5)/(df + 0.5)), ties by lower id after rounding the
    score to 1e-9 (so engines agree on near-equal sums). Each partition forwards at
    most k rows per query."""
    spark = queries.sparkSession
    docs = index.table(spark, "docs")
    hits = f"qid {queries.schema[qid].dataType.simpleString()}, doc long, score double"
    parts = [_block_topk(scorer, gathered_blocks(rows, index), hits, k, 9) for block in _blocks(queries, qid)
             if (x := keyword_side(block, index, qid, qtext, _array)) for scorer, rows in [x]]
    if not parts:
        return spark.createDataFrame([], _schema(queries, qid, docs, "id") + ", rank long")
    return _named(_union(parts), docs).select("qid", "doc", "score", "rank")


def _named(hits: DataFrame, docs: DataFrame) -> DataFrame:
    """Hits by the documents' numbers with their ids; where the hits are few, Spark ships
    them to the scan of the numbers."""
    return docs.select(F.col("n").alias("doc"), "id").join(hits, "doc").drop("doc").withColumnRenamed("id", "doc")


def keyword_topk(queries: DataFrame, docs: DataFrame, k: int = NUM_RESULTS, qid: str = "qid",
                 qtext: str = "text", id_col: str = "id", text_col: str = "content", k1: float = BM25_K1,
                 b: float = BM25_B) -> DataFrame:
    """:func:`search_postings` over an index that is built of ``docs`` for this search: the corpus
    is tokenised once, whatever the number of query blocks."""
    return search_postings(queries, build_postings(docs, None, id_col, text_col, k1, b), k, qid, qtext)


def skipped_blocks(queries: DataFrame, index: Postings, k: int = NUM_RESULTS, qid: str = "qid",
                   qtext: str = "text") -> DataFrame:
    """``(met, skipped)``: how many (query, block of documents) pairs share a term, and for how
    many of them the bounds alone show that none of the query's top k is in the block."""
    def count(scorer):
        def run(batches):
            known = scorer.value
            known.met = known.skipped = 0
            for _ in _partition_topk(scorer, k, 9)(batches):
                pass
            yield pd.DataFrame({"met": [known.met], "skipped": [known.skipped]})
        return run

    parts = [gathered_blocks(rows, index).mapInPandas(count(scorer), "met long, skipped long") for block in _blocks(queries, qid)
             if (x := keyword_side(block, index, qid, qtext, _array)) for scorer, rows in [x]]
    none = queries.sparkSession.createDataFrame([(0, 0)], "met long, skipped long")
    return _union([none, *parts]).agg(F.sum("met").alias("met"), F.sum("skipped").alias("skipped"))


# ------------------------------------------------------------------ fusion

class _Pairs:
    """Wanted (query, document) pairs of a block of queries, by document."""

    def __init__(self, qids: np.ndarray, pairs: pd.DataFrame):
        place = {x: i for i, x in enumerate(_column(qids).tolist())}
        q = pairs["qid"].map(place)
        known = q.notna().to_numpy()  # a query without terms has no list
        doc, self.n_queries = pairs["doc"].to_numpy()[known], len(qids)
        self.docs = np.unique(doc)
        self.keys = np.sort(np.searchsorted(self.docs, doc) * self.n_queries + q[known].to_numpy(dtype=np.int64))

    def among(self, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place among ``docs``, query) of the wanted pairs."""
        if not len(self.docs):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        at = np.minimum(np.searchsorted(self.docs, docs), len(self.docs) - 1)
        own = np.flatnonzero(self.docs[at] == docs)
        lo, hi = (np.searchsorted(self.keys, (at[own] + x) * self.n_queries) for x in (0, 1))
        key = np.repeat(lo - np.cumsum(hi - lo) + hi - lo, hi - lo) + np.arange((hi - lo).sum())
        return np.repeat(own, hi - lo), self.keys[key] % self.n_queries


def _pair_scores(scorer, pairs):
    """Rounded scores of the wanted pairs that have one."""
    def run(batches):
        known, wanted = scorer.value, pairs.value
        for docs, s in known.tables(batches, np.full(len(known.qids), -np.inf)):
            row, q = wanted.among(docs)
            good = s[row, q] > -np.inf
            row, q = row[good], q[good]
            yield pd.DataFrame({"qid": _column(known.qids)[q], "doc": docs[row], "score": np.round(s[row, q], 9)})
    return run


class _Targets:
    """Documents of a block of queries whose ranks are wanted, in the order of the lists."""

    #: Rounded scores in units of 1e-9 lie below half of this; a key has a query and a score.
    SPAN = 1 << 50

    def __init__(self, qids: np.ndarray, targets: pd.DataFrame):
        place = {x: i for i, x in enumerate(_column(qids).tolist())}
        q = targets["qid"].map(place).to_numpy(dtype=np.int64)
        doc, score = targets["doc"].to_numpy(dtype=np.int64), targets["score"].to_numpy()
        order = np.lexsort((doc, self.key(q, score)))
        self.q, self.doc, self.score = q[order], doc[order], score[order]
        self.keys = self.key(self.q, self.score)
        self.floor = np.full(len(qids), np.inf)
        np.minimum.at(self.floor, q, score - 1e-9)

    def key(self, q: np.ndarray, score: np.ndarray) -> np.ndarray:
        return q * self.SPAN + self.SPAN // 2 - np.rint(score * 1e9).astype(np.int64)

    def ahead(self, q: np.ndarray, score: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """How many of the given entries stand ahead of each target."""
        keys = np.sort(own := self.key(q, score))
        out = np.searchsorted(keys, self.keys) - np.searchsorted(keys, self.q * self.SPAN)
        at = np.minimum(np.searchsorted(self.keys, own), len(self.keys) - 1)
        tie = np.flatnonzero(self.keys[at] == own)  # entries with the score of a target: ids decide
        if len(tie):
            mine = np.flatnonzero(np.isin(self.keys, own[tie]))
            k, d = np.concatenate([own[tie], self.keys[mine]]), np.concatenate([doc[tie], self.doc[mine]])
            target = np.arange(len(k)) >= len(tie)
            order = np.lexsort((~target, d, k))  # a target stands before its equal
            before = np.cumsum(~target[order])
            group = np.searchsorted(k[order], k[order])
            count = before - np.concatenate([[0], before])[group]
            back = np.empty(len(k), np.int64)
            back[order] = count
            out[mine] += back[len(tie):]
        return out


def _counts_ahead(scorer, targets):
    """For each target: how many documents of the partition stand ahead of it in the query's list."""
    def run(batches):
        known, wanted = scorer.value, targets.value
        total, held, pending = np.zeros(len(wanted.q), dtype=np.int64), [], 0

        def add():
            docs, q, s = (np.concatenate(x) for x in zip(*held))
            return wanted.ahead(q, np.round(s, 9), docs)

        for docs, s in known.tables(batches, wanted.floor):
            row, q = np.nonzero((s >= wanted.floor[None, :]) & (s > -np.inf))
            held.append((docs[row], q, s[row, q]))
            pending += len(row)
            if pending > 1_000_000:
                total += add()
                held, pending = [], 0
        if held:
            total += add()
        some = total > 0
        yield pd.DataFrame({"qid": _column(known.qids)[wanted.q[some]], "doc": wanted.doc[some], "ahead": total[some]})
    return run


def _ranks(scorer, corpus: DataFrame, top: DataFrame, candidates: DataFrame, schema: str) -> DataFrame:
    """``(qid, doc, r)`` of all candidates that have a score, from the stored ``top`` and two more passes
    for the others. The other candidates of the query block, at most as many as the
    two top lists have, are broadcast."""
    context = corpus.sparkSession.sparkContext
    listed = top.select("qid", "doc", F.col("rank").alias("r"))
    missing = candidates.join(listed, ["qid", "doc"], "left_anti").toPandas()
    if missing.empty:
        return listed
    pairs = context.broadcast(_Pairs(scorer.value.qids, missing))
    scored = write_once(corpus.mapInPandas(_pair_scores(scorer, pairs), schema), "pair_scores")
    rows = scored.toPandas()
    if rows.empty:
        return listed
    targets = context.broadcast(_Targets(scorer.value.qids, rows))
    ahead = (corpus.mapInPandas(_counts_ahead(scorer, targets), schema.replace("score double", "ahead long"))
             .groupBy("qid", "doc").agg(F.sum("ahead").alias("ahead")))
    others = scored.join(ahead, ["qid", "doc"], "left")
    return listed.unionByName(others.select("qid", "doc", (F.coalesce("ahead", F.lit(0)) + 1).alias("r")))


def hybrid_topk(queries: DataFrame, docs: DataFrame, k: int = NUM_RESULTS, rrf_k: int = RRF_K, qid: str = "qid",
                qvec: str = "qvec", qtext: str = "text", id_col: str = "id", vec_col: str = "embedding",
                text_col: str = "content") -> DataFrame:
    """Reciprocal rank fusion of the vector and the keyword list:
    ``(qid, doc, fused, rank_v, rank_k, rank)``. A doc's fused score is the sum of
    1/(rrf_k + rank) over the lists it is in, its rank in each taken over the
    whole corpus; ties by doc.

    Exact without ranking every pair: the first k docs of the vector list score at
    least 1/(rrf_k + k), and a doc outside the first m of both lists at most
    2/(rrf_k + m + 1), which is less for m = rrf_k + 2k. So the answer is among the
    first m of either list. Their ranks in the other list come from one more pass
    that counts the docs ahead of them, summed over partitions. Each block of queries
    writes its ranks; all are joined and fused in Spark.
    """
    m = rrf_k + 2 * k
    spark, folder, blocks = docs.sparkSession, shared_dir(docs.sparkSession, "ranks"), 0
    schema = f"qid {queries.schema[qid].dataType.simpleString()}, doc long, score double"
    # embedded once; both lists go by the documents' numbers, which are in the order of their ids
    corpus = write_once(docs.select(F.monotonically_increasing_id().alias("r"), F.col(id_col).alias("id"), vec_col, text_col), "hybrid")
    index = build_postings(corpus.select(F.struct("id", "r").alias("id"), text_col), None, "id", text_col)
    numbers = index.table(spark, "docs").select("n", F.col("id.id").alias("id"), F.col("id.r").alias("row"))
    vectors = write_once(corpus.select(F.col("r").alias("row"), vec_col).join(numbers.select("n", "row"), "row")
                         .select(F.col("n").alias("id"), F.col(vec_col).alias("v")), "hybrid_vectors")
    for block in _blocks(queries, qid):
        found = keyword_side(block, index, qid, qtext, _array)
        # brought together once for the passes over them
        sides = [_dense(block, vectors, qid, qvec, "id", "v"),
                 (found[0], write_once(gathered_blocks(found[1], index), "gathered")) if found else None]
        tops = [write_once(_block_topk(*x, schema, m, 9), "top") if x else None for x in sides]
        listed = [t.select("qid", "doc") for t in tops if t is not None]
        if listed:
            candidates = _union(listed).distinct()
            for n, (side, top) in enumerate(zip(sides, tops)):
                if side:
                    _ranks(*side, top, candidates, schema).write.parquet(f"{folder}/block={blocks}/list={n}")
            blocks += 1
    if not blocks:
        return spark.createDataFrame([], _schema(queries, qid, docs, id_col).replace(
            "score double", "fused double, rank_v long, rank_k long, rank long"))
    fused = (spark.read.parquet(folder).groupBy("qid", "doc")
             .agg(F.sum(F.lit(1.0) / (F.lit(rrf_k) + F.col("r"))).alias("fused"),
                  F.max(F.when(F.col("list") == 0, F.col("r"))).alias("rank_v"),
                  F.max(F.when(F.col("list") == 1, F.col("r"))).alias("rank_k")))
    w = Window.partitionBy("qid").orderBy(F.round("fused", 12).desc(), F.col("doc").asc())
    best = (fused.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
            .withColumn("rank", F.col("rank").cast("bigint")))
    return _named(best, numbers).select("qid", "doc", "fused", "rank_v", "rank_k", "rank")


# ------------------------------------------------------------------- facts

def retrieve_facts(hits: DataFrame, chunks: DataFrame, qid: str = "qid", doc: str = "doc") -> DataFrame:
    """Hits ``(qid, doc, score, rank)`` -> ``(qid, id, doc_uri, content, metadata, score, rank)``
    bound by name; blank contents are dropped after the top-k cut. The hits are
    k rows per query; they are stored first, and where they are few, Spark ships them to the
    chunk scan. (Left to itself it shuffles the chunks before it knows the hits' size.)"""
    c = chunks.select(F.col("id").alias(doc), "doc_uri", "content", "metadata")
    score = F.col("score") if "score" in hits.columns else F.lit(None).cast("double")
    j = c.join(shipped(hits.select(qid, doc, score.alias("score"), "rank"), "hits"), doc)
    return (j.filter(F.length(normalize_ws("content")) > 0)
            .select(qid, F.col(doc).alias("id"), "doc_uri", "content", "metadata", "score", "rank"))


def facts_json(facts: DataFrame, qid: str = "qid", queries: DataFrame | None = None) -> DataFrame:
    """``{"fact_1": ..., "fact_2": ...}`` in rank order, two-space indent, numbered
    after blank hits are gone; ``{}`` when none. ``(qid, facts, n_facts)``.
    Pass ``queries`` (with ``qid``) to get a row for queries without hits too."""
    g = facts.groupBy(qid).agg(F.array_sort(F.collect_list(F.struct("rank", "content"))).alias("_l"))
    if queries is not None:
        g = queries.select(qid).join(g, qid, "left").withColumn(
            "_l", F.coalesce("_l", F.array().cast(g.schema["_l"].dataType)))
    entries = F.transform("_l", lambda x, i: F.concat(F.lit('"fact_'), (i + 1).cast("string"), F.lit('": '),
                                                      json_string(x["content"])))
    body = F.array_join(entries, ",\n  ")
    return g.select(qid, F.when(F.size("_l") == 0, F.lit("{}"))
                    .otherwise(F.concat(F.lit("{\n  "), body, F.lit("\n}"))).alias("facts"),
                    F.size("_l").cast("bigint").alias("n_facts"))


# ----------------------------------------------------- change feed / refresh

def snapshot_diff(before: DataFrame, after: DataFrame, key: str = "id",
                  cols: list[str] | None = None) -> DataFrame:
    """Change rows between two versions: ``insert``, ``delete``,
    ``update_preimage`` and ``update_postimage`` (null-safe compare of ``cols``).

    One full outer join on the key; the pre/post structs are exploded, so each
    side is read once.
    """
    cols = cols or [c for c in after.columns if c != key]
    b = before.select(F.col(key).alias("_k"), F.struct(*cols).alias("_pre"))
    a = after.select(F.col(key).alias("_k2"), F.struct(*cols).alias("_post"))
    j = b.join(a, F.col("_k") == F.col("_k2"), "full")
    k = F.coalesce("_k", "_k2")
    same = null_safe_equal([F.col(f"_pre.{c}") for c in cols], [F.col(f"_post.{c}") for c in cols])
    changes = (F.when(F.col("_k").isNull(), F.array(F.struct(F.lit("insert").alias("t"), F.col("_post").alias("r"))))
               .when(F.col("_k2").isNull(), F.array(F.struct(F.lit("delete").alias("t"), F.col("_pre").alias("r"))))
               .when(~same, F.array(F.struct(F.lit("update_preimage").alias("t"), F.col("_pre").alias("r")),
                                    F.struct(F.lit("update_postimage").alias("t"), F.col("_post").alias("r")))))
    return (j.select(k.alias(key), F.explode(changes).alias("_c"))
            .select(key, F.col("_c.t").alias("_change_type"), *[F.col(f"_c.r.{c}").alias(c) for c in cols]))


def changed_keys(before: DataFrame, after: DataFrame, key: str = "id", cols: list[str] | None = None) -> DataFrame:
    """``(key, _change_type)`` of :func:`snapshot_diff`. The versions are compared by a SHA-256 of
    ``cols``, so that only keys and digests are shuffled."""
    cols = cols or [c for c in after.columns if c != key]
    digests = [df.select(key, F.unhex(F.sha2(F.to_json(F.struct(*cols)), 256)).alias("_digest")) for df in (before, after)]
    return snapshot_diff(*digests, key).select(key, "_change_type")


def sync_index(index: DataFrame | None, source: DataFrame, changes: DataFrame | None = None,
               key: str = "id", text_col: str = "content", embed_with=None, row_col: str | None = None) -> DataFrame:
    """Refresh a vector index table from its source table.

    First run (``index is None``): embed everything. Later runs: embed only
    inserted rows and update post-images from ``changes`` (a change feed from
    :func:`snapshot_diff`), drop deleted and updated keys from the old index and
    union the new rows. Output ``(key, …source columns…, embedding, synced)``
    where ``synced`` marks rows embedded in this run. Neither table's rows are shuffled:
    both are stored with their numbers in ``row_col`` (:func:`~tessera.operators.joins.numbered`);
    without that column they are stored here.
    """
    embed_fn = embed_with or (lambda df: embed(df, text_col))
    if index is None:
        return embed_fn(source).withColumn("synced", F.lit(True))
    touched = changes.filter(F.col("_change_type").isin("insert", "update_postimage")).select(key)
    gone = changes.filter(F.col("_change_type").isin("delete", "update_preimage")).select(key).distinct()
    if row_col is None:
        row_col, index, source = "_r", numbered(index, "index"), numbered(source, "source")
    fresh = embed_fn(marked(source, touched, key, "_touched", row_col).where("_touched").drop("_touched", row_col)).withColumn("synced", F.lit(True))
    kept = marked(index, gone, key, "_gone", row_col).where("NOT _gone").withColumn("synced", F.lit(False))
    return kept.select(*fresh.columns).unionByName(fresh)


# ----------------------------------------------------------------- answers

def echo_model(questions: pd.Series, contexts: pd.Series) -> pd.Series:
    """Offline stand-in for the answer model: repeats the question and context."""
    return pd.Series([f"Echo: {q}\n{c}" for q, c in zip(questions, contexts)])


def answer_questions(questions: DataFrame, facts: DataFrame, model_fn: Callable = echo_model,
                     qid: str = "qid", text_col: str = "text", speaker: str = "Response Agent",
                     structured: DataFrame | None = None) -> DataFrame:
    """Grounded answers: question + facts JSON (+ structured rows) -> ``model_fn`` (per
    Arrow batch) -> text tagged with the speaker name. ``(qid, question, facts, answer)``.

    ``structured`` has ``(qid, data)``: the text of the table lookups for a question;
    it follows the facts in the context, under the structured speaker's tag.
    """
    j = questions.select(F.col(qid).alias("qid"), F.col(text_col).alias("question")) \
        .join(facts.select("qid", "facts"), "qid", "left") \
        .withColumn("facts", F.coalesce("facts", F.lit("{}")))
    context = F.col("facts")
    if structured is not None:
        j = j.join(structured.select("qid", "data"), "qid", "left")
        context = F.concat_ws("\n", "facts", F.when(F.col("data").isNotNull(), tag_speaker("data", "Structured Agent")))

    @F.pandas_udf(T.StringType())
    def _answer(q: pd.Series, c: pd.Series) -> pd.Series:
        return model_fn(q, c)

    return (j.withColumn("_context", context)
            .withColumn("answer", tag_speaker(_answer("question", "_context"), speaker, only_nonempty=False))
            .select("qid", "question", "facts", "answer"))
