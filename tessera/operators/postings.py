"""A stored inverted index with BM25 statistics and per-block score bounds.

Documents stay where they are: ``BLOCK_DOCS`` that follow each other in a partition are
a block. The index has one row per (term, block): the places in the block of the
documents that hold the term, and how often each does. A term of every document thus
has many short rows. The corpus is read once and no text is shuffled; a task
writes the rows of its own blocks. Documents are numbered in the order of their ids,
by ids alone; a block's numbers and lengths are stored beside. A search reads the rows
of its query terms only, brings those of a block together as one row, and skips a
block for each query whose summed bounds (the highest BM25 weights) can't reach the query's
current k-th score (block-max skipping).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import open_folders, shared_dir
from .ordering import assign_ids

BM25_K1, BM25_B = 1.2, 0.75
TOKEN_SPLIT = r"[^\p{L}\p{N}]+"
BLOCK_DOCS = 1024      # documents of a block
BUCKETS = 32           # folders of terms
GATHERED = 64          # blocks that are put in the order of their bounds
DOCUMENTS = -1         # folder of the documents' rows
ROW_GROUP = 8 << 20    # bytes of a row group; a task has a file open for each folder


def tokens(text_col: str) -> Column:
    return F.filter(F.split(F.lower(F.col(text_col)), TOKEN_SPLIT), lambda t: F.length(t) > 0)


@dataclass(frozen=True)
class Postings:
    """An index folder: ``docs`` (``n``, ``id``), ``terms`` (``term``, ``df``), ``blocks`` (``block``,
    and of its documents by place ``numbers`` and ``lengths``) and ``rows`` (``term``, ``block``,
    ``docs``, ``tf``, by ``bucket`` of the term)."""

    path: str
    n_docs: int
    block_docs: int
    mean: float
    k1: float
    b: float

    def postings(self, spark: SparkSession) -> DataFrame:
        """The stored rows: places of documents and counts."""
        return spark.read.schema(f"{POSTING}, bucket int").parquet(f"{self.path}/rows").where(F.col("bucket") >= 0)

    def table(self, spark: SparkSession, name: str) -> DataFrame:
        """A table of the index; the ``rows`` with the BM25 ``weights`` (without the term's idf) and the
        highest of these, ``best``."""
        if name != "rows":
            return spark.read.parquet(f"{self.path}/{name}")
        rows = self.postings(spark).join(self.table(spark, "blocks").select("block", "lengths"), "block")
        weight = F.zip_with("docs", "tf", lambda d, f: f * (self.k1 + 1) / (
            f + self.k1 * (1 - self.b + self.b * F.element_at("lengths", d.cast("int") + 1) / self.mean)))
        return (rows.withColumn("weights", weight).withColumn("best", F.array_max("weights"))
                .select("term", "block", "docs", "weights", "best", "bucket"))


POSTING = "term string, block long, docs array<smallint>, tf array<int>"


def _bucket(term: str | Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def _by_block(batches):
    """The rows of each block, gathered over batches (a block's rows follow each other)."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        block = batch.column("block").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(block)]
        for start, end in zip(cuts[:-1], cuts[1:]):
            if start == end:
                continue
            if held and held[-1].column("block")[0].as_py() != block[start]:
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
            held.append(batch.slice(start, end - start))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _list_of(table: pa.Table, name: str) -> pa.ListArray:
    column = table.column(name).combine_chunks()
    return column.chunk(0) if isinstance(column, pa.ChunkedArray) else column


def _block_rows(block_docs: int):
    """The index rows of each block of tokenised documents, and one with its ids and lengths."""
    def run(batches):
        for table in _by_block(batches):
            lists = _list_of(table, "v")
            words = lists.flatten()
            good = pc.greater(pc.binary_length(words), 0)  # a text that begins or ends with a gap has an empty token there
            place = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy())[good.to_numpy(zero_copy_only=False)]
            words = words.filter(good).dictionary_encode()
            lengths = pa.array(np.bincount(place, minlength=len(lists)), pa.int32())
            key, tf = np.unique(words.indices.to_numpy().astype(np.int64) * block_docs + place, return_counts=True)
            word, doc = key // block_docs, key % block_docs
            first = np.flatnonzero(np.diff(word, prepend=-1))
            n, block, ids = len(first), table.column("block")[0].as_py(), _list_of(table, "id")
            ends = pa.array(np.append(first, len(key)), pa.int32())
            one = pa.array([0, len(ids)], pa.int32())
            nothing = lambda kind, size=n: pa.nulls(size, pa.list_(kind))
            names = ["term", "block", "docs", "tf", "ids", "lengths"]
            yield pa.RecordBatch.from_arrays(
                [words.dictionary.take(pa.array(word[first])).cast(pa.string()), pa.array(np.full(n, block)), pa.ListArray.from_arrays(ends, pa.array(doc, pa.int16())),
                 pa.ListArray.from_arrays(ends, pa.array(tf, pa.int32())), nothing(ids.type), nothing(pa.int32())], names)
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(1, pa.string()), pa.array([block]), nothing(pa.int16(), 1), nothing(pa.int32(), 1),
                 pa.ListArray.from_arrays(one, ids), pa.ListArray.from_arrays(one, lengths)], names)
    return run


def build_postings(docs: DataFrame, path: str | None = None, id_col: str = "id", text_col: str = "content",
                   k1: float = BM25_K1, b: float = BM25_B) -> Postings:
    """Tokenise every row of ``docs`` once and store the index below ``path`` (default: a new
    folder below the shared one). A row with a null or blank text is a document without
    terms; rows with the same id are documents of their own."""
    spark = docs.sparkSession
    path = path or shared_dir(spark, "postings")
    id_type = docs.schema[id_col].dataType.simpleString()
    schema = f"{POSTING}, ids array<{id_type}>, lengths array<int>"
    words = F.coalesce(F.split(F.lower(F.col(text_col)), TOKEN_SPLIT), F.array().cast("array<string>"))
    base = docs.select(F.expr(f"monotonically_increasing_id() div {BLOCK_DOCS}").alias("block"), F.col(id_col).alias("id"), words.alias("v"))
    rows = base.mapInArrow(_block_rows(BLOCK_DOCS), schema)
    with open_folders(spark, BUCKETS + 1):
        (rows.withColumn("bucket", F.when(F.col("term").isNull(), DOCUMENTS).otherwise(_bucket("term")))
         .write.mode("overwrite").option("parquet.block.size", ROW_GROUP).partitionBy("bucket").parquet(f"{path}/rows"))
    stored = spark.read.schema(f"{schema}, bucket int").parquet(f"{path}/rows").where(F.col("bucket") == DOCUMENTS)
    ids = stored.select("block", F.posexplode("ids").alias("place", "id")).select((F.col("block") * BLOCK_DOCS + F.col("place")).alias("r"), "id")
    assign_ids(ids, ["id", "r"], start=0, id_col="n").select("n", "id", "r").write.mode("overwrite").parquet(f"{path}/docs")
    numbers = (spark.read.schema(f"n long, id {id_type}, r long").parquet(f"{path}/docs").groupBy(F.expr(f"r div {BLOCK_DOCS}").alias("block"))
               .agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "n"))), lambda x: x["n"]).alias("numbers")))
    stored.select("block", "lengths").join(numbers, "block").write.mode("overwrite").parquet(f"{path}/blocks")
    total = F.aggregate("lengths", F.lit(0).cast("bigint"), lambda x, y: x + y)
    size = (spark.read.schema("block long, lengths array<int>").parquet(f"{path}/blocks")
            .agg(F.sum(F.size("lengths")).alias("n"), F.sum(total).alias("total")).first())
    out = Postings(path, size["n"] or 0, BLOCK_DOCS, size["total"] / size["n"] if size["total"] else 1.0, k1, b)
    if size["total"]:
        out.postings(spark).groupBy("term").agg(F.sum(F.size("docs")).alias("df")).write.mode("overwrite").parquet(f"{path}/terms")
    spark.createDataFrame([(out.n_docs, out.block_docs, out.mean, k1, b, bool(size["total"]))],
                          "n_docs long, block_docs long, mean double, k1 double, b double, filled boolean") \
        .write.mode("overwrite").parquet(f"{path}/stats")
    return out


def open_postings(spark: SparkSession, path: str) -> Postings:
    """An index that :func:`build_postings` has stored."""
    stats = spark.read.parquet(f"{path}/stats").first()
    return Postings(path, stats.n_docs, stats.block_docs, stats.mean, stats.k1, stats.b)


class PostingScorer:
    """BM25 of the index's documents with a block of queries."""

    def __init__(self, qids: np.ndarray, vocabulary: dict[str, int], first, query, idf, index: Postings):
        self.qids, self.vocabulary, self.first, self.query, self.idf = qids, vocabulary, first, query, idf
        self.k1, self.b, self.mean = index.k1, index.b, index.mean
        self.met = self.skipped = 0

    def _uses(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row of the term, place in the query lists) for each query of each term."""
        count = self.first[v + 1] - self.first[v]
        row = np.repeat(np.arange(len(v)), count)
        return row, np.repeat(self.first[v] - np.cumsum(count) + count, count) + np.arange(count.sum())

    def tables(self, batches, floor: np.ndarray):
        """(document numbers, scores by query) of each block (a row of :func:`gathered_blocks`) that a query
        needs; a score is ``-inf`` without a shared term and for queries whose ``floor`` is above the block's bound."""
        gathered = []
        for pdf in batches:
            for x in pdf.itertuples(index=False):
                v, sizes, docs, tf = (np.asarray(c) for c in (x.codes, x.sizes, x.docs, x.tf))
                weight = tf * (self.k1 + 1) / (tf + self.k1 * (1 - self.b + self.b * np.asarray(x.lengths)[docs] / self.mean))
                row, at = self._uses(v)
                best = np.maximum.reduceat(weight, np.cumsum(sizes) - sizes)
                bound = np.bincount(self.query[at], weights=self.idf[at] * best[row], minlength=len(self.qids))
                gathered.append((bound, v, sizes, docs, weight, np.asarray(x.numbers), row, at))
                if len(gathered) == GATHERED:
                    yield from self._best_first(gathered, floor)
                    gathered = []
        yield from self._best_first(gathered, floor)

    def _best_first(self, gathered, floor):
        for bound, v, sizes, docs, weight, numbers, row, at in sorted(gathered, key=lambda x: -x[0].max(initial=0)):
            need = (bound > 0) & (bound * (1 + 1e-12) >= floor)
            self.met += int(np.count_nonzero(bound > 0))
            self.skipped += int(np.count_nonzero((bound > 0) & ~need))
            if not need.any():
                continue
            used = need[self.query[at]]
            place = np.cumsum(need) - 1
            idf = np.zeros((len(v), int(need.sum())))
            idf[row[used], place[self.query[at[used]]]] = self.idf[at[used]]
            held = np.zeros(len(numbers), dtype=bool)
            held[docs] = True
            weights = np.zeros((int(held.sum()), len(v)))
            weights[(np.cumsum(held) - 1)[docs], np.repeat(np.arange(len(v)), sizes)] = weight
            s = np.full((len(weights), len(self.qids)), -np.inf)
            found = weights @ idf
            s[:, need] = np.where(found > 0, found, -np.inf)
            yield numbers[held], s


def _gathered(rows: pa.Table, info: pa.Table) -> pa.Table:
    """The rows of a block as one, with the numbers and lengths of its documents."""
    if not rows.num_rows:
        return GATHERED_ARROW.empty_table()
    docs, tf = _list_of(rows, "docs"), _list_of(rows, "tf")
    row = [rows.column("block")[0].as_py(), rows.column("code").to_numpy(), pc.list_value_length(docs).to_numpy(),
           docs.flatten().to_numpy(), tf.flatten().to_numpy(), info.column("numbers")[0].values.to_numpy(), info.column("lengths")[0].values.to_numpy()]
    return pa.table([pa.array([x], f.type) for x, f in zip(row, GATHERED_ARROW)], schema=GATHERED_ARROW)


GATHERED_ARROW = pa.schema([
    ("block", pa.int64()), ("codes", pa.list_(pa.int32())), ("sizes", pa.list_(pa.int32())), ("docs", pa.list_(pa.int16())),
    ("tf", pa.list_(pa.int32())), ("numbers", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int32()))])


def gathered_blocks(rows: DataFrame, index: Postings) -> DataFrame:
    """The rows of :func:`keyword_side` with those of a block as one row, which has the numbers and
    lengths of the block's documents too. Only codes, places and counts are shuffled."""
    blocks = index.table(rows.sparkSession, "blocks")
    return (rows.select("block", "code", "docs", "tf").groupBy("block").cogroup(blocks.groupBy("block")).applyInArrow(
        _gathered, "block long, codes array<int>, sizes array<int>, docs array<smallint>, tf array<int>, numbers array<long>, lengths array<int>"))


def keyword_side(block: DataFrame, index: Postings, qid: str, qtext: str, array=np.array):
    """(broadcast scorer, index rows) of a block of queries, for :func:`gathered_blocks`; None if no query
    has a known term. Collected are the terms of
    the block's queries and how many documents have each."""
    spark = block.sparkSession
    qt = block.select(F.col(qid).alias("q"), F.explode(F.array_distinct(tokens(qtext))).alias("t")).orderBy("q", "t").collect()
    if not qt or not index.table(spark, "stats").first().filled:
        return None
    wanted = F.broadcast(spark.createDataFrame([(t,) for t in sorted({r.t for r in qt})], "term string"))
    df = {r.term: r.df for r in index.table(spark, "terms").join(wanted, "term").collect()}
    qids = list(dict.fromkeys(r.q for r in qt))
    place = {q: i for i, q in enumerate(qids)}
    vocabulary = {t: i for i, t in enumerate(sorted(df))}
    uses: list[list[int]] = [[] for _ in vocabulary]
    for r in qt:
        if r.t in vocabulary:
            uses[vocabulary[r.t]].append(place[r.q])
    if not vocabulary:
        return None
    counts = np.array([len(u) for u in uses])
    idf = np.array([np.log(1.0 + (index.n_docs - df[t] + 0.5) / (df[t] + 0.5)) for t in vocabulary])
    scorer = PostingScorer(array(qids), vocabulary, np.concatenate([[0], np.cumsum(counts)]),
                           np.array([q for u in uses for q in u], dtype=np.int64), np.repeat(idf, counts), index)
    known = F.broadcast(spark.createDataFrame(list(vocabulary.items()), "term string, code int"))
    buckets = sorted(r.b for r in known.select(_bucket("term").alias("b")).distinct().collect())
    rows = index.postings(spark).where(F.col("bucket").isin(buckets)).join(known, "term")
    return spark.sparkContext.broadcast(scorer), rows.select("block", "term", "code", "docs", "tf")
