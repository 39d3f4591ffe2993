"""Hard negatives by threshold joins over an inverted index of vectors.

An anchor's positives are the rows of its label with the highest inner products;
its hard negatives are the rows of other labels with the highest products in a
window below that of a positive. Both are searches for the first rows above a
threshold. The threshold starts high; windows that have enough rows are done,
for the others it is lowered to the window's end.

Rows are dealt to blocks, and each block meets the anchors in bounded batches
(L2AP: Anastasiu and Karypis, 2014). A block's index has a list for each group of
dimensions, those with the most weight first. By the Cauchy-Schwarz inequality,
the last dimensions of a row, whose norm times the anchor's can't reach the
threshold, are omitted: a row that an anchor meets in these alone can't be found.
Products are summed list by list; pairs whose sum and remaining norms stay below
the anchor's threshold are dropped, and those that are left are computed exactly.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import prepare, stored

POSITIVES, NEGATIVES, LOW, HIGH = 5, 10, 30, 90
#: Rows of a block, anchors and dimensions taken at a time.
BLOCK, BATCH, GROUP = 4096, 128, 8
#: How far thresholds go down to the window's end, round by round.
POSITIVE_STEPS, NEGATIVE_STEPS = (0.3, 0.4, 1.0), (0.15, 0.4, 1.0)
#: Sums below this are exact in double precision.
EXACT = 2.0 ** 52
NO_ID = (1 << 63) - 1


class SuffixIndex:
    """Lists of a block's rows for pairs whose product is at least ``ratio`` times the query's norm."""

    def __init__(self, rows: np.ndarray, ratio: float):
        self.order = np.argsort(-(rows * rows).sum(axis=0), kind="stable")
        rows = rows[:, self.order]
        self.bounds = [*range(0, rows.shape[1], GROUP), rows.shape[1]]
        norms = self._suffix_norms(rows)
        groups = len(self.bounds) - 1
        # rows leave the lists from the first group on whose suffix norm is below the ratio
        listed = (norms[:, :groups] >= ratio * (1 - 1e-9)).sum(axis=1)
        self.place = np.argsort(-listed, kind="stable")
        self.rows, self.norms, self.listed = rows[self.place], norms[self.place], listed[self.place]
        self.sizes = [int(np.searchsorted(-self.listed, -g)) for g in range(groups)]  # rows listed beyond group g

    def _suffix_norms(self, x: np.ndarray) -> np.ndarray:
        squares = [np.einsum("ij,ij->i", x[:, a:b], x[:, a:b]) for a, b in itertools.pairwise(self.bounds)]
        sums = np.cumsum(np.array([np.zeros(len(x)), *squares[::-1]]), axis=0)[::-1]
        return np.sqrt(sums).T

    def pairs(self, queries: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, row, product) of all pairs with at least the query's ``least``, as exact integers."""
        queries = queries[:, self.order]
        norms = self._suffix_norms(queries)
        floor = least - 1e-9 * (np.abs(least) + norms[:, 0] * self.norms[:, 0].max(initial=0)) - 1e-6
        sums, groups = np.zeros((len(queries), len(self.rows))), len(self.sizes)
        for g, (a, b) in enumerate(itertools.pairwise(self.bounds)):
            size = self.sizes[g]
            if size:
                sums[:, :size] += queries[:, a:b] @ self.rows[:size, a:b].T
            if 2 * g + 2 >= groups:
                left = np.minimum(self.listed, g + 1)  # the first group not summed yet
                rest = self.norms[np.arange(len(left)), left]
                alive = sums + norms[:, left] * rest >= floor[:, None]
                if g + 1 == groups or np.count_nonzero(alive) * 16 < alive.size:
                    break
        else:
            alive = np.repeat(floor[:, None] <= 0, len(self.rows), axis=1)  # vectors without components
        q, x = np.nonzero(alive)
        parts = [np.empty(0, np.int64)]
        for k in range(0, len(q), 1 << 16):
            parts.append(self._products(queries, q[k:k + (1 << 16)], x[k:k + (1 << 16)],
                                        norms[:, 0].max() * self.norms[:, 0].max()))
        products = np.concatenate(parts)
        good = products >= least[q]
        return q[good], self.place[x[good]], products[good]

    def _products(self, queries, q, x, most) -> np.ndarray:
        if most < EXACT:
            return np.einsum("ij,ij->i", queries[q], self.rows[x]).astype(np.int64)
        # integers of any size; beyond 64 bits the conversion fails
        return np.array([sum(int(a) * int(b) for a, b in zip(queries[i], self.rows[j])) for i, j in zip(q, x)], np.int64)


def _matrix(lists: pa.ListArray, width: int = 0) -> np.ndarray:
    """Rows of a matrix; shorter vectors end in zeros."""
    lengths = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    width = max(width, int(lengths.max(initial=0)))
    out = np.zeros((len(lists), width))
    out[np.arange(width)[None, :] < lengths[:, None]] = flat
    return out


def _same_width(*parts: np.ndarray) -> list[np.ndarray]:
    width = max(x.shape[1] for x in parts)
    return [np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in parts]


class _Block:
    """The rows of a block, gathered before its first anchor."""

    def __init__(self, k: int, same: bool):
        self.k, self.same, self.parts = k, same, []

    def add(self, batch: pa.RecordBatch) -> None:
        self.parts.append((_matrix(batch.column("v")), batch.column("n").to_numpy(), batch.column("id").to_numpy(),
                           batch.column("label").to_numpy(zero_copy_only=False)))

    def meet(self, batch: pa.RecordBatch):
        """The best rows of the block for each window of the anchors."""
        if not self.parts:
            return
        rows, n, ids, labels = zip(*self.parts)
        rows, n, ids, labels = np.concatenate(_same_width(*rows)), *map(np.concatenate, (n, ids, labels))
        self.parts = [(rows, n, ids, labels)]
        anchors = _matrix(batch.column("v"), rows.shape[1])
        if anchors.shape[1] > rows.shape[1]:
            rows = np.pad(rows, ((0, 0), (0, anchors.shape[1] - rows.shape[1])))
        own, mine = batch.column("n").to_numpy(), batch.column("label").to_numpy(zero_copy_only=False)
        windows = batch.column("windows")
        first, count = windows.offsets.to_numpy()[:-1], np.diff(windows.offsets.to_numpy())
        w, lo, hi = (windows.values.field(name).to_numpy() for name in ("w", "lo", "hi"))
        least = np.array([lo[a:a + c].min() for a, c in zip(first, count)], np.float64)
        norms = np.sqrt(np.einsum("ij,ij->i", anchors, anchors))
        ratio = float((least / np.maximum(norms, 1e-300)).min())
        index = SuffixIndex(rows, ratio)
        for start in range(0, len(anchors), BATCH):
            q, x, score = index.pairs(anchors[start:start + BATCH], least[start:start + BATCH])
            q = q + start
            fits = ((labels[x] == mine[q]) == self.same) & (n[x] != own[q])
            q, x, score = q[fits], x[fits], score[fits]
            for j in range(int(count[start:start + BATCH].max(initial=0))):
                there = np.flatnonzero(count[q] > j)
                at = first[q[there]] + j
                inside = (lo[at] <= score[there]) & (score[there] <= hi[at])
                there, at = there[inside], at[inside]
                order = np.lexsort((n[x[there]], ids[x[there]], -score[there], q[there]))
                there, at = there[order], at[order]
                place = np.arange(len(there)) - np.searchsorted(q[there], q[there])
                there, at = there[place < self.k], at[place < self.k]
                if len(there):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(y) for y in (own[q[there]], w[at], n[x[there]], ids[x[there]], score[there])],
                        ["a", "w", "n", "id", "score"])


def _meet(k: int, same: bool):
    def run(batches):
        block, number = None, None
        for batch in batches:
            key = 2 * batch.column("block").to_numpy() + batch.column("kind").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(key)) + 1).tolist(), len(key)]
            for a, b in itertools.pairwise(cuts):
                if a == b:
                    continue
                part = batch.slice(a, b - a)
                if key[a] // 2 != number:
                    block, number = _Block(k, same), key[a] // 2
                if key[a] % 2:
                    yield from block.meet(part)
                else:
                    block.add(part)
    return run


def _first_rows(rows: DataFrame, n_blocks: int, queries: DataFrame, k: int, same: bool) -> DataFrame:
    """The first ``k`` rows of each window (``a``, ``w``): ``n``, ``id``, ``score`` and ``rank``.

    ``queries`` has an anchor's ``n``, ``label``, ``v`` and ``windows``. Every block meets all
    anchors; anchors are a fixed share of the rows and go to each block once.
    """
    window_type = queries.schema["windows"].dataType.simpleString()
    block = F.pmod(F.xxhash64("n"), F.lit(n_blocks)).cast("int")
    index = rows.select(block.alias("block"), F.lit(0).alias("kind"), "n", "id", "label", "v",
                        F.lit(None).cast(window_type).alias("windows"))
    meeting = queries.select(F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("block"), F.lit(1).alias("kind"), "n",
                             F.lit(0).cast("long").alias("id"), "label", "v", "windows")
    dealt = index.unionByName(meeting).repartitionByRange(n_blocks, "block").sortWithinPartitions("block", "kind")
    best = Window.partitionBy("a", "w").orderBy(F.col("score").desc(), "id", "n")
    return (dealt.mapInArrow(_meet(k, same), "a bigint, w bigint, n bigint, id bigint, score bigint")
            .withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k))


def _fill(rows: DataFrame, n_blocks: int, anchors: DataFrame, windows: DataFrame, k: int, same: bool,
          steps: tuple[float, ...], name: str) -> DataFrame:
    """The first ``k`` rows of each window (``a``, ``w``, ``lo``, ``hi``), by lowering thresholds."""
    done = []
    for step in steps:
        lo = F.col("lo") if step == steps[-1] else F.greatest(
            "lo", F.ceil(F.col("hi") - (F.col("hi").cast("double") - F.col("lo")) * step))
        wanted = windows.select("a", F.struct("w", lo.alias("lo"), "hi").alias("window")).groupBy("a") \
            .agg(F.collect_list("window").alias("windows"))
        found = stored(_first_rows(rows, n_blocks, anchors.join(wanted, anchors["n"] == wanted["a"]).drop("a"), k, same), name)
        if step == steps[-1]:
            done.append(found)
            break
        full = found.where(F.col("rank") == k).select("a", "w")
        done.append(found.join(full, ["a", "w"], "left_semi"))
        windows = stored(windows.join(full, ["a", "w"], "left_anti"), name)
        if windows.isEmpty():
            break
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out


def _floor(x: Column) -> Column:
    """The floor as a double, of any size (doubles beyond 2^53 are integers)."""
    return F.when(F.abs(x) < 2.0 ** 53, F.floor(x).cast("double")).otherwise(x)


def hard_negatives(vectors: DataFrame, is_anchor: Column, id_col: str = "vec_id", label_col: str = "label",
                   vec_col: str = "embedding", scale: float = 256, n_positives: int = POSITIVES,
                   n_negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """``anchor_id``, ``positive_id``, ``rank``, ``negative_id``, ``positive_score``, ``negative_score``.

    Components ``x`` count as ``floor(scale * x)``, scores are integer inner products; higher
    scores come first, ties by smaller id. The positives of a row for which
    ``is_anchor`` holds (a condition on the columns of ``vectors``) are the first ``n_positives``
    other rows of its label; for each, the first ``n_negatives`` rows of other labels are
    returned whose score is from ``low`` to ``high`` percent of the positive's.

    Rows with a null label, a null vector or a null or non-finite component take
    no part. Ids are integers; a row with a null id comes last among ties. Rows
    with the same id are rows of their own. Shorter vectors count as ending in
    zeros. Scores beyond 64 bits are an error. An empty table, or one without
    anchors, gives no rows; other columns are ignored. A vector of many copies is
    dealt over all blocks, and no block returns more than the rows asked for.
    """
    spark = prepare(vectors.sparkSession)
    bad = F.exists(vec_col, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    rows = vectors.where(F.col(label_col).isNotNull() & F.col(vec_col).isNotNull() & ~F.coalesce(bad, F.lit(False))).select(
        F.monotonically_increasing_id().alias("n"), F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"),
        F.col(label_col).alias("label"), F.transform(vec_col, lambda x: _floor(F.lit(float(scale)) * x.cast("double"))).alias("v"),
        F.coalesce(is_anchor, F.lit(False)).alias("anchor"))
    squares = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    rows = stored(rows.withColumn("norm", F.sqrt(squares)), "vectors")
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.max("norm").alias("norm")).first()
    n_blocks = max(-(-size["n"] // BLOCK), int(spark.conf.get("spark.sql.shuffle.partitions")))
    longest = size["norm"] or 0.0
    anchors = rows.where("anchor").select("n", "label", "v")
    ends = F.ceil(F.col("norm") * longest) + 1
    every = rows.where("anchor").select(F.col("n").alias("a"), F.col("n").alias("w"), (-ends).alias("lo"), ends.alias("hi"))
    found = _fill(rows, n_blocks, anchors, every, n_positives, True, POSITIVE_STEPS, "positives")
    names = rows.where("anchor").select(F.col("n").alias("a"), F.col("id").alias("anchor_id"))
    positives = stored(found.join(names, "a").select("a", F.col("n").alias("w"), "anchor_id", F.col("id").alias("positive_id"),
                                                     F.col("score").alias("positive_score")), "positives")
    share = lambda percent: F.col("positive_score").cast("decimal(20,0)") * percent / 100
    windows = positives.where("positive_score >= 0").select(
        "a", "w", F.ceil(share(low)).cast("long").alias("lo"), F.floor(share(high)).cast("long").alias("hi"))
    negatives = _fill(rows, n_blocks, anchors, windows.where("lo <= hi"), n_negatives, False, NEGATIVE_STEPS, "negatives")
    nullable = lambda c: F.nullif(F.col(c), F.lit(NO_ID)).alias(c)
    return (negatives.withColumnsRenamed({"id": "negative_id", "score": "negative_score"}).join(positives, ["a", "w"])
            .select(nullable("anchor_id"), nullable("positive_id"), F.col("rank").cast("int").alias("rank"),
                    nullable("negative_id"), "positive_score", "negative_score"))


def mine_embeddings(embeddings: DataFrame) -> DataFrame:
    """Hard negatives of every hundredth vector; every seventh has its label moved on by one."""
    moved = embeddings.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10)
                                  .otherwise(F.col("label")))
    return hard_negatives(moved, F.col("vec_id") % 100 == 0)


HARD_NEGATIVES_SQL = """
with r as (
  select vec_id, case when vec_id % 7 = 0 then (label::bigint + 1) % 10 else label end as label,
         list_transform(embedding, lambda x: floor(256 * x::double)) as v
  from embeddings
  where label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x::double))) = 0),
s as (
  select a.vec_id as anchor_id, a.label = b.label as same, b.vec_id as id, list_dot_product(a.v, b.v)::bigint as score
  from r a, r b where a.vec_id % 100 = 0 and a.vec_id <> b.vec_id),
p as (
  select anchor_id, id as positive_id, score as positive_score from s where same
  qualify row_number() over (partition by anchor_id order by score desc, id) <= 5)
select anchor_id, positive_id,
       row_number() over (partition by anchor_id, positive_id order by score desc, id)::int as rank,
       id as negative_id, positive_score, score as negative_score
from p join s using (anchor_id)
where not same and 30 * positive_score <= 100 * score and 100 * score <= 90 * positive_score
qualify rank <= 10
"""
