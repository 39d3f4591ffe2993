"""A stored vector index: inverted-file cells as a partitioned table.

Every row belongs to the cell of its nearest centre (cosine). The rows are stored
by cell, one folder each, so a search reads only the folders of the cells that
are nearest to its queries and scores those rows exactly. The centres are fitted
on a bounded sample (:func:`landmark_centers`, :func:`kmeans_centers`); every row
is indexed. :func:`calibrate_probes` finds how many cells a search has to probe
for a wanted recall. :func:`~tessera.operators.retrieval.vector_topk` stays the
exact search over all rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import retrieval as rv

#: Most centres of an index; they are broadcast (at 768 dimensions about 100 MB).
MOST_CELLS = 16_384
#: Rows of the k-means sample for each centre, and queries of a calibration.
FIT_ROWS, CALIBRATION_QUERIES = 64, 256


@dataclass(frozen=True)
class VectorIndex:
    """An index folder: ``rows`` (``id``, ``v``, other columns, by ``cell``) and ``centers``."""

    path: str
    centers: np.ndarray  # unit vectors by cell

    def rows(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/rows")


def cells_for(n_rows: int) -> int:
    """The usual number of cells: the square root of the number of rows."""
    return int(min(MOST_CELLS, max(1, np.ceil(np.sqrt(n_rows)))))


def landmark_centers(vectors: DataFrame, n_cells: int, id_col: str = "id", vec_col: str = "embedding") -> np.ndarray:
    """The vectors of ``n_cells`` rows, pseudo-random by the MD5 of their ids (a bounded sample)."""
    rows = (vectors.where(F.col(vec_col).isNotNull()).select(F.md5(F.col(id_col).cast("string").cast("binary")).alias("h"),
                                                             F.col(vec_col).cast("array<double>").alias("v"))
            .orderBy("h").limit(min(n_cells, MOST_CELLS)).collect())
    return rv._unit(np.array([r.v for r in rows], dtype=np.float64)) if rows else np.zeros((0, 0))


def kmeans_centers(vectors: DataFrame, n_cells: int, id_col: str = "id", vec_col: str = "embedding",
                   rounds: int = 8, seed: int = 11) -> np.ndarray:
    """Spherical k-means centres of at most ``FIT_ROWS`` rows a centre, pseudo-random by id."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector
    n = vectors.count()
    share = min(1.0, FIT_ROWS * n_cells / max(n, 1))
    draw = F.pmod(F.xxhash64(F.lit(seed), F.col(id_col)), F.lit(1 << 30)) / float(1 << 30)
    squares = F.aggregate(F.col(vec_col).cast("array<double>"), F.lit(0.0), lambda s, x: s + x * x)
    sample = vectors.where(F.col(vec_col).isNotNull() & (draw <= share) & (squares > 0)).select(
        array_to_vector(F.col(vec_col).cast("array<double>")).alias("features"))
    model = KMeans(k=max(2, min(n_cells, MOST_CELLS)), maxIter=rounds, seed=seed, distanceMeasure="cosine").fit(sample)
    return rv._unit(np.array(model.clusterCenters()))


def _places(vectors, centers: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` nearest cells of each vector, nearest first; of equal ones the lower cell."""
    m = rv._unit(np.stack([np.asarray(x, dtype=np.float64) for x in vectors]))
    near = -np.round(m @ centers.T, 9)
    if n == 1:
        return near.argmin(axis=1)[:, None]
    return np.argsort(near, axis=1, kind="stable")[:, :n]


def with_cell(vectors: DataFrame, centers: np.ndarray, vec_col: str = "embedding") -> DataFrame:
    """``vectors`` with the column ``cell``; rows without a vector are left out."""
    shared = vectors.sparkSession.sparkContext.broadcast(centers)

    @F.pandas_udf("int")
    def cell(v: pd.Series) -> pd.Series:
        return pd.Series(_places(v, shared.value, 1)[:, 0], dtype="int32") if len(v) else pd.Series([], dtype="int32")

    return vectors.where(F.col(vec_col).isNotNull()).withColumn("cell", cell(vec_col))


def write_index(vectors: DataFrame, path: str, centers: np.ndarray, id_col: str = "id", vec_col: str = "embedding") -> VectorIndex:
    """Store every row below ``path``. Spark's rebalancing puts the rows of a cell together and
    splits a cell that holds many rows over several files and tasks."""
    spark = vectors.sparkSession
    rows = with_cell(vectors.withColumnsRenamed({id_col: "id", vec_col: "v"}), centers, "v")
    rows.hint("rebalance", "cell").write.mode("overwrite").partitionBy("cell").parquet(f"{path}/rows")
    spark.createDataFrame([(k, c.tolist()) for k, c in enumerate(centers)], "cell int, center array<double>") \
        .write.mode("overwrite").parquet(f"{path}/centers")
    return VectorIndex(path, centers)


def open_index(spark: SparkSession, path: str) -> VectorIndex:
    """An index that :func:`write_index` has stored."""
    rows = sorted(spark.read.parquet(f"{path}/centers").collect())
    return VectorIndex(path, np.array([r.center for r in rows], dtype=np.float64))


def replace_rows(index: VectorIndex, changed: DataFrame, gone: DataFrame, id_col: str = "id", vec_col: str = "embedding") -> None:
    """Put ``changed`` rows into the index and take the ids of ``gone`` (and old versions) out.
    Only the cells that lose or gain rows are written again (dynamic partition overwrite)."""
    spark = changed.sparkSession
    fresh = rv.write_once(with_cell(changed.withColumnsRenamed({id_col: "id", vec_col: "v"}), index.centers, "v"), "index_rows")
    old = index.rows(spark)
    keys = rv.write_once(gone.select(F.col(id_col).alias("id")).unionByName(fresh.select("id")).distinct(), "index_keys")
    losing = old.select("id", "cell").join(keys, "id", "left_semi").select("cell")
    cells = rv.write_once(losing.unionByName(fresh.select("cell")).distinct(), "index_cells")
    stay = old.join(F.broadcast(cells), "cell", "left_semi").join(keys, "id", "left_anti")
    # written beside first: the folders that are read must not be overwritten while they are
    new = rv.write_once(stay.select(*old.columns).unionByName(fresh.select(*old.columns)), "index_new")
    new.hint("rebalance", "cell").write.mode("overwrite").option("partitionOverwriteMode", "dynamic") \
        .partitionBy("cell").parquet(f"{index.path}/rows")
    kept = {r.cell for r in new.select("cell").distinct().collect()}
    empty = [r.cell for r in cells.collect() if r.cell not in kept]
    if empty:  # a dynamic overwrite leaves folders alone that get no row
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        for cell in empty:
            folder = hadoop(f"{index.path}/rows/cell={cell}")
            folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


class CellScorer(rv.DenseScorer):
    """Cosine of indexed rows with those queries of a block that probe the row's cell."""

    def __init__(self, qids: np.ndarray, matrix: np.ndarray, probes: np.ndarray):
        super().__init__(qids, matrix)
        cell, query = probes.ravel(), np.repeat(np.arange(len(probes)), probes.shape[1])
        order = np.argsort(cell, kind="stable")
        cuts = np.flatnonzero(np.diff(cell[order], prepend=-1))
        self.queries = dict(zip(cell[order][cuts].tolist(), np.split(query[order], cuts[1:])))

    def tables(self, batches, floor: np.ndarray):
        for part in rv._slices(batches):
            for cell, rows in part.groupby("cell", sort=False):
                own = self.queries.get(cell)
                if own is not None:
                    s = np.full((len(rows), len(self.qids)), -np.inf)
                    s[:, own] = rv._vectors(rows["v"]) @ self.matrix[own].T
                    yield rv._array(rows["id"]), s


def index_topk(queries: DataFrame, index: VectorIndex, k: int = rv.NUM_RESULTS, n_probe: int = 8, qid: str = "qid",
               qvec: str = "qvec") -> DataFrame:
    """The best ``k`` rows of the ``n_probe`` cells nearest to each query, by exact cosine:
    ``(qid, id, score, rank)``; scores are compared to nine decimals, ties by lower id.

    Query sets are taken in blocks; of the index only the folders that a block
    probes are read. Rows elsewhere can be missed: see :func:`calibrate_probes`.
    """
    spark = queries.sparkSession
    rows, parts = index.rows(spark), []
    schema = rv._schema(queries, qid, rows, "id")
    n_probe = max(1, min(n_probe, len(index.centers)))
    for block in rv._blocks(queries.where(F.col(qvec).isNotNull()), qid):
        asked = block.select(F.col(qid).alias("q"), F.col(qvec).alias("v")).orderBy("q").collect()
        if not asked or not len(index.centers):
            continue
        matrix = np.array([np.asarray(r.v, dtype=np.float64) for r in asked])
        probes = _places(matrix, index.centers, n_probe)
        scorer = spark.sparkContext.broadcast(CellScorer(rv._array([r.q for r in asked]), matrix, probes))
        needed = np.unique(probes)
        corpus = rows if len(needed) == len(index.centers) else rows.where(F.col("cell").isin(needed.tolist()))
        parts.append(rv._block_topk(scorer, corpus.select("id", "v", "cell"), schema, k, 9))
    out = rv._union(parts) if parts else spark.createDataFrame([], schema + ", rank long")
    return out.withColumnsRenamed({"doc": "id", "qid": qid})


def probed_rows(queries: DataFrame, index: VectorIndex, n_probe: int, qid: str = "qid", qvec: str = "qvec") -> DataFrame:
    """``(qid, n_rows)``: how many rows a search with ``n_probe`` cells compares with each query."""
    spark = queries.sparkSession
    shared, n_probe = spark.sparkContext.broadcast(index.centers), max(1, min(n_probe, len(index.centers)))

    @F.pandas_udf("array<int>")
    def probes(v: pd.Series) -> pd.Series:
        return pd.Series(list(_places(v, shared.value, n_probe))) if len(v) else pd.Series([], dtype=object)

    sizes = index.rows(spark).groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    probed = queries.select(F.col(qid).alias("qid"), F.explode(probes(qvec)).alias("cell"))
    return probed.join(F.broadcast(sizes), "cell").groupBy("qid").agg(F.sum("n").alias("n_rows"))


def calibrate_probes(index: VectorIndex, queries: DataFrame, k: int, target: float = 0.95, qid: str = "qid",
                     qvec: str = "qvec") -> int:
    """The least number of cells whose rows hold the share ``target`` of the true ``k`` nearest
    rows of at most ``CALIBRATION_QUERIES`` sample queries."""
    spark = queries.sparkSession
    sample = queries.select(F.col(qid).alias("qid"), F.col(qvec).alias("qvec")).orderBy(F.md5(F.col(qid).cast("string").cast("binary"))) \
        .limit(CALIBRATION_QUERIES)
    asked = sample.collect()
    if not asked:
        return len(index.centers)
    sample = spark.createDataFrame(asked, sample.schema)
    rows = index.rows(spark)
    near = rv.vector_topk(sample, rows, k=k, vvec="v").select("qid", "id")
    found = rows.select("id", "cell").join(F.broadcast(near), "id").select("qid", "cell").collect()
    order = dict(zip([r.qid for r in asked], _places([r.qvec for r in asked], index.centers, len(index.centers))))
    places = np.sort([int(np.flatnonzero(order[r.qid] == r.cell)[0]) for r in found])
    return int(places[max(0, int(np.ceil(target * len(places))) - 1)]) + 1 if len(places) else len(index.centers)
