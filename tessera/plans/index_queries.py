"""Queries over the stored vector index."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..operators import retrieval as rv, vector_index as vi
from ..session import shared_dir
from ..sources.tables import load_table
from .catalog import register

NEAREST = 10
#: Share of the cells that are probed. The vectors have no clusters, so many must be.
PROBED = 0.75

_INDEX_SQL = f"""
WITH e AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
n AS (SELECT CAST(ceil(sqrt(count(*))) AS BIGINT) AS c FROM e),
lm AS (SELECT v, row_number() OVER (ORDER BY md5(CAST(id AS VARCHAR))) - 1 AS cell FROM e QUALIFY cell < (SELECT c FROM n)),
sim AS (SELECT e.id, lm.cell, row_number() OVER (PARTITION BY e.id
               ORDER BY round(list_cosine_similarity(e.v, lm.v), 9) DESC, lm.cell) AS place FROM e, lm),
home AS (SELECT id, cell FROM sim WHERE place = 1),
probes AS (SELECT id AS qid, cell FROM sim, n WHERE id % 50 = 0 AND place <= ceil({PROBED} * c)),
pairs AS (SELECT q.id AS qid, e.id, round(list_cosine_similarity(q.v, e.v), 9) AS s
          FROM e q JOIN e ON q.id <> e.id WHERE q.id % 50 = 0),
approx AS (SELECT pairs.qid, pairs.id, row_number() OVER (PARTITION BY pairs.qid ORDER BY s DESC, pairs.id) AS rank
           FROM pairs JOIN home ON home.id = pairs.id JOIN probes ON probes.qid = pairs.qid AND probes.cell = home.cell
           QUALIFY rank <= {NEAREST}),
exact AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY s DESC, id) AS rank FROM pairs QUALIFY rank <= {NEAREST})
"""


def _others(hits):
    """The hits less the query itself (which is a row, too), numbered anew."""
    w = Window.partitionBy("qid").orderBy("rank")
    return (hits.where("id <> qid").withColumn("rank", F.row_number().over(w).cast("long"))
            .where(F.col("rank") <= NEAREST).select("qid", "id", "rank"))


def _indexed(spark, sf_dir):
    """(index of all vectors, query vectors, cells to probe)."""
    vectors = load_table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    n_cells = vi.cells_for(vectors.count())
    centers = vi.landmark_centers(vectors, n_cells, "vec_id")
    index = vi.write_index(vectors, shared_dir(spark, "vector_index"), centers, "vec_id")
    queries = vectors.where("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec"))
    return index, queries, -int(-PROBED * n_cells // 1)


@register("vector_index_topk", _INDEX_SQL + "SELECT qid, id, CAST(rank AS BIGINT) AS rank FROM approx")
def q_vector_index_topk(spark, sf_dir):
    """The nearest rows of every fiftieth vector among all, by the index."""
    index, queries, n_probe = _indexed(spark, sf_dir)
    return _others(vi.index_topk(queries, index, NEAREST + 1, n_probe))


@register("vector_index_recall", _INDEX_SQL + """
SELECT (SELECT count(DISTINCT qid) FROM probes) AS n_queries, (SELECT count(*) FROM exact) AS wanted,
       (SELECT count(*) FROM exact JOIN approx USING (qid, id)) AS found,
       (SELECT CAST(count(*) AS BIGINT) FROM probes JOIN home USING (cell)) AS rows_compared,
       (SELECT count(*) FROM e) * (SELECT count(DISTINCT qid) FROM probes) AS rows_scanned""")
def q_vector_index_recall(spark, sf_dir):
    """How many of the true nearest rows the index finds, and how many rows it compares for that."""
    index, queries, n_probe = _indexed(spark, sf_dir)
    approx = _others(vi.index_topk(queries, index, NEAREST + 1, n_probe))
    exact = _others(rv._union([rv._block_topk(*x, rv._schema(queries, "qid", index.rows(spark), "id"), NEAREST + 1, 9)
                               for block in rv._blocks(queries, "qid")
                               if (x := rv._dense(block, index.rows(spark), "qid", "qvec", "id", "v"))])
                    .withColumnRenamed("doc", "id"))
    compared = vi.probed_rows(queries, index, n_probe).agg(F.count(F.lit(1)).alias("n_queries"),
                                                          F.sum("n_rows").alias("rows_compared"))
    hits = exact.join(approx.select("qid", "id", F.lit(1).alias("hit")), ["qid", "id"], "left") \
        .agg(F.count(F.lit(1)).alias("wanted"), F.count("hit").alias("found"))
    n_rows = index.rows(spark).agg(F.count(F.lit(1)).alias("n"))
    one = lambda df: df.withColumn("one", F.lit(1))
    return (one(compared).join(one(hits), "one").join(one(n_rows), "one")
            .select("n_queries", "wanted", "found", "rows_compared", (F.col("n") * F.col("n_queries")).alias("rows_scanned")))
