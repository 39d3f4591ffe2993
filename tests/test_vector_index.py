import os
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import retrieval as rv
from tessera.operators import vector_index as vi
from tessera.plans import index_queries


def clustered(spark, n=600, groups=12, dim=16, seed=1):
    rng = np.random.default_rng(seed)
    heads = rng.normal(size=(groups, dim)) * 3
    rows = [(i, (heads[i % groups] + rng.normal(size=dim)).tolist()) for i in range(n)]
    return rows, spark.createDataFrame(rows, "id long, embedding array<double>").repartition(5)


@pytest.fixture(scope="module")
def case(spark, tmp_path_factory):
    rows, df = clustered(spark)
    queries = df.where("id % 50 = 0").select(F.col("id").alias("qid"), F.col("embedding").alias("qvec"))
    index = vi.write_index(df, str(tmp_path_factory.mktemp("index")), vi.landmark_centers(df, 24))
    return rows, df, queries, index


def pairs(df):
    return {(r.qid, r.id, r.rank) for r in df.collect()}


def test_all_cells_give_the_exact_search(spark, case):
    _, df, queries, index = case
    assert pairs(vi.index_topk(queries, index, 5, 24)) == pairs(rv.vector_topk(queries, df, 5))
    opened = vi.open_index(spark, index.path)
    assert np.array_equal(opened.centers, index.centers)
    assert pairs(vi.index_topk(queries, opened, 5, 24)) == pairs(rv.vector_topk(queries, df, 5))


def test_calibrated_probes_reach_the_recall_with_few_rows(case):
    rows, df, queries, index = case
    n_probe = vi.calibrate_probes(index, queries, 5, 0.95)
    exact = {x[:2] for x in pairs(rv.vector_topk(queries, df, 5))}
    found = {x[:2] for x in pairs(vi.index_topk(queries, index, 5, n_probe))}
    assert len(found & exact) >= 0.95 * len(exact)
    compared = [r.n_rows for r in vi.probed_rows(queries, index, n_probe).collect()]
    assert len(compared) == 12 and sum(compared) < 0.6 * len(compared) * len(rows)


def test_search_reads_only_the_probed_folders(case):
    _, _, queries, index = case
    one = vi.index_topk(queries.where("qid = 50"), index, 3, 2)
    plan = one._jdf.queryExecution().executedPlan().toString()
    probed = re.search(r"PartitionFilters: \[.*?cell#\d+ IN \(([\d,]+)\)", plan)
    assert probed and len(probed[1].split(",")) == 2


def test_blocks_of_queries(case, monkeypatch):
    _, _, queries, index = case
    want = pairs(vi.index_topk(queries, index, 4, 3))
    monkeypatch.setattr(rv, "QUERY_BLOCK", 4)
    monkeypatch.setattr(rv, "SLICE_ROWS", 7)
    assert pairs(vi.index_topk(queries, index, 4, 3)) == want


def test_kmeans_centers_cover_the_groups(spark, case):
    rows, df, queries, _ = case
    centers = vi.kmeans_centers(df, 12)
    cells = {r.id: r.cell for r in vi.with_cell(df, centers).collect()}
    assert len(cells) == len(rows) and len(centers) <= 12
    assert np.allclose(np.linalg.norm(centers, axis=1), 1)


def files(index):
    return {(c, f) for c in os.listdir(f"{index.path}/rows") if c.startswith("cell=")
            for f in os.listdir(f"{index.path}/rows/{c}") if f.endswith(".parquet")}


def test_replaced_rows_equal_a_rebuild(spark, tmp_path):
    rows, df = clustered(spark, 200, 8, 6, 2)
    centers = vi.landmark_centers(df, 14)
    index = vi.write_index(df, str(tmp_path / "a"), centers)
    before = files(index)
    cell = {r.id: r.cell for r in vi.with_cell(df, centers).collect()}
    lonely = cell[3]
    gone = [i for i in cell if cell[i] == lonely] + [17]  # a cell that gets empty, and one row more
    moved = [(20, rows[21][1]), (900, rows[5][1])]
    vi.replace_rows(index, spark.createDataFrame([m for m in moved if m[0] not in gone], "id long, embedding array<double>"),
                    spark.createDataFrame([(i,) for i in gone], "id long"))
    now = {i: v for i, v in rows if i not in gone}
    now.update((i, v) for i, v in moved if i not in gone)
    got = {r.id: (list(r.v), r.cell) for r in index.rows(spark).collect()}
    want = vi.with_cell(spark.createDataFrame(list(now.items()), "id long, embedding array<double>"), centers)
    assert got == {r.id: (list(r.embedding), r.cell) for r in want.collect()}
    touched = {f"cell={cell[i]}" for i in [*gone, 20]} | {f"cell={got[i][1]}" for i in (20, 900) if i in got}
    assert {x for x in before if x[0] not in touched} <= files(index)  # other cells keep their files


def test_null_vectors_and_empty_tables(spark, tmp_path):
    df = spark.createDataFrame([(1, None), (2, [1.0, 0.0]), (3, [0.0, 0.0])], "id long, embedding array<double>")
    index = vi.write_index(df, str(tmp_path / "a"), vi.landmark_centers(df, 2))
    q = spark.createDataFrame([(9, [1.0, 0.1]), (8, None)], "qid long, qvec array<double>")
    assert pairs(vi.index_topk(q, index, 5, 2)) == {(9, 2, 1), (9, 3, 2)}
    assert vi.index_topk(q.limit(0), index, 5, 2).count() == 0
    assert vi.calibrate_probes(index, q.limit(0), 3) == 2


def test_recall_of_the_registered_queries(spark):
    row = index_queries.q_vector_index_recall(spark, "/root/testdata/sf0.01").first()
    assert row.found >= 0.9 * row.wanted and row.rows_compared < row.rows_scanned
