import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from tessera.llm import hard_negatives


def plain(rows, anchors, scale=256, n_pos=5, n_neg=10, low=30, high=90):
    rows = [(i, label, [math.floor(scale * x) for x in v]) for i, label, v in rows
            if label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    last = lambda i: (i is None, i)
    out = []
    for k, (i, label, v) in enumerate(rows):
        if not anchors(i):
            continue
        scored = [(-sum(a * b for a, b in zip(v, w)), last(j), j, m) for x, (j, m, w) in enumerate(rows) if x != k]
        scored.sort(key=lambda s: s[:2])
        for p, _, positive, _ in [s for s in scored if s[3] == label][:n_pos]:
            fits = [s for s in scored if s[3] != label and low * -p <= 100 * -s[0] <= high * -p][:n_neg]
            out += [(i, positive, r + 1, j, -p, -s) for r, (s, _, j, _) in enumerate(fits)]
    return sorted(out, key=str)


def vectors(rng, n, d, labels):
    centres = [[rng.gauss(0, 1) for _ in range(d)] for _ in range(4)]
    return [(k, rng.randrange(labels), [rng.gauss(0, 1) + 2 * c for c in rng.choice(centres)]) for k in range(n)]


@pytest.mark.parametrize("block, batch, group", [(4096, 128, 8), (16, 3, 5), (7, 1, 1)])
def test_rows_match_brute_force(spark, monkeypatch, block, batch, group):
    for name, value in (("BLOCK", block), ("BATCH", batch), ("GROUP", group)):
        monkeypatch.setattr(hard_negatives, name, value)
    rng = random.Random(block)
    rows = vectors(rng, 150, 13, 3)
    rows += [(k, 1, rows[0][2]) for k in range(500, 560)] + [(k, 2, rows[0][2]) for k in range(600, 620)]  # copies and ties
    rows += [(7, 2, rows[3][2]), (7, 2, rows[3][2]), (10, 0, rows[5][2]), (None, 1, rows[9][2]), (None, 1, rows[9][2])]
    rows += [(700, None, rows[0][2]), (710, 1, None), (720, 1, [1.0, None]), (730, 1, [float("nan")]), (740, 1, [float("-inf")]),
             (750, 1, []), (760, 2, [1.5]), (770, 9, [3.0] * 20), (780, 2, [0.0] * 13), (-20, 1, [-x for x in rows[0][2]])]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, label int, embedding array<double>, rank string, a int")
    got = hard_negatives.hard_negatives(df, F.col("vec_id") % 10 == 0)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(map(tuple, got.collect()), key=str) == plain(rows, lambda i: i is not None and i % 10 == 0)


def test_pairs_of_the_index_are_complete():
    rng = np.random.default_rng(1)
    for d, n in ((1, 5), (20, 300), (64, 500)):
        rows = np.floor(100 * rng.standard_normal((n, d)) * rng.uniform(0, 2, d))
        queries = np.floor(100 * rng.standard_normal((9, d)))
        products = queries @ rows.T
        for share in (0.999, 0.9, 0.5, 0.0):
            least = np.quantile(products, share, axis=1)
            index = hard_negatives.SuffixIndex(rows, float((least / np.linalg.norm(queries, axis=1)).min()))
            got = {(a, b): c for a, b, c in zip(*map(np.ndarray.tolist, index.pairs(queries, least)))}
            assert got == {(a, b): products[a, b] for a, b in zip(*np.nonzero(products >= least[:, None]))}
    assert sum(index.sizes) <= 500 * 8


def test_dimensions_are_omitted_and_pairs_pruned(monkeypatch):
    rng = np.random.default_rng(2)
    rows = np.floor(256 * rng.standard_normal((2000, 64)) * np.linspace(1, 0.05, 64))
    queries = rows[:50]
    least = 0.9 * np.linalg.norm(queries, axis=1) ** 2
    index = hard_negatives.SuffixIndex(rows, float((least / np.linalg.norm(queries, axis=1)).min()))
    assert sum(index.sizes) < 0.7 * 8 * 2000  # list entries against all groups of all rows
    computed = []
    products = index._products
    monkeypatch.setattr(index, "_products", lambda a, q, x, most: computed.append(len(q)) or products(a, q, x, most))
    index.pairs(queries, least)
    assert sum(computed) < 0.05 * 50 * 2000


def test_large_components_are_exact(spark):
    rows = [(0, 1, [2.0 ** 23, 1.0]), (1, 1, [2.0 ** 23, 3.0]), (2, 2, [2.0 ** 22, 1.0]), (3, 2, [2.0 ** 22, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    got = hard_negatives.hard_negatives(df, F.col("vec_id") == 0)
    assert sorted(map(tuple, got.collect()), key=str) == plain(rows, lambda i: i == 0)


def test_query_and_empty_tables(spark):
    rng = random.Random(3)
    rows = [(k, rng.randrange(10), [rng.gauss(0, 0.1) for _ in range(16)]) for k in range(420)]
    moved = [(k, (m + 1) % 10 if k % 7 == 0 else m, v) for k, m, v in rows]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    got = hard_negatives.mine_embeddings(df)
    assert sorted(map(tuple, got.collect()), key=str) == plain(moved, lambda i: i % 100 == 0)
    assert hard_negatives.mine_embeddings(df.limit(0)).count() == 0
    assert hard_negatives.mine_embeddings(df.where("vec_id = 5")).count() == 0
    assert hard_negatives.mine_embeddings(df.where("vec_id = 100")).count() == 0
