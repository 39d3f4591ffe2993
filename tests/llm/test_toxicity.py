import random

import numpy as np
from tessera.llm import toxicity

SF = "/root/testdata/sf0.1"


def made(n, seed, bad=("idiot", "scum")):
    rng = random.Random(seed)
    words = ["alpha", "beta", "gamma", "delta", "omega", "sigma", "kappa"]
    rows, labels = [], []
    for i in range(n):
        text, toxic = rng.choices(words, k=rng.randint(5, 60)), rng.random() < 0.3
        if toxic:
            text[rng.randrange(len(text))] = rng.choice(bad) + rng.choice(["", "s", "ish"])
        rows.append((i, " ".join(text)))
        labels.append((i, int(toxic)))
    return rows, labels


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = toxicity.score_documents(docs, labels).join(labels, "doc_id").where("held_out").collect()
    true, said = np.array([r["toxic"] for r in got]), np.array([r["predicted"] for r in got])
    assert true.sum() > 50
    assert (said & true).sum() / true.sum() > 0.9 and (said & ~true & 1).sum() / (1 - true).sum() < 0.02


def test_frequencies_do_not_depend_on_slices(monkeypatch):
    texts = ["", "ab", "abcd", "Ünï cödé 漢字 text!", "x" * 300 + " idiot " + "y" * 99]
    want = [toxicity.text_frequencies(t) for t in texts]
    monkeypatch.setattr(toxicity, "SLICE", 4)
    for t, (buckets, f) in zip(texts, want):
        got = toxicity.text_frequencies(t)
        assert (got[0] == buckets).all() and np.allclose(got[1], f)
    grams = sum(len(f" {texts[3]} ") - n + 1 for n in toxicity.SIZES)
    assert abs(want[3][1].sum() - grams * 10) < 1e-6  # per thousand of at least a hundred characters


def test_scores_match_plain_sum(monkeypatch):
    rng = np.random.default_rng(1)
    buckets = np.unique(rng.integers(0, 1 << toxicity.HASH_BITS, 300_000))
    model = toxicity.Model(buckets, rng.normal(size=len(buckets)).astype(np.float32) / 500, -0.5)
    table = model.table()
    texts = [t for _, t in made(30, 5)[0]] + [None, "", "é", "long one " * 400]
    for size in (1 << 20, 50):
        monkeypatch.setattr(toxicity, "SLICE", size)
        for t, s in zip(texts, model.scores(texts, table)):
            x, f = toxicity.text_frequencies(t)
            assert abs(s - 1 / (1 + np.exp(0.5 - (table[x] * f).sum(dtype=np.float64)))) < 1e-6


def test_learns_only_allowed_rows_and_handles_odd_rows(spark):
    rows, labels = made(400, 2)
    odd = [(1000, None), (1001, ""), (None, "alpha idiot beta"), (3, rows[3][1]), (1002, ("omega " * 30 + "idiot ") * 3000)]
    docs = spark.createDataFrame([(*r, 9.0, 1) for r in rows + odd], "doc_id long, text string, score double, label int")
    more = labels + [(3, labels[3][1]), (None, 1), (5000, 1), (7, None), (1000, 0)]
    got = toxicity.score_documents(docs, spark.createDataFrame(more, "doc_id long, toxic int")).collect()
    assert len(got) == len(rows) + len(odd)
    true = dict(labels)
    seen = [r for r in got if r["doc_id"] in true]
    assert np.mean([r["predicted"] == true[r["doc_id"]] for r in seen]) > 0.98
    assert all(r["predicted"] == (r["score"] >= 0.3) and 0 <= r["score"] <= 1 for r in got)
    by = {r["doc_id"]: r["predicted"] for r in got}
    assert by[None] == 1 and by[1002] == 1 and by[1000] == 0 and by[1001] == 0


def test_labels_of_held_out_rows_do_not_matter(spark):
    rows, labels = made(300, 3)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    first = toxicity.score_documents(docs, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    held = {r["doc_id"] for r in first if r["held_out"]}
    flipped = [(i, 1 - t if i in held else t) for i, t in labels]
    second = toxicity.score_documents(docs, spark.createDataFrame(flipped, "doc_id long, toxic int")).collect()
    assert {r["doc_id"]: round(r["score"], 6) for r in first} == {r["doc_id"]: round(r["score"], 6) for r in second}


def test_empty_tables_and_single_class(spark):
    empty_docs = spark.createDataFrame([], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.score_documents(empty_docs, none).count() == 0
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    assert {r["score"] < 0.01 for r in toxicity.score_documents(docs, none).collect()} == {True}
    ones = spark.createDataFrame([(1, 1), (2, 1), (3, 1), (4, 1)], "doc_id long, toxic int")
    assert {r["predicted"] for r in toxicity.score_documents(docs, ones).collect()} == {1}


def test_one_insult_in_a_long_text_is_found(spark):
    rows, labels = made(400, 2)
    clean = random.Random(9).choices(["alpha", "beta", "gamma", "delta", "omega", "sigma", "kappa"], k=60_000)
    long = [(1000, " ".join(clean)), (1001, " ".join([*clean, "idiot"])), (1002, "omega " * 60_000 + "idiot"),
            (1003, " ".join([*clean[:30_000], "scum", *clean[30_000:]]))]
    got = toxicity.score_documents(spark.createDataFrame(rows + long, "doc_id long, text string"),
                                   spark.createDataFrame(labels, "doc_id long, toxic int")).where("doc_id >= 1000").collect()
    assert {r["doc_id"]: r["predicted"] for r in got} == {1000: 0, 1001: 1, 1002: 1, 1003: 1}


def test_highest_window_does_not_depend_on_slices(monkeypatch):
    rng = np.random.default_rng(1)
    buckets = np.unique(rng.integers(0, 1 << toxicity.HASH_BITS, 300_000))
    model = toxicity.Model(buckets, rng.normal(size=len(buckets)).astype(np.float32), -0.5, 64)
    table = model.table()
    texts = [t for _, t in made(30, 5)[0]] + [None, "", "é", "x" * 62, "x" * 63, "long one " * 400 + "idiot " + "z " * 500]
    for size in (1 << 20, 50):
        monkeypatch.setattr(toxicity, "SLICE", size)
        for t, total, start in zip(texts, *model.highest(texts, table)):
            n = len(t or "") + 2
            sums = {s: (table[x] * f).sum(dtype=np.float64) for s in range(0, max(n - 32, 1), 32)
                    for x, f in [toxicity.window_frequencies(t, s, 64)]}
            best = max(sums.values())
            assert abs(total - best) < 1e-4 and abs(sums[int(start)] - best) < 1e-4
