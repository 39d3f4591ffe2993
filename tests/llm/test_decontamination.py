import random
import re

import numpy as np
from tessera.llm import decontamination


def fold(text):
    return re.sub(r"[\W_]+", " ", text.lower()).strip()


def plain_distance(item, text):
    """Least edit distance of the item to a substring of the text."""
    row, at = np.zeros(len(text) + 1, int), np.arange(len(text) + 1)
    codes = np.array([ord(c) for c in text])
    for c in item:
        now = row + 1
        now[1:] = np.minimum(row[:-1] + (codes != ord(c)), now[1:])
        row = np.minimum.accumulate(now - at) + at
    return int(row.min())


def edited(text, n, rng):
    out = list(text)
    for _ in range(n):
        p, kind = rng.randrange(len(out)), rng.randrange(3)
        out[p:p + (kind != 0)] = [] if kind == 1 else [rng.choice("abcdefgh ")]
    return "".join(out)


def words(rng, n):
    return " ".join("".join(rng.choice("abcdeént") for _ in range(rng.randint(2, 9))) for _ in range(n))


def test_matches_brute_force(monkeypatch):
    rng = random.Random(5)
    items = [(k, words(rng, rng.choice([2, 3, 4, 5, 9, 30, 45])).capitalize() + ".") for k in range(40)]
    items = [x for x in items if len(fold(x[1])) >= decontamination.SHORT]
    index = decontamination.build_index(items)
    assert all(index.edits == [int(0.1 * len(p)) for p in index.items])  # short items lose no edits
    assert len(index.parts) == 2
    texts = [None, "", "short"]
    for _ in range(120):
        item = rng.choice(items)[1]
        host = words(rng, rng.randint(0, 150))
        p = rng.randint(0, len(host))
        texts.append(host[:p] + " -- " + edited(item, rng.randint(0, int(len(item) * 0.13)), rng) + "! " + host[p:])
    want = {}
    for row, text in enumerate(texts):
        for i, points in enumerate(index.items):
            d = plain_distance("".join(map(chr, points)), fold(text or ""))
            if text and d <= index.edits[i]:
                want[row, i] = d
    assert len(want) > 60
    for size in (1 << 20, 300):
        monkeypatch.setattr(decontamination, "SLICE", size)
        assert {(r, i): d for r, i, d, _ in decontamination.matches(index, texts)} == want


def test_end_is_a_place_in_the_text():
    index = decontamination.build_index([(1, "An exact item of the benchmark, with some length.")])
    text = "Before...  an EXACT item -- of the benchmark with some length!! and after"
    (_, _, d, end), = decontamination.matches(index, [text])
    assert d == 0 and text[:end].endswith("length")


def test_many_shared_grams_are_counted_in_turns():
    rng = random.Random(9)
    base = words(rng, 30)
    items = [(k, base + words(rng, 3)) for k in range(60)]
    index = decontamination.build_index(items)
    text = " ".join([base] * 400) + items[7][1]
    got = {i: d for _, i, d, _ in decontamination.matches(index, [text])}
    assert got[7] == 0
    assert all(d == plain_distance("".join(map(chr, index.items[i])), fold(text[-3000:])) for i, d in list(got.items())[:5])


def test_short_items_are_found_between_word_borders(monkeypatch):
    rng = random.Random(2)
    items = [(1, "Paris 7"), (2, "a"), (3, "So it."), (4, "été"), (5, "cat"), (6, "x y z"), (7, " -- ")]
    index = decontamination.build_index(items)
    assert index.ids == [1, 2, 3, 4, 5, 6]
    texts = ["Paris 7", "in paris, 7!", "paris 70", "Paris-7", "cats and a concat", "CAT", "so IT, été", "x y", "x y z", "", None, "sparis 7 "]
    texts += [" ".join(rng.choice(["a", "x", "y", "z", "so", "it", "cat", "cats", "paris", "7"]) for _ in range(60)) for _ in range(50)]
    want = {(r, i) for r, t in enumerate(texts) for i, p in enumerate(index.items) if f" {''.join(map(chr, p))} " in f" {fold(t or '')} "}
    for size in (1 << 20, 9):
        monkeypatch.setattr(decontamination, "SLICE", size)
        found = decontamination.matches(index, texts)
        assert {(r, i) for r, i, d, _ in found} == want and all(d == 0 for _, _, d, _ in found)
    assert (0, 0) in want and (2, 0) not in want


def test_equal_documents_and_items_give_no_pairs(spark):
    text = "an item that many rows of the benchmark have, word for word"
    bench = spark.createDataFrame([(k, text if k % 2 else text.upper()) for k in range(200)], "item_id long, text string")
    docs = spark.createDataFrame([(k, f"Before. {text}! After.") for k in range(300)], "doc_id long, text string")
    rows = decontamination.contaminated(docs, bench).collect()
    assert len(rows) == 300 and {(r["item_id"], r["n_items"], r["distance"]) for r in rows} == {(0, 200, 0)}
    members = decontamination.item_members(bench).collect()
    assert sorted(r["member_id"] for r in members) == list(range(200)) and {r["item_id"] for r in members} == {0}


def test_query_in_blocks(spark, monkeypatch):
    rng = random.Random(11)
    items = [(k, words(rng, 20)) for k in range(12)]
    items += [(50, items[0][1].upper()), (None, items[1][1]), (51, None), (52, ""), (53, "tiny"), (0, items[0][1]), (None, "lone item without an id")]
    docs = [(1, words(rng, 50) + ". " + items[0][1] + ". " + words(rng, 9)), (2, words(rng, 90)), (None, items[1][1]), (4, None),
            (4, ""), (5, "x " * 30_000 + items[2][1]), (5, "x " * 30_000 + items[2][1]), (6, "a tiny one"), (7, "Lone item, without an id")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    frame = spark.createDataFrame([(*d, 1, 2) for d in docs], "doc_id long, text string, item_id int, n int")
    want = sorted([(1, 0, 3), (-1, 1, 2), (5, 2, 1), (5, 2, 1), (6, 53, 1), (7, -1, 1)])
    for size in (4_000_000, 300):
        monkeypatch.setattr(decontamination, "BLOCK_CHARS", size)
        found = decontamination.contaminated(frame, bench)
        got = [[-1 if x is None else x for x in r] for r in found.select("doc_id", "item_id", "n_items").collect()]
        assert sorted(map(tuple, got)) == want
        kept = decontamination.without_contaminated(frame, bench)
        assert kept.columns == frame.columns and sorted(r["doc_id"] for r in kept.collect()) == [2, 4, 4]
        # one Python stage, whatever the number of blocks
        assert kept._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == (1 if size > 300 else 0)


def test_empty_tables(spark):
    bench = spark.createDataFrame([(1, "some item of a benchmark")], "item_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    docs = spark.createDataFrame([(1, "some item of a benchmark")], "doc_id long, text string")
    assert decontamination.contaminated(docs.limit(0), bench).count() == 0
    assert decontamination.contaminated(docs, none).count() == 0
    assert decontamination.without_contaminated(docs, none).count() == 1
