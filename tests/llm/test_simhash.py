import random
from collections import Counter

import numpy as np
import pytest
import xxhash
from tessera.llm import simhash
from tessera.llm.components import component_roots

SCHEMA = "doc_id long, text string, fp string, component_id string"


def plain_fingerprint(text, k=4):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for white in "\t\n\x0b\x0c\r":
        low = low.replace(white, " ")
    words = [w for w in low.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i:i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps, radius):
    """Least index reachable from each index over links of at most ``radius`` bits."""
    root = list(range(len(fps)))
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(fps):
            for j, b in enumerate(fps):
                if (a ^ b).bit_count() <= radius and root[j] < root[i]:
                    root[i], changed = root[j], True
    return root


def sample_texts(n=90, seed=1):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    texts = [None, "", " \t\n", "One", "one", "a b", "a b c d", "Ärger Ä é", "x" * 5000]
    for _ in range(n):
        if rng.random() < 0.5 or len(texts) < 12:
            texts.append(" ".join(rng.choices(words, k=rng.randint(1, 120))))
        else:
            body = (rng.choice(texts) or "").split(" ")
            body[rng.randrange(len(body))] = rng.choice(words)
            texts.append(rng.choice([" ", "\n", "  "]).join(body).title())
    return texts


def test_fingerprint_matches_plain(monkeypatch):
    for text in sample_texts():
        want = plain_fingerprint(text)
        assert simhash.fingerprint((text or "").encode()) == want
        monkeypatch.setattr(simhash, "SLICE", 13)
        assert simhash.fingerprint((text or "").encode()) == want
        monkeypatch.setattr(simhash, "SLICE", 4 << 20)


def test_components_match_brute_force(spark):
    texts = sample_texts()
    ids = [3 * i + 7 for i in range(len(texts))]
    rows = [(i, t, "x", "y") for i, t in zip(ids, texts)] + [(ids[15], texts[15], "x", "y"), (None, texts[16], None, None)]
    got = simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    fps = [plain_fingerprint(t) for t in texts]
    roots = plain_components(fps, 4)
    assert len({r for r in roots}) < len(roots) - 5
    want = {i: (f"{fp:016x}", ids[r]) for i, fp, r in zip(ids, fps, roots)}
    for r in got:
        at = r["doc_id"] if r["doc_id"] is not None else ids[16]
        assert (r["fingerprint"], r["component_id"]) == want[at]


def test_masks_cover_every_set_within_the_radius():
    rng = random.Random(2)
    for positions in (list(range(64)), list(range(0, 60, 2))):
        masks = simhash.covering_masks(4, positions)
        assert len(masks) == 31
        for _ in range(3000):
            flips = sum(1 << p for p in rng.sample(positions, 4))
            assert any(not m & flips for m in masks)
        assert all(len(positions) // 3 < m.bit_count() < len(positions) * 0.65 for m in masks)


def test_large_buckets_are_split_without_losing_links(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BUCKET", 6)
    rng = random.Random(4)
    base = [rng.getrandbits(64) for _ in range(6)]
    fps = sorted({b ^ sum(1 << p for p in rng.sample(range(0, 64, 5), rng.randint(0, 7))) for b in base for _ in range(60)}
                 | {rng.getrandbits(64) for _ in range(30)})
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    links = simhash.near_links(spark.createDataFrame([(x,) for x in signed], "fp long"), 4)
    found = links.collect()
    assert all((r["a"] ^ r["b"]) & ((1 << 64) - 1) != 0 and ((r["a"] ^ r["b"]) & ((1 << 64) - 1)).bit_count() <= 4 for r in found)
    roots = {r["node"]: r["root"] for r in component_roots(spark.createDataFrame(found, "a long, b long")).collect()}
    want = plain_components(fps, 4)
    got = [roots.get(s, s) for s in signed]
    assert {tuple(i for i, g in enumerate(got) if g == v) for v in set(got)} == \
        {tuple(i for i, w in enumerate(want) if w == v) for v in set(want)}


def test_exactly_one_hot_table_keeps_its_links(spark, monkeypatch):
    """All fingerprints share the key of one table, and few share that of another."""
    monkeypatch.setattr(simhash, "BUCKET", 8)
    rng = random.Random(8)
    mask = simhash.covering_masks(4, list(range(64)))[5]
    key, free = rng.getrandbits(64) & mask, [p for p in range(64) if not mask >> p & 1]
    bases = [key | sum(rng.getrandbits(1) << p for p in free) for _ in range(25)]
    fps = sorted({b ^ flip for b in bases for flip in [0, sum(1 << p for p in rng.sample(free, 3))]})
    other = [m for m in simhash.covering_masks(4, list(range(64))) if m != mask]
    assert max(Counter(f & m for f in fps).most_common(1)[0][1] for m in other) <= 8 < len(fps)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    found = simhash.near_links(spark.createDataFrame([(x,) for x in signed], "fp long"), 4).collect()
    roots = {r["node"]: r["root"] for r in component_roots(spark.createDataFrame(found, "a long, b long")).collect()}
    want, got = plain_components(fps, 4), [roots.get(s, s) for s in signed]
    assert {tuple(i for i, g in enumerate(got) if g == v) for v in set(got)} == \
        {tuple(i for i, w in enumerate(want) if w == v) for v in set(want)}


def test_spanning_links_connect_and_stay_few():
    rng = np.random.default_rng(1)
    fps = np.unique(rng.integers(0, 1 << 12, 300, dtype=np.uint64))
    a, b = simhash.spanning_links(fps, 4)
    assert len(a) == len(fps) - 1  # twelve bits: all are connected
    assert (np.bitwise_count(a ^ b) <= 4).all()


def test_one_of_each_group_stays(spark):
    rows = [(5, "a b c d e", "k"), (2, "A b c d e", "k"), (2, "A b c d e", "k"), (None, "a b c d E", "k"),
            (9, "other words here now", "k"), (None, "", "k"), (None, None, "k"), (11, "zz yy xx ww vv", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    got = sorted((r["doc_id"] or 0, r["text"] or "") for r in simhash.one_of_each_group(docs).collect())
    assert got == [(0, ""), (2, "A b c d e"), (9, "other words here now"), (11, "zz yy xx ww vv")]
    assert simhash.one_of_each_group(docs).columns == docs.columns


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert simhash.near_duplicates(docs).count() == 0
    assert simhash.one_of_each_group(docs).count() == 0


@pytest.mark.parametrize("n", [2, 40])
def test_components_of_a_path(spark, n):
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(0, 0)], "a long, b long")
    assert {(r["node"], r["root"]) for r in component_roots(edges).collect()} == {(i, 0) for i in range(1, n + 1)}
