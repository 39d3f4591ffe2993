import itertools
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tessera.llm import packing
from tokenizers import Tokenizer

PATHS = (public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
WHOLE = Tokenizer.from_file(PATHS[0])
CHUNKS = packing.ChunkTokenizer(*PATHS)
PARTS = ["a", "the", "é", "\n", " ", "  ", "\t", "\r\n", "<|endoftext|>", "漢字", "'s", "'ll", "12", "!!", "\xa0", " ", "\x00", "\x1c",
         "　", "🙂", "idiot", " foo", "\n\n", "\x0b", "\x85"]


def ids(text):
    return WHOLE.encode(text, add_special_tokens=False).ids


def got_ids(text):
    return np.frombuffer(b"".join(CHUNKS.encode(text)), "<u4").tolist()


def test_ids_match_the_library(monkeypatch):
    rng = random.Random(2)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    texts += [" ".join(rng.choice(["foo", "bar.\nBaz", "q'll"]) for _ in range(400)), " ", "x" * 3000]
    for size in (1 << 20, 5):
        monkeypatch.setattr(packing, "SLICE", size)
        for t in texts:
            assert got_ids(t) == ids(t), t


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    assert got_ids(text) == ids(text)


def test_combinations_fill_the_window():
    got = packing.combinations(12)
    want = [c for n in (1, 2, 3) for c in itertools.combinations_with_replacement(range(12, 0, -1), n) if sum(c) == 12]
    assert sorted(got) == sorted(want)


def test_least_squares():
    rng = np.random.default_rng(1)
    for _ in range(20):
        a = rng.integers(0, 4, (12, 30)).astype(float)
        b = rng.integers(0, 50, 12).astype(float)
        x = packing.nnls(a, b)
        gain = a.T @ (b - a @ x)  # the conditions of an optimum
        assert (x >= 0).all() and gain.max() < 1e-3 * np.abs(a.T @ b).max() and np.abs(gain[x > 1e-9]).max(initial=0) < 1e-3 * np.abs(a.T @ b).max()


@settings(max_examples=25, deadline=None)
@given(st.dictionaries(st.integers(1, 32), st.integers(1, 400)))
def test_plan_places_every_piece(histogram):
    used = Counter()
    for pattern, n in packing.plan_packing(histogram, 32):
        assert n > 0 and sum(pattern) <= 32
        used.update({k: pattern.count(k) * n for k in set(pattern)})
    assert used == Counter(histogram)


def check(rows, texts):
    """Exact round trip: pieces against the library's ids, sequences against the rules."""
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_seq[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(by_doc) == set(texts)
    for i, found in by_doc.items():
        want, at = ids(texts[i] or "") + [1], 0
        for r in sorted(found, key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(want)
            assert r["ids_crc32"] == zlib.crc32(np.array(want[at:at + r["length"]], dtype="<u4").tobytes())
            at += r["length"]
        assert at == len(want)
    for found in by_seq.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
        assert at <= 2048
    assert set(by_seq) == set(range(len(by_seq)))
    return len(by_seq)


def test_documents_round_trip(spark):
    rng = random.Random(4)
    texts = {i: " ".join(rng.choice(["one", "Two", "três.\n", "  x"]) for _ in range(rng.choice([3, 200, 700, 3000]))) for i in range(300)}
    texts |= {1000: None, 1001: "", 1002: "long " * 60_000}
    docs = spark.createDataFrame([(i, t, 1) for i, t in texts.items()], "doc_id long, text string, length int").repartition(4)
    rows = packing.pack_documents(docs, *PATHS).collect()
    sequences = check(rows, texts)
    total = sum(r["length"] for r in rows)
    assert total / (2048 * sequences) > 0.93


def test_repeated_rows_null_ids_and_empty_table(spark):
    rows = [(None, "a b"), (None, "a b"), (1, "c"), (1, "c")]
    got = packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string"), *PATHS).collect()
    assert len(got) == 4 and len({(r["sequence_id"], r["offset"]) for r in got}) == 4
    assert packing.pack_documents(spark.createDataFrame([], "doc_id long, text string"), *PATHS).count() == 0
