import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tessera.llm import sentencepieces

PATH = public_tokenizers.path("piece_bpe_32k.model")
MODEL = sentencepiece.SentencePieceProcessor(model_file=PATH)
CODER = sentencepieces.PieceCoder(PATH)
PARTS = ["a", "the", "é", "\n", " ", "  ", "▁", "\t", "\r\n", "<s>", "</s>", "<unk>", "<0x0A>", "漢字", "'s", "12", "!!", "?", "\xa0",
         "\x00", "　", "ﬁ", "🙂", "é", "idiot", " foo", "\n\n", "\x85", "�", "⁇", "w" * 70]


def check(coder, text):
    want = MODEL.encode(text)
    got = coder.encode(text)
    assert got.tolist() == want, text
    assert coder.decode(got) == MODEL.decode(want), text


def test_words_are_independent():
    assert CODER.independent


@pytest.mark.parametrize("table, group, part", [(400_000, 200_000, 4 << 20), (50, 3, 4), (1, 1, 1)])
def test_texts_match_the_library(monkeypatch, table, group, part):
    for name, value in (("TABLE_WORDS", table), ("GROUP", group), ("PART", part)):
        monkeypatch.setattr(sentencepieces, name, value)
    coder, rng = sentencepieces.PieceCoder(PATH), random.Random(table)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 30))) for _ in range(1500)]
    texts += ["", " ", "\n", "   ", "a" * 3000, " " * 3000, "word " * 3000, "▁", "▁▁x", "\n a", " \n", "a  \n  b"]
    for t in texts:
        check(coder, t)
    assert len(coder.table) <= table
    assert coder.encode(None).tolist() == []


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    check(CODER, text)


def test_every_code_point():
    for start in range(0, 0x30000, 256):
        chars = [chr(c) for c in range(start, start + 256) if not 0xD800 <= c < 0xE000]
        if chars:
            check(CODER, " x".join(chars))
            check(CODER, "".join(chars))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 31_999)), max_size=20))
def test_any_ids(ids):
    assert CODER.decode(np.array(ids, "<i4")) == MODEL.decode(ids)


def test_without_proof_whole_texts_are_coded(monkeypatch):
    monkeypatch.setattr(sentencepieces, "words_are_independent", lambda m: False)
    coder = sentencepieces.PieceCoder(PATH)
    check(coder, " a  b\n▁ c<s>")
    assert not coder.table


def test_each_word_is_segmented_once(monkeypatch):
    coder, seen = sentencepieces.PieceCoder(PATH), []
    segment = coder._segment
    monkeypatch.setattr(coder, "_segment", lambda words: seen.extend(words) or segment(words))
    for t in ("one two one", "two\none three", "one two three two"):
        coder.encode(t)
    assert sorted(seen) == ["\none", "one", "three", "two"]


def test_query(spark):
    rows = [(1, "two words"), (2, None), (2, None), (None, ""), (3, "é" * 5000), (4, "  a \n b▁c"), (5, "\x00\U0010ffff <s>")]
    docs = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, ids int")
    got = sorted((tuple(r) for r in sentencepieces.round_trip_digests(docs, PATH).collect()), key=str)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = []
    for k, t in rows:
        ids = MODEL.encode(t or "")
        want.append((k, len(ids), sha(",".join(map(str, ids))), sha(MODEL.decode(ids))))
    assert got == sorted(want, key=str)
    assert sentencepieces.round_trip_digests(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_decoding_rows(spark, monkeypatch):
    monkeypatch.setattr(sentencepieces, "PART", 8)
    rows = [("x", [264, 287]), ("y", None), ("z", []), (None, [5, 1, 2, 300]), ("x", [264, 287])]
    tokens = spark.createDataFrame([(*r, "a") for r in rows], "doc_id string, ids array<int>, decoded string")
    got = sentencepieces.decode_ids(tokens, PATH)
    assert got.columns == ["doc_id", "ids", "decoded"]
    assert sorted(((r["doc_id"], r["decoded"]) for r in got.collect()), key=str) == sorted(
        ((k, MODEL.decode(ids or [])) for k, ids in rows), key=str)
