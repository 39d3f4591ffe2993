import random

import public_tokenizers
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tessera.llm import token_counts

PATH = public_tokenizers.path("piece_bpe_32k.model")
MODEL = sentencepiece.SentencePieceProcessor(model_file=PATH)
PROOF = token_counts.prove(PATH)
PARTS = ["a", "the", "é", "\n", " ", "  ", "▁", "\t", "\r\n", "<s>", "</s>", "<unk>", "<0x0A>", "漢字", "'s", "12", "!!", "?", "\xa0",
         " ", "\x00", "　", "ﬁ", "🙂", "é", "idiot", " foo", "\n\n", "\x85"]


def test_proof_holds():
    assert PROOF.independent and len(PROOF.words) > 10_000
    rng = random.Random(1)
    for w in rng.sample(sorted(PROOF.words), 300):
        assert len(MODEL.encode("\n " + w)) == 3  # the leading space, the feed, one token


def test_counts_match_the_library(monkeypatch):
    rng = random.Random(2)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    texts += ["", None, " ", "\n", "   ", "a" * 3000, " " * 3000, "word " * 9000]
    want = [len(MODEL.encode(t)) if t else 0 for t in texts]
    assert token_counts.TokenCounter(PROOF).count(texts) == want
    monkeypatch.setattr(token_counts, "SLICE", 5)
    monkeypatch.setattr(token_counts, "REMEMBERED", 3000)
    assert token_counts.TokenCounter(PROOF).count(texts) == want


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    assert token_counts.TokenCounter(PROOF).count([text]) == [len(MODEL.encode(text))]


def test_without_proof_whole_texts_are_encoded():
    plain = token_counts.TokenCounter(token_counts.Proof(PATH, False, frozenset()))
    assert plain.count(["a b", None, ""]) == [len(MODEL.encode("a b")), 0, 0]


def test_query(spark):
    rows = [(1, "two words"), (2, None), (2, None), (None, ""), (3, "é" * 5000)]
    docs = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, n_tokens int")
    got = sorted((r["doc_id"] or 0, r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in token_counts.count_documents(docs, PATH).collect())
    n = len(MODEL.encode("é" * 5000))
    assert got == sorted([(1, 9, len(MODEL.encode("two words")), False), (2, 0, 0, False), (2, 0, 0, False), (0, 0, 0, False),
                          (3, 10_000, n, n > 4096)])
    assert token_counts.count_documents(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
