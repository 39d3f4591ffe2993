import random
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F
from tessera.llm import langid

SF = "/root/testdata/sf0.01"


def plain_grams(text):
    out, word = Counter(), []
    for c in [*text, " "]:
        for low in c.lower():
            if low.isalpha():
                word.append(low)
            elif word:
                w = " " + "".join(word) + " "
                out.update(x for n in (1, 2, 3) for i in range(len(w) - n + 1) if (x := w[i:i + n]).strip())
                word = []
    return out


def decode(code):
    out = ""
    while code:
        out, code = chr(code & (1 << 21) - 1) + out, code >> 21
    return out


def test_grams_match_plain_count(monkeypatch):
    rng = random.Random(1)
    for _ in range(200):
        text = "".join(rng.choice("abé ñ.,\n1漢Z🙂-") for _ in range(rng.randint(0, 80)))
        for size in (1 << 20, 5):
            monkeypatch.setattr(langid, "SLICE", size)
            codes, counts = langid.gram_counts(text)
            assert {decode(int(c)): int(n) for c, n in zip(codes, counts)} == plain_grams(text)


def test_distance_is_out_of_place():
    a, b = [ord("a"), ord("b"), ord("c")], [ord("c"), ord("x"), ord("a")]
    p = langid.Profiles({"one": a, "two": b}, 3)
    codes, counts = langid.gram_counts("ccc a")
    grams = langid.ranked(codes, counts, 3)

    def away(profile):
        return sum(abs(profile.index(g) - k) if g in profile else 3 for k, g in enumerate(map(int, grams)))
    lang, score = p.predict("ccc a")
    assert lang == ("one" if away(a) <= away(b) else "two")
    assert score == 1 - min(away(a), away(b)) / (3 * len(grams))


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = langid.identify_documents(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    out = [r for r in got if r["held_out"]]
    assert len(got) == docs.count() and len(out) > 200
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    assert np.mean([r["lang"] == r["lang_pred"] for r in out]) > 0.98
    assert all(0 <= r["score"] <= 1 for r in got)


def test_sample_is_bounded_and_skips_held_out(spark):
    texts = {"x": "aaa bbb", "y": "ccc ddd"}
    rows = [(i, texts["xy"[i % 2]], "xy"[i % 2]) for i in range(40)] + [(100, "zzz", None), (None, "aaa", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    held = docs.where("crc32(cast(cast(doc_id as string) as binary)) % 4 = 2").withColumn("text", F.lit("qqq"))
    p = langid.learn(docs.where("crc32(cast(cast(doc_id as string) as binary)) % 4 <> 2 or doc_id is null").union(held), sample=4)
    assert p.names == ["x", "y"] and ord("q") not in p.codes.tolist() and ord("z") not in p.codes.tolist()
    assert p.predict("abab aaa")[0] == "x" and p.predict("d c")[0] == "y"


def test_nulls_and_odd_rows(spark):
    rows = [(i, "the cat and the dog sat", "en") for i in range(12)]
    odd = [(50, None, "en"), (51, "", None), (52, "123 !!", "en"), (None, "the dog", None), (53, "the " * 50_000, None), (53, "the " * 50_000, None)]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows + odd], "doc_id long, text string, lang string, score int, lang_pred string")
    got = langid.identify_documents(docs).collect()
    assert len(got) == len(rows) + len(odd)
    for r in got:
        want = "und" if r["doc_id"] in (50, 51, 52) else "en"
        assert r["lang_pred"] == want and (r["score"] == 0) == (want == "und")
    kept = langid.accepted(docs, langid.learn(docs))
    assert kept.columns == docs.columns
    assert kept.count() == len(rows) + 3


def test_empty_table_and_no_labels(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert langid.identify_documents(empty).count() == 0
    one = spark.createDataFrame([(1, "hello", None)], "doc_id long, text string, lang string")
    assert [tuple(r)[2:] for r in langid.identify_documents(one).collect()] == [("und", 0.0)]


def test_columns_of_the_result_names_are_replaced(spark):
    docs = spark.createDataFrame([(1, "the cat and the dog", 7, "x"), (2, None, None, None)], "doc_id long, text string, lang_pred int, score string")
    got = langid.identify(docs, langid.learn(docs.withColumnRenamed("score", "lang")))
    assert got.columns == ["doc_id", "text", "lang_pred", "score"]
    assert {r["doc_id"]: r["lang_pred"] for r in got.collect()}[2] == "und"
