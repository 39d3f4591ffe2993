import os
import sys
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from test_decontamination import fold, plain_distance
from test_langid import plain_grams
from test_line_dedup import plain as plain_lines
from test_simhash import plain_components, plain_fingerprint
from tessera.llm import decontamination, langid
from tokenizers import Tokenizer

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import corpus_pipeline  # noqa: E402

SF = "/root/testdata/sf0.001"


def code(gram):
    out = 0
    for c in gram:
        out = out << 21 | ord(c)
    return out


def plain_rank(counts):
    return [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], code(x[0])))][:langid.PROFILE]


def plain_languages(rows):
    """Ids that the first stage keeps."""
    by = defaultdict(Counter)
    for r in rows:
        if r["lang"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2:
            by[r["lang"]].update(plain_grams(r["text"] or ""))
    profiles = [{g: k for k, g in enumerate(plain_rank(c))} for c in by.values()]
    kept = set()
    for r in rows:
        own = plain_rank(plain_grams(r["text"] or ""))
        if own:
            best = min(sum(abs(p[g] - k) if g in p else langid.PROFILE for k, g in enumerate(own)) for p in profiles)
            if 1 - best / (langid.PROFILE * len(own)) >= langid.LEAST_SCORE:
                kept.add(r["doc_id"])
    return kept


def plain_pipeline(rows, items):
    kept = plain_languages(rows)
    texts = {r["doc_id"]: r["text"] for r in rows if r["doc_id"] in kept}
    after = {i: t for (i, _), t in plain_lines(list(texts.items())).items()}
    texts = {i: t for i, t in after.items() if t.strip() or t == texts[i]}
    ids = sorted(texts)
    roots = plain_components([plain_fingerprint(texts[i]) for i in ids], 4)
    ids = [i for k, i in enumerate(ids) if roots[k] == k]
    index = decontamination.build_index(items)
    folded = ["".join(map(chr, p)) for p in index.items]
    ids = [i for i in ids if not any(plain_distance(f, fold(texts[i])) <= index.edits[k] for k, f in enumerate(folded))]
    tokenizer, out = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), []
    for i in ids:
        own = tokenizer.encode(texts[i], add_special_tokens=False).ids + [1]
        out += [(i, s, len(own[s:s + 2048]), zlib.crc32(np.array(own[s:s + 2048], dtype="<u4").tobytes()), len(own))
                for s in range(0, len(own), 2048)]
    return sorted(out)


def test_stages_match_brute_force(spark, tmp_path):
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    extra = [(9001, "", "en", "s", 0), (9002, "12 34 !!", "en", "s", 8), (9003, "漢字 かな 한국 語" * 9, None, "s", 90)]
    docs = spark.createDataFrame([tuple(r) for r in rows] + extra, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = docs.collect()
    want = plain_pipeline(rows, [tuple(r) for r in bench.collect()])
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in got) == want
    assert 0 < len({w[0] for w in want}) < len(rows) - 3


def test_stages_keep_the_columns_and_take_odd_rows(spark, tmp_path):
    odd = [(None, None, None, None, None, 1), (1, "", "en", "s", 0, 2), (1, "the cat sat on the mat\nand\nso", "en", "s", 3, 3),
           (1, "the cat sat on the mat\nand\nso", "en", "s", 3, 3), (2, "the cat sat on the mat\nand\nso", "en", "s", 3, 3),
           (None, "the cat sat there", None, None, None, None), (3, "the cat " * 50_000, "en", "s", 1, 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, n_removed int"
    spark.createDataFrame([(1, "some other text of a benchmark")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for rows in (odd, []):
        docs = spark.createDataFrame(rows, schema)
        counts = []
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, str(tmp_path))
            if k < 4:
                assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
            path = str(tmp_path / f"{len(rows)}-{k}")
            out.write.parquet(path)
            docs = spark.read.parquet(path)
            counts.append(docs.count())
        # the language stage drops the null and the empty text; the copy of another id loses its lines
        assert counts[:4] == ([5, 4, 3, 3] if rows else [0] * 4)


def test_emptied_documents_go_and_sizes_follow(spark, tmp_path):
    rows = [(1, "a\nb\nc"), (2, "x\na\nb\nc"), (3, "a\nb\nc"), (4, "")]
    docs = spark.createDataFrame([(*r, "en", "s", 99) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in corpus_pipeline.line_dedup_stage(spark, docs, "").collect()}
    assert got == {1: ("a\nb\nc", 99), 2: ("x", 1), 4: ("", 99)}
