import random
import re
from collections import Counter

import numpy as np
from tessera.llm import repetition


def plain_longest(words):
    n, out = len(words), [0] * len(words)
    for i in range(n):
        for j in range(n):
            if i != j:
                k = 0
                while max(i, j) + k < n and words[i + k] == words[j + k]:
                    k += 1
                out[i] = max(out[i], k)
    return out


def plain_row(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i:i + 3]) for i in range(len(words) - 2))
    again = {i + k for i in range(len(words) - 2) if windows[tuple(words[i:i + 3])] > 1 for k in range(3)}
    longest = plain_longest(words)
    covered = {i + k for i, n in enumerate(longest) if n >= repetition.REPEAT_WORDS for k in range(n)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(words) < 50 or 100 * len(again) > 50 * len(words)
    fine = len(covered) <= repetition.MAX_COVERED * len(words) and max(longest, default=0) <= repetition.MAX_LONGEST
    return (len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(again),
            failed, not failed and fine, len(covered), max(longest, default=0))


def test_longest_repeats_match_brute_force():
    rng = random.Random(3)
    for _ in range(150):
        docs = [[rng.randint(0, rng.choice([1, 2, 5, 40])) for _ in range(rng.randint(0, 40))] for _ in range(rng.randint(1, 6))]
        ids = np.array([x for d in docs for x in d], dtype=np.int32)
        doc = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
        assert repetition.longest_repeats(ids, doc).tolist() == [x for d in docs for x in plain_longest(d)]


def plain_maximal(words, least):
    """Maximal repeats with their starts: longer on neither side at all their occurrences."""
    at = {}
    for i in range(len(words)):
        for n in range(least, len(words) - i + 1):
            at.setdefault(tuple(words[i:i + n]), []).append(i)
    out = set()
    for repeat, starts in at.items():
        if len(starts) > 1:
            left = {words[i - 1] if i else None for i in starts}
            right = {words[i + len(repeat)] if i + len(repeat) < len(words) else None for i in starts}
            if len(left) > 1 and len(right) > 1:
                out.add((len(repeat), tuple(starts)))
    return out


def test_maximal_repeats_match_brute_force():
    rng = random.Random(6)
    for least in (1, 3):
        for _ in range(120):
            docs = [[rng.randint(0, rng.choice([0, 1, 2, 5])) for _ in range(rng.randint(0, 30))] for _ in range(rng.randint(1, 4))]
            ids = np.array([x for d in docs for x in d], dtype=np.int32)
            doc = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
            suffix, common = repetition.suffix_array(ids, doc)
            found, maximal = repetition.maximal_repeats(ids, doc, suffix, common, least)
            first = np.concatenate([[0], np.cumsum([len(d) for d in docs])])
            got = {}
            for i in np.flatnonzero(maximal):
                starts = np.sort(suffix[found.first[i]:found.last[i] + 1])
                k = int(doc[starts[0]])
                assert (doc[starts] == k).all()
                got.setdefault(k, set()).add((int(found.lengths[i]), tuple((starts - first[k]).tolist())))
            want = {k: x for k, d in enumerate(docs) if (x := plain_maximal(d, least))}
            assert got == want
            longest = repetition.longest_maximal(ids, doc, suffix, common, least)
            for k, d in enumerate(docs):
                own = [max((n for n, starts in want.get(k, ()) if i in starts), default=0) for i in range(len(d))]
                assert longest[first[k]:first[k + 1]].tolist() == own


def test_many_nested_intervals_take_linear_work():
    ids = np.zeros(100_000, np.int32)
    figures = repetition.repeat_figures(ids, np.array([100_000]))
    assert figures.tolist() == [[100_000, 100_000, 99_999]]


def sample_rows():
    rng = random.Random(5)
    texts = [None, "", " \n\t", "#*$ %&|<>", "é é\xa0é"]
    for _ in range(60):
        words = [rng.choice(["a", "bb", "é", "#x", "w%d" % rng.randrange(400)]) for _ in range(rng.randint(1, 150))]
        if rng.random() < 0.5:
            cut = rng.randrange(len(words))
            words += words[cut:cut + rng.randint(1, 90)]
        texts.append("".join(w + rng.choice([" ", " ", "\n", "\r\n", " \n \n"]) for w in words))
    return [(i, t) for i, t in enumerate(texts)] + [(None, texts[7]), (8, texts[8])]


def test_query_matches_brute_force(spark, monkeypatch):
    rows = sample_rows()
    docs = spark.createDataFrame([(*r, -1) for r in rows], "doc_id long, text string, n_words int")
    got = repetition.quality_documents(docs).collect()
    want = sorted(((i or -1, *plain_row(t)) for i, t in rows))
    assert sorted((r["doc_id"] or -1, *tuple(r)[1:]) for r in got) == want
    assert {r["kept"] for r in got} == {True, False} and {r["base_failed"] for r in got} == {True, False}


def test_slices_give_the_same_words(monkeypatch):
    text = " ".join(f"w{i % 13}é" for i in range(500)).encode()
    want = repetition.word_ids(text, {})
    monkeypatch.setattr(repetition, "SLICE", 7)
    assert (repetition.word_ids(text, {}) == want).all()


def test_long_repeats_and_empty_table(spark):
    body = " ".join(f"u{i}" for i in range(3000))
    tail = " ".join(f"v{i}" for i in range(3000))
    rows = [(1, body), (2, body + " " + " ".join(f"u{i}" for i in range(100, 170)) + " " + tail), (3, "spam " * 20_000)]
    got = {r["doc_id"]: r for r in repetition.quality_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1]["kept"] and not got[2]["kept"] and not got[2]["base_failed"] and got[2]["longest_repeat"] == 70
    assert got[3]["longest_repeat"] == 19_999 and got[3]["base_failed"]
    assert repetition.quality_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0
