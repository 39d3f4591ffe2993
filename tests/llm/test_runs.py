import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from tessera.llm import runs


def plain_runs(words, least_length, least_periods):
    """Every stretch that is maximal for its smallest period, by comparing all lags."""
    n, out = len(words), {}
    for p in range(1, n // least_periods + 1):
        x = 0
        while x + p < n:
            if words[x] != words[x + p]:
                x += 1
                continue
            e = x
            while e + p < n and words[e] == words[e + p]:
                e += 1
            if e + p - x >= max(least_length, least_periods * p):
                out.setdefault((x, e + p), p)  # the smallest period comes first
            x = e
    return sorted((s, e - s, p) for (s, e), p in out.items())


def some_words(rng):
    kind, n = rng.randrange(5), rng.randint(0, 260)
    if kind == 0:
        return [rng.randrange(rng.choice([1, 2, 3])) for _ in range(n)]
    if kind == 1:  # a Fibonacci word: many squares, few runs
        a, b = [0], [0, 1]
        while len(b) < n:
            a, b = b, b + a
        return b[:n]
    out = []
    while len(out) < n:
        unit = [rng.randrange(rng.choice([2, 50])) for _ in range(rng.randint(1, rng.choice([3, 12, 40])))]
        out += (unit * rng.randint(1, 8))[:rng.randint(1, 120)]
        if kind == 2:
            out += [rng.randrange(50) for _ in range(rng.randint(0, 10))]
    if kind == 4 and out:  # a run of runs with some words changed
        out = out[:60] * 4
        for _ in range(rng.randint(0, 3)):
            out[rng.randrange(len(out))] = 7
    return out


@pytest.mark.parametrize("least_length, least_periods", [(24, 3), (0, 2), (10, 2), (1, 3), (40, 4)])
def test_runs_match_brute_force(least_length, least_periods):
    rng = random.Random(least_length)
    for _ in range(120):
        words = some_words(rng)
        want = plain_runs(words, least_length, least_periods)
        whole = runs.SquareCatchers(least_length, least_periods)
        whole.append(np.array(words, np.int64))
        assert whole.runs() == want
        pieces, at = runs.SquareCatchers(least_length, least_periods), 0
        most = rng.choice([1, 3, 17, 90])
        while at < len(words):
            step = rng.randint(1, most)
            pieces.append(np.array(words[at:at + step], np.int64))
            at += step
            if rng.random() < 0.05:  # what is reported holds for the words so far
                assert pieces.runs() == plain_runs(words[:at], least_length, least_periods)
        assert pieces.runs() == want


def test_names_that_agree_by_chance_are_checked(monkeypatch):
    monkeypatch.setattr(runs, "_mix", lambda a, b: (a + b) % np.uint64(3))
    rng = random.Random(1)
    for _ in range(60):
        words = some_words(rng)
        found = runs.SquareCatchers()
        found.append(np.array(words, np.int64))
        assert found.runs() == plain_runs(words, 24, 3)


def test_long_periodic_texts_take_bounded_work():
    for words in ([0] * 300_000, [0, 1, 2] * 100_000, list(range(5000)) * 4, [k % 7 if k % 1000 else -k for k in range(200_000)]):
        found = runs.SquareCatchers()
        found.append(np.array(words, np.int64))
        assert found.runs()
        assert len(found.open) < 100
    assert runs.runs_of([b"a"] * 50_000) == [(0, 50_000, 1)]


def test_state_of_an_online_text_is_bounded():
    found = runs.SquareCatchers()
    for k in range(300):
        found.append(np.arange(1000 * k, 1000 * k + 1000))
    assert sum(len(x.names) for x in found.levels) < 8 * found.n


def digest_row(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    if doc_id is not None:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0 and n > 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
    found = plain_runs(words, 24, 3)
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    gone = {x for s, length, q in found for x in range(s + q, s + length)}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
            sha("".join(f"{s},{length},{q}\n" for s, length, q in found)),
            sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_query(spark):
    rng = random.Random(4)
    rows = [(None, "a " * 30), (None, None), (2, None), (3, ""), (4, " \n\t"), (4, " \n\t"), (5, "x\x1fy\xa0z " * 30), (6, "é\x0bü\x0c" * 40)]
    rows += [(k, " ".join(f"w{x}" for x in some_words(rng))) for k in range(100, 260)]
    rows += [(-7, "one  two\n" * 12), (10**15, "b\r\n" * 24)]
    assert any(zlib.crc32(str(k).encode()) % 10 == 0 and t for k, t in rows if k)
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, runs int, words string")
    got = sorted((tuple(r) for r in runs.run_digests(docs).collect()), key=str)
    assert got == sorted((digest_row(*r) for r in rows), key=str)
    assert runs.run_digests(docs).columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256",
                                              "collapsed_sha256"]
    assert runs.run_digests(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_text_ids_and_parts(spark, monkeypatch):
    docs = spark.createDataFrame([("k1", "a b " * 20), ("k2", "c")], "id string, body string")
    got = {r["doc_id"]: r for r in runs.periodic_runs(docs, "id", "body").collect()}
    assert [tuple(r) for r in got["k1"]["runs"]] == [(0, 40, 2)] and got["k1"]["collapsed"] == "a b"
    assert got["k2"]["n_words"] == 1 and got["k2"]["runs"] == [] and got["k2"]["collapsed"] == "c"
