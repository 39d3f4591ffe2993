import hashlib
import random

from tessera.llm import line_dedup


def plain(rows):
    """{(id, text): text that stays} by the rule, document after document."""
    seen, out = {}, {}
    for i, text in sorted(set(rows)):
        lines, gone = text.split("\n"), set()
        for k in range(len(lines) - 2):
            w = tuple(lines[k:k + 3])
            if seen.setdefault(w, (i, k)) != (i, k):
                gone |= {k, k + 1, k + 2}
        out[i, text] = "\n".join(x for k, x in enumerate(lines) if k not in gone)
    return out


def test_matches_plain_rule(spark):
    rng = random.Random(3)
    rows = [(i, "\n".join(rng.choice(["a", "b", "c", "", "é x"]) for _ in range(rng.randint(0, 12)))) for i in range(80)]
    rows += [(100, "\n".join(["x"] * 500)), (101, "q"), (102, "")]
    docs = spark.createDataFrame([(*r, "d", 5) for r in rows + rows[:3]], "doc_id long, text string, doc string, covered int")
    got = line_dedup.dedup_lines(docs).select("row.*", "n_lines", "n_removed").collect()
    want = plain(rows)
    assert len(got) == len(rows) + 3
    by_id = dict(rows)
    for r in got:
        text = by_id[r["doc_id"]]
        assert r["text"] == want[r["doc_id"], text]
        assert r["n_lines"] == len(text.split("\n"))
        stay = r["n_lines"] - r["n_removed"]
        assert stay == (len(r["text"].split("\n")) if r["text"] or stay else 0)
        assert r["doc"] == "d" and r["covered"] == 5
    assert sum(r["n_removed"] for r in got) > 100


def test_nulls_and_ties(spark):
    body = "p\nq\nr"
    rows = [(None, body), (1, body), (1, "z\n" + body), (2, None), (None, None), (3, "")]
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).select("row.*", "n_removed").collect()
    assert len(got) == 6
    by = {(r["doc_id"], r["text"]): r["n_removed"] for r in got}
    assert by[None, body] == 0  # null ids come first
    assert by[1, ""] == 3 and by[1, "z"] == 3
    assert by[2, None] == 0 and by[None, None] == 0 and by[3, ""] == 0


def test_report_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a\nb\nc\na\nb\nc"), (2, None)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in line_dedup.line_dedup_report(docs).collect()}
    assert (got[1]["n_lines"], got[1]["n_removed"]) == (6, 3)
    assert got[1]["text_md5"] == hashlib.md5(b"a\nb\nc").hexdigest()
    assert (got[2]["n_lines"], got[2]["n_removed"]) == (1, 0)
    assert line_dedup.line_dedup_report(spark.createDataFrame([], "doc_id long, text string")).count() == 0
