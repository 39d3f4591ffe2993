import random

from pyspark.sql import functions as F
from tessera.llm import warc

SCHEMA = "record_id long, url string, ts long, kind string, status int, headers map<string,string>, payload_digest string, _part string"


def plain(captures):
    """{record id: (base id, outcome)} for revisits, by the rule."""
    out = {}
    for c in captures:
        if c[3] != "revisit":
            continue
        earlier = [b for b in captures if b[1] == c[1] and b[3] == "response" and b[4] == 200 and (b[2], b[0]) < (c[2], c[0])]
        if not earlier:
            out[c[0]] = (None, "no_base")
            continue
        b = max(earlier, key=lambda b: (b[2], b[0]))
        h, bh = c[5] or {}, b[5] or {}
        if "etag" in h:
            ok = h["etag"] == bh.get("etag") if not h["etag"].startswith("W/") else \
                h["etag"][2:] == (bh.get("etag") or "").removeprefix("W/")
        elif "last-modified" in h:
            ok = h["last-modified"] == bh.get("last-modified")
        else:
            ok = not ({"etag", "last-modified"} & set(bh))
        out[c[0]] = (b[0], "resolved" if ok else "mismatch" if {"etag", "last-modified"} & set(h) else "no_validator")
    return out


def test_matches_plain_join_with_a_hot_url(spark):
    rng = random.Random(1)
    rows = []
    for k in range(600):
        url = "hot.org/p" if rng.random() < 0.4 else f"h{rng.randrange(40)}.org/x"
        headers = {}
        if rng.random() < 0.7:
            headers["etag"] = rng.choice(["", "W/"]) + f'"{rng.randrange(2)}"'
        if rng.random() < 0.5:
            headers["last-modified"] = str(rng.randrange(2))
        rows.append((k, url, rng.randrange(80), rng.choice(["response", "revisit"]), rng.choice([200, 200, 404]),
                     headers, f"d{k}", "x"))
    got = warc.resolve_revisits(spark.createDataFrame(rows, SCHEMA).repartition(6)).collect()
    want = plain(rows)
    assert {r["record_id"]: (r["base_id"], r["outcome"]) for r in got} == want and len(got) == len(want)
    assert {o for _, o in want.values()} == {"resolved", "mismatch", "no_validator", "no_base"}
    assert all(r["payload_digest"] == (f"d{r['base_id']}" if r["outcome"] == "resolved" else None) for r in got)


def test_only_permitted_headers_are_merged(spark):
    base = {"ETag": '"1"', "Content-Length": "90", "Content-Type": "text/html", "X-Old": "o", "Cache-Control": "a"}
    fresh = {"etag": '"1"', "Content-Length": "0", "Connection": "close", "CACHE-CONTROL": "b", "X-New": "n", "x-new": "m"}
    rows = [(1, "http://A.org:80/x/", 1, "response", 200, base, "d", None), (2, "https://www.a.org/x#f", 2, "revisit", 304, fresh, None, None)]
    r = warc.resolve_revisits(spark.createDataFrame(rows, SCHEMA)).first()
    assert r["outcome"] == "resolved" and r["headers"] == {
        "etag": '"1"', "content-length": "90", "content-type": "text/html", "x-old": "o", "cache-control": "b", "x-new": "n"}


def test_canonical_urls(spark):
    cases = {
        "HTTP://User@WWW2.Example.org:443/A/index.html?b=2&utm_source=x&a=1&ref=q#top": "example.org/A?a=1&b=2",
        "https://example.org/": "example.org", "example.org": "example.org", "https://example.org/Path/": "example.org/Path",
        "https://example.org?x=http://y": "example.org?x=http://y", "": None, "   ": None, None: None}
    rows = spark.createDataFrame([(k, v) for k, v in cases.items()], "u string, want string")
    for r in rows.select("u", "want", warc.canonical_url(F.col("u")).alias("got")).collect():
        assert r["got"] == r["want"], r["u"]


def test_nulls_ties_repeats_and_empty(spark):
    e = {"etag": '"1"'}
    rows = [(1, "a.org", 5, "response", 200, e, "d1", None), (2, "a.org", 5, "response", 200, e, "d2", None),
            (3, "a.org", 5, "revisit", 304, e, None, None), (3, "a.org", 5, "revisit", 304, e, None, None),
            (4, None, 9, "revisit", 304, e, None, None), (5, "a.org", None, "revisit", 304, e, None, None),
            (6, "a.org", 9, "revisit", 304, None, None, None), (7, "a.org", 9, None, 200, None, None, None),
            (8, None, 1, "response", 200, e, "d8", None), (None, "b.org", 1, "response", 200, None, "d9", None),
            (9, "b.org", 2, "revisit", 304, None, None, None)]
    got = [(r["record_id"], r["base_id"], r["outcome"], r["payload_digest"])
           for r in warc.resolve_revisits(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert sorted(got) == sorted([(3, 2, "resolved", "d2"), (3, 2, "resolved", "d2"), (4, None, "no_base", None),
                                  (5, None, "no_base", None), (6, 2, "no_validator", None), (9, None, "resolved", "d9")], key=lambda x: x[0])
    assert warc.resolve_revisits(spark.createDataFrame([], SCHEMA)).count() == 0
    assert warc.resolve_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_payloads(spark):
    rows = [(1, "a.org", 1, "response", 200, {"etag": "1"}, "d", None), (2, "a.org", 2, "revisit", 304, {"etag": "1"}, None, None),
            (3, "a.org", 3, "revisit", 304, {"etag": "2"}, None, None)]
    done = warc.attach_payload(warc.resolve_revisits(spark.createDataFrame(rows, SCHEMA)),
                               spark.createDataFrame([(1, "body")], "record_id long, payload string"))
    assert {r["record_id"]: r["payload"] for r in done.collect()} == {2: "body", 3: None}
