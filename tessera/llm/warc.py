"""Not-modified revisit records of web archives, resolved to the response they stand for.

A revisit (status 304) is joined to the latest earlier full response of the same
canonical URL. Its validators must fit that response; then the response's
headers are updated by those that a 304 may change (RFC 9111, 3.2 and 4.3.4)
and its payload is the revisit's. Captures of one URL may be any share of the
table: rows are dealt by ranges of (URL, time), the last response of each range
is carried over to the later ones, and no task needs all captures of a URL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import prepare, stored

# Fixed values. Query parameters that don't change the resource:
TRACKING = r"^(utm_[a-z]+|ref|fbclid|gclid|sessionid|phpsessid)(=|$)"
# Fixed values. Fields of a 304 that don't replace stored ones: hop-by-hop fields,
# and those that describe the stored payload.
NOT_MERGED = ["connection", "keep-alive", "proxy-authenticate", "proxy-authentication-info", "proxy-authorization",
              "te", "trailer", "transfer-encoding", "upgrade", "content-encoding", "content-length", "content-range",
              "content-type"]


def canonical_url(url: Column) -> Column:
    """Host in lower case without user, ``www`` and default port; path without index page
    and closing slash; parameters sorted, without tracking ones; no scheme, no fragment.
    A null or blank URL gives null."""
    u = F.regexp_replace(F.trim(url), "#.*$", "")
    u = F.regexp_replace(u, "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    query = F.when(F.instr(u, "?") > 0, F.regexp_replace(u, r"^[^?]*\?", "")).otherwise("")
    rest = F.regexp_replace(u, r"\?.*$", "")
    host = F.lower(F.regexp_extract(rest, "^[^/]*", 0))
    host = F.regexp_replace(F.regexp_replace(F.regexp_replace(host, "^[^@]*@", ""), r"^www[0-9]*\.", ""), ":(80|443)$", "")
    path = F.regexp_replace(F.regexp_replace(rest, "^[^/]*", ""), "/(index\\.html?)?$", "")
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda x: (x != "") & ~x.rlike(TRACKING)))
    out = F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))
    return F.when(F.length(out) > 0, out)


def _lower_names(headers: Column) -> Column:
    """Header names in lower case; of equal names the first stays."""
    entries = F.transform(F.map_entries(F.coalesce(headers, F.create_map().cast("map<string,string>"))),
                          lambda e: F.struct(F.lower(F.trim(e["key"])).alias("k"), e["value"].alias("v")))
    names = F.array_distinct(F.transform(entries, lambda e: e["k"]))
    return F.map_from_arrays(names, F.transform(names, lambda n: F.filter(entries, lambda e: e["k"] == n)[0]["v"]))


def resolve_revisits(captures: DataFrame) -> DataFrame:
    """One row for each revisit among ``captures``.

    ``captures``: ``record_id`` (long), ``url``, ``ts``, ``kind`` (``response`` or
    ``revisit``), ``status``, ``headers`` (map) and ``payload_digest``; other columns
    are ignored. A full response has status 200. Earlier means by time, then by
    record id; rows that agree in both come in order of their digest, and rows
    without a time, before all others. The result has ``record_id``, ``url_key``,
    ``base_id``, ``outcome``, ``headers`` and ``payload_digest``. Outcomes:

    - ``resolved``: headers merged, the base's digest.
    - ``mismatch``: the validators don't fit the base; ``no_validator``: the revisit
      has none, but the base has. Both keep the base's id and the revisit's own headers.
    - ``no_base``: there is no earlier full response, or the URL is null or blank.

    An empty table, or one without revisits, gives no rows.
    """
    prepare(captures.sparkSession)
    h = F.col("headers")
    rows = (captures.select("record_id", canonical_url(F.col("url")).alias("url_key"), "ts", "kind", "status",
                            _lower_names(h).alias("headers"), "payload_digest")
            .where(F.col("kind").isin("response", "revisit")))
    order = ["ts", "record_id", "payload_digest"]
    dealt = stored(rows.repartitionByRange("url_key", *order).withColumn("_part", F.spark_partition_id()), "captures")
    full = F.when((F.col("kind") == "response") & (F.col("status") == 200) & F.col("url_key").isNotNull(),
                  F.struct("record_id", "headers", "payload_digest"))
    before = (Window.partitionBy("_part", "url_key").orderBy(*order)
              .rowsBetween(Window.unboundedPreceding, -1))
    near = dealt.withColumn("_near", F.last(full, ignorenulls=True).over(before)).where(F.col("kind") == "revisit")
    # the last response that each range has of a URL, and from it the last one of all earlier ranges
    last = (dealt.where(F.col("url_key").isNotNull()).groupBy("url_key", "_part")
            .agg(F.max_by(full, F.when(full.isNotNull(), F.struct(*order))).alias("_last")))
    ranges = Window.partitionBy("url_key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = (last.withColumn("_far", F.last("_last", ignorenulls=True).over(ranges)).drop("_last")
               .where(F.col("_far").isNotNull()))
    found = near.join(carried, ["url_key", "_part"], "left").withColumn("_base", F.coalesce("_near", "_far"))
    base, own = F.col("_base.headers"), F.col("headers")
    tag, base_tag = own["etag"], base["etag"]
    when, base_when = own["last-modified"], base["last-modified"]
    strong = ~tag.startswith("W/")
    fits = (F.when(tag.isNotNull() & strong, F.coalesce(tag == base_tag, F.lit(False)))
            .when(tag.isNotNull(), F.coalesce(F.regexp_replace(tag, "^W/", "") == F.regexp_replace(base_tag, "^W/", ""),
                                              F.lit(False)))
            .when(when.isNotNull(), F.coalesce(when == base_when, F.lit(False)))
            .otherwise(base_tag.isNull() & base_when.isNull()))
    outcome = (F.when(F.col("_base").isNull(), "no_base").when(fits, "resolved")
               .when(tag.isNull() & when.isNull(), "no_validator").otherwise("mismatch"))
    fresh = F.map_filter(own, lambda k, v: ~k.isin(NOT_MERGED))
    merged = F.map_concat(F.map_filter(base, lambda k, v: ~F.map_contains_key(fresh, k)), fresh)
    return found.withColumn("outcome", outcome).select(
        "record_id", "url_key", F.col("_base.record_id").alias("base_id"), "outcome",
        F.when(F.col("outcome") == "resolved", merged).otherwise(own).alias("headers"),
        F.when(F.col("outcome") == "resolved", F.col("_base.payload_digest")).alias("payload_digest"))


def attach_payload(resolved: DataFrame, payloads: DataFrame) -> DataFrame:
    """The resolved revisits with their base's ``payload`` (from ``record_id``, ``payload``)."""
    return resolved.join(payloads.select(F.col("record_id").alias("base_id"), "payload"), "base_id", "left") \
        .withColumn("payload", F.when(F.col("outcome") == "resolved", F.col("payload")))


def header_text(headers: Column) -> Column:
    """Header lines in order of their names."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(headers)),
                                    lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "\n")


def page_captures(pages: DataFrame) -> DataFrame:
    """Captures derived from pages: a response for each page and later a revisit of its URL.

    The numbers below only vary the cases: other statuses, weak, changed and
    missing validators, other spellings of the URL, fields that may not be merged.
    """
    p = F.col("page_id")
    digest = F.md5(F.col("html").cast("binary"))
    tag = F.concat(F.lit('"'), F.substring(digest, 1, 16), F.lit('"'))
    day = F.concat(F.lit("day "), (p % 400).cast("string"))
    ts = (p * 7919) % 1000003

    def header_map(*pairs):
        given = F.filter(F.array(*[F.struct(F.lit(k).alias("k"), v.alias("v")) for k, v in pairs]),
                         lambda e: e["v"].isNotNull())
        return F.map_from_entries(given)

    response = pages.select(
        (p * 2).alias("record_id"), "url", ts.alias("ts"), F.lit("response").alias("kind"),
        F.when(p % 11 == 10, 404).otherwise(200).alias("status"),
        header_map(("Content-Type", F.lit("text/html")), ("Content-Length", F.octet_length("html").cast("string")),
                   ("ETag", F.when(p % 6 != 5, tag)), ("Last-Modified", F.when(p % 6 != 5, day)),
                   ("Cache-Control", F.concat(F.lit("max-age="), (p % 10).cast("string"))),
                   ("Server", F.lit("origin"))).alias("headers"), digest.alias("payload_digest"))
    revisit = pages.select(
        (p * 2 + 1).alias("record_id"), F.concat(F.regexp_replace("url", "^https?://", "HTTP://www."), F.lit("#again")).alias("url"),
        (ts + 1 + p % 3 * 500000).alias("ts"), F.lit("revisit").alias("kind"), F.lit(304).alias("status"),
        header_map(("etag", F.when(p % 7 == 3, F.lit('"changed"')).when(p % 6 == 5, None).when(p % 5 == 0, None)
                    .when(p % 4 == 1, F.concat(F.lit("W/"), tag)).otherwise(tag)),
                   ("last-modified", F.when((p % 13 == 0) | (p % 6 == 5), None).otherwise(day)),
                   ("content-length", F.lit("0")), ("connection", F.lit("close")),
                   ("cache-control", F.concat(F.lit("max-age="), (p % 10 + 60).cast("string"))),
                   ("x-cache", F.lit("revalidated"))).alias("headers"), F.lit(None).cast("string").alias("payload_digest"))
    return response.unionByName(revisit)


def resolve_pages(pages: DataFrame) -> DataFrame:
    found = resolve_revisits(page_captures(pages))
    return found.withColumn("headers", header_text(F.col("headers")))


WARC_SQL = r"""
WITH d AS (SELECT page_id AS p, url, md5(html) AS digest, strlen(html) AS n, (page_id * 7919) % 1000003 AS t FROM pages),
c AS (
  SELECT p * 2 AS record_id, url, t AS ts, 'response' AS kind, CASE WHEN p % 11 = 10 THEN 404 ELSE 200 END AS status,
         CASE WHEN p % 6 <> 5 THEN '"' || substr(digest, 1, 16) || '"' END AS tag,
         CASE WHEN p % 6 <> 5 THEN 'day ' || (p % 400) END AS lm, p, n, digest FROM d
  UNION ALL
  SELECT p * 2 + 1, regexp_replace(url, '^https?://', 'HTTP://www.') || '#again', t + 1 + p % 3 * 500000, 'revisit', 304,
         CASE WHEN p % 7 = 3 THEN '"changed"' WHEN p % 6 = 5 OR p % 5 = 0 THEN NULL
              WHEN p % 4 = 1 THEN 'W/"' || substr(digest, 1, 16) || '"' ELSE '"' || substr(digest, 1, 16) || '"' END,
         CASE WHEN p % 13 = 0 OR p % 6 = 5 THEN NULL ELSE 'day ' || (p % 400) END, p, n, NULL FROM d),
u AS (SELECT *, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS s FROM c),
v AS (SELECT *, CASE WHEN instr(s, '?') > 0 THEN regexp_replace(s, '^[^?]*\?', '') ELSE '' END AS q,
             regexp_replace(s, '\?.*$', '') AS rest FROM u),
w AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(rest, '^[^/]*')), '^[^@]*@', ''),
                               '^www[0-9]*\.', ''), ':(80|443)$', '') AS host,
             regexp_replace(regexp_replace(rest, '^[^/]*', ''), '/(index\.html?)?$', '') AS path,
             list_sort([x for x in string_split(q, '&') if x <> '' AND
                        NOT regexp_matches(x, '^(utm_[a-z]+|ref|fbclid|gclid|sessionid|phpsessid)(=|$)')]) AS kept FROM v),
k AS (SELECT *, host || path || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END AS url_key FROM w),
o AS (SELECT *, last_value(CASE WHEN kind = 'response' AND status = 200 THEN record_id END IGNORE NULLS) OVER (
         PARTITION BY url_key ORDER BY ts, record_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS base_id FROM k),
j AS (SELECT r.record_id, r.url_key, r.base_id, r.p, r.tag, r.lm, b.tag AS btag, b.lm AS blm, b.p AS bp, b.n AS bn, b.digest AS bd,
        CASE WHEN r.base_id IS NULL THEN 'no_base'
             WHEN r.tag IS NOT NULL AND NOT starts_with(r.tag, 'W/') THEN CASE WHEN r.tag = b.tag THEN 'resolved' ELSE 'mismatch' END
             WHEN r.tag IS NOT NULL THEN CASE WHEN substr(r.tag, 3) = b.tag THEN 'resolved' ELSE 'mismatch' END
             WHEN r.lm IS NOT NULL THEN CASE WHEN r.lm = b.lm THEN 'resolved' ELSE 'mismatch' END
             WHEN b.tag IS NULL AND b.lm IS NULL THEN 'resolved' ELSE 'no_validator' END AS outcome
      FROM o r LEFT JOIN k b ON b.record_id = r.base_id WHERE r.kind = 'revisit')
SELECT record_id, url_key, base_id, outcome,
  CASE WHEN outcome = 'resolved' THEN
    'cache-control: max-age=' || (p % 10 + 60) || chr(10) || 'content-length: ' || bn || chr(10) || 'content-type: text/html' || chr(10)
    || coalesce('etag: ' || coalesce(tag, btag) || chr(10), '') || coalesce('last-modified: ' || coalesce(lm, blm) || chr(10), '')
    || 'server: origin' || chr(10) || 'x-cache: revalidated'
  ELSE
    'cache-control: max-age=' || (p % 10 + 60) || chr(10) || 'connection: close' || chr(10) || 'content-length: 0'
    || coalesce(chr(10) || 'etag: ' || tag, '') || coalesce(chr(10) || 'last-modified: ' || lm, '') || chr(10) || 'x-cache: revalidated'
  END AS headers,
  CASE WHEN outcome = 'resolved' THEN bd END AS payload_digest
FROM j
"""
