"""Removal of repeated passages by overlapping three-line windows.

Every run of three consecutive lines of a document is a window. A window whose
three lines occur at more than one place of the whole table keeps its first
occurrence (least document id, then position); the lines that later occurrences
cover are removed. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, utf8

WINDOW = 3


def line_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each window: the document, its position, and a 128-bit key of its lines."""
    lines = F.split(F.col(text_col), "\n", -1)
    per_doc = docs.select(
        F.col(id_col).alias("doc"), F.xxhash64(text_col).alias("text_key"),
        F.transform(lines, lambda x: F.xxhash64(x)).alias("h1"),
        F.transform(lines, lambda x: F.xxhash64(F.lit(WINDOW), x)).alias("h2"),
    ).where(F.size("h1") >= WINDOW)
    at = F.sequence(F.lit(0), F.size("h1") - WINDOW)

    def key(h: str, i):
        return F.xxhash64(*[F.col(h)[i + k] for k in range(WINDOW)])

    return (per_doc.select("doc", "text_key", F.explode(F.transform(
        at, lambda i: F.struct(i.alias("pos"), key("h1", i).alias("k1"), key("h2", i).alias("k2")))).alias("w"))
        .select("doc", "text_key", "w.pos", "w.k1", "w.k2"))


def covered_positions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each document that loses lines: the sorted positions (from 0) that later occurrences cover."""
    windows = line_windows(docs, id_col, text_col)
    place = F.struct("doc", "text_key", "pos")
    repeated = (windows.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first"))
                .where("n > 1").drop("n"))
    later = (windows.join(repeated, ["k1", "k2"])
             .where(~place.eqNullSafe(F.col("first"))))
    starts = later.groupBy("doc", "text_key").agg(F.collect_set("pos").alias("starts"))
    spans = F.flatten(F.transform("starts", lambda p: F.sequence(p, p + WINDOW - 1)))
    return starts.select("doc", "text_key", F.array_sort(F.array_distinct(spans)).alias("covered"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row of ``docs`` as ``row`` (a struct of its columns, with the repeated passages
    taken out of the text), ``n_lines`` and ``n_removed``.

    Lines are compared exactly and blank lines count as lines. A text of fewer
    than three lines has no window and stays. A null text stays null and has one
    line. Rows that agree in id and text are one occurrence and are treated
    alike; rows of one id with different texts are different documents, ordered
    by a hash of the text. Null ids come first. A text that loses all lines
    becomes empty. An empty table gives no rows; a very long text has as many
    windows as lines, which are dealt like those of any other.
    """
    prepare(docs.sparkSession)
    hit = covered_positions(docs, id_col, text_col)
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    text = F.col("row").getField(text_col)
    joined = rows.join(hit, F.col("row").getField(id_col).eqNullSafe(F.col("doc"))
                       & (F.xxhash64(text) == F.col("text_key")), "left")
    lines = F.split(text, "\n", -1)
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("covered"))
    left = F.when(F.col("covered").isNull(), text).otherwise(F.array_join(F.transform(stay, lambda i: lines[i]), "\n"))
    return joined.select(F.col("row").withField(text_col, left).alias("row"),
                         F.coalesce(F.when(text.isNotNull(), F.size(lines)), F.lit(1)).cast("long").alias("n_lines"),
                         F.coalesce(F.when(F.col("covered").isNotNull(), F.size("covered")), F.lit(0)).cast("long").alias("n_removed"))


def line_dedup_report(docs: DataFrame) -> DataFrame:
    """Per document: number of lines, of removed lines, and the checksum of the text that stays."""
    return dedup_lines(docs.select("doc_id", "text")).select(
        "row.doc_id", "n_lines", "n_removed", F.md5(utf8(F.col("row.text"))).alias("text_md5"))


LINE_DEDUP_SQL = r"""
WITH l AS (SELECT doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS a FROM documents),
pos AS (SELECT doc_id, a, unnest(range(1, greatest(len(a) - 1, 1))) AS i FROM l),
w AS (SELECT doc_id, i, a[i] || chr(10) || a[i + 1] || chr(10) || a[i + 2] AS body FROM pos),
r AS (SELECT doc_id, i, count(*) OVER (PARTITION BY body) AS n,
             row_number() OVER (PARTITION BY body ORDER BY doc_id, i) AS k FROM w),
c AS (SELECT DISTINCT doc_id, i + unnest([0, 1, 2]) AS p FROM r WHERE n > 1 AND k > 1),
lines AS (SELECT doc_id, unnest(range(1, len(a) + 1)) AS p, unnest(a) AS line FROM l),
kept AS (SELECT lines.doc_id, count(*) AS n_lines, count(c.p) AS n_removed,
                coalesce(string_agg(line, chr(10) ORDER BY lines.p) FILTER (WHERE c.p IS NULL), '') AS text
         FROM lines LEFT JOIN c ON c.doc_id = lines.doc_id AND c.p = lines.p GROUP BY lines.doc_id)
SELECT doc_id, n_lines, n_removed, md5(text) AS text_md5
FROM kept
"""
