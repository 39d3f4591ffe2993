"""Source-level queries over the benchmark tables."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import functions as F

from ..operators.chunking import extract_text, pages_text
from ..session import shared_dir
from ..sources.files import data_uri, image_messages, read_csv_tables, read_documents, read_table_metadata
from ..sources.sinks import apply_metadata, ensure_table_property, overwrite_table
from ..sources.tables import load_table
from .catalog import register
from .finance_inputs import MARKET_SQL, daily_prices


@register("data_uri", """
SELECT page_id, CAST(strlen(html) AS BIGINT) AS n_bytes,
       'data:text/html;base64,' || to_base64(encode(html)) AS data_uri
FROM pages""")
def q_data_uri(spark, sf_dir):
    p = load_table(spark, sf_dir, "pages")
    raw = F.encode("html", "UTF-8")
    return p.select("page_id", F.octet_length("html").cast("bigint").alias("n_bytes"),
                    data_uri(raw, "text/html").alias("data_uri"))


@register("csv_tables", "WITH " + MARKET_SQL + " SELECT ticker, date, open, close, volume FROM px")
def q_csv_tables(spark, sf_dir):
    """Daily prices written as a directory of CSV files and scanned back with their types."""
    px = daily_prices(spark, sf_dir)
    path = shared_dir(spark, "csv")
    px.repartition(4).write.option("header", True).csv(path)

    out = None
    for part in read_csv_tables(spark, path, default_schema=px.schema).values():
        out = part if out is None else out.unionByName(part)
    return out.select("ticker", "date", "open", "close", "volume")


@register("extract_documents", """
SELECT page_id, CASE WHEN page_id % 10 <> 9 THEN md5(html) END AS text_md5, page_id % 10 = 9 AS failed FROM pages""")
def q_extract_documents(spark, sf_dir):
    """Text extraction over binary rows; every tenth document is broken and goes to the quarantine."""
    p = load_table(spark, sf_dir, "pages")
    raw = F.when(F.col("page_id") % 10 == 9, F.concat(F.unhex(F.lit("FFFE")), F.encode("html", "UTF-8"))) \
        .otherwise(F.encode("html", "UTF-8"))
    out = extract_text(p.select(F.col("page_id").cast("string").alias("path"), raw.alias("content")))
    return out.select(F.col("path").cast("bigint").alias("page_id"), F.md5(F.col("text").cast("binary")).alias("text_md5"),
                      F.col("error").isNotNull().alias("failed"))


@register("pages_joined", """
SELECT page_id, md5(replace(html, '<p>', chr(10))) AS text_md5 FROM pages""")
def q_pages_joined(spark, sf_dir):
    p = load_table(spark, sf_dir, "pages").select("page_id", F.split("html", "<p>", -1).alias("pages"))
    return pages_text(p).select("page_id", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@register("image_messages", """
SELECT page_id, '[{"role":"system","content":"You are a helpful assistant."},{"role":"user","content":[{"type":"text",'
       || '"text":"Describe it."},{"type":"image_url","image_url":{"url":"data:image/png;base64,' || to_base64(encode(html))
       || '"}}]}]' AS messages
FROM pages""")
def q_image_messages(spark, sf_dir):
    """One request an image; the pages' bytes stand for images."""
    p = load_table(spark, sf_dir, "pages").select("page_id", F.encode("html", "UTF-8").alias("content"))
    return image_messages(p, "Describe it.").select("page_id", "messages")


_COMMENTS = {"ticker": "Ticker symbol", "date": "Trading day's date", "volume": 'Shares "traded" \\ day'}


@register("table_cycle", "WITH " + MARKET_SQL + " SELECT 'rows' AS kind, ticker AS name, CAST(count(*) AS VARCHAR) AS value "
          "FROM px GROUP BY ticker UNION ALL SELECT * FROM (VALUES "
          + ", ".join("('column', '{}', '{}')".format(k, v.replace("'", "''")) for k, v in _COMMENTS.items())
          + ", ('table', 'px', 'Daily prices'), ('property', 'change.feed', 'true'), ('property set', 'first', 'true'), "
          "('property set', 'again', 'false'))")
def q_table_cycle(spark, sf_dir):
    """A table written twice (overwrite), its comments from a JSON sidecar, a property set once; all read back."""
    px, folder, name = daily_prices(spark, sf_dir), shared_dir(spark, "table_cycle"), f"px_{uuid.uuid4().hex[:12]}"
    sidecar = json.dumps({"px": {"description": "Daily prices", "columns": {**_COMMENTS, "absent": "not a column"}}})
    spark.createDataFrame([(sidecar,)], "value string").coalesce(1).write.text(f"{folder}/meta")
    for rows in (px.limit(0), px):
        overwrite_table(rows, name, path=f"{folder}/px")
    apply_metadata(spark, name, read_table_metadata(spark, f"{folder}/meta"), "px")
    first, again = (ensure_table_property(spark, name, "change.feed", "true") for _ in range(2))
    table = spark.table(name)
    comments = [("column", f.name, f.metadata["comment"]) for f in table.schema.fields if "comment" in f.metadata]
    described = spark.sql(f"DESCRIBE TABLE EXTENDED {name}").where("col_name = 'Comment'").select("data_type").first()[0]
    prop = spark.sql(f"SHOW TBLPROPERTIES {name}").where("key = 'change.feed'").first()["value"]
    facts = [*comments, ("table", "px", described), ("property", "change.feed", prop),
             *[("property set", k, str(v).lower()) for k, v in (("first", first), ("again", again))]]
    counts = table.groupBy("ticker").agg(F.count(F.lit(1)).cast("string").alias("value"))
    return counts.select(F.lit("rows").alias("kind"), F.col("ticker").alias("name"), "value").unionByName(
        spark.createDataFrame(facts, "kind string, name string, value string"))


@register("binary_documents", "SELECT page_id, md5(html) AS html_md5 FROM pages")
def q_binary_documents(spark, sf_dir):
    """Pages in text files of many pages each, scanned as binary documents and taken apart again."""
    path = shared_dir(spark, "binary")
    html = F.regexp_replace(F.base64(F.encode("html", "UTF-8")), r"[\r\n]", "")
    load_table(spark, sf_dir, "pages").select(F.concat_ws("\t", "page_id", html)).repartition(200).write.text(path)
    lines = read_documents(spark, path, "*.txt").where("error IS NULL").select(
        F.explode(F.split(F.decode("content", "UTF-8"), "\n")).alias("line")).where("line <> ''")
    page = F.split("line", "\t")
    return lines.select(F.get(page, F.lit(0)).cast("bigint").alias("page_id"), F.md5(F.unbase64(F.get(page, F.lit(1)))).alias("html_md5"))
