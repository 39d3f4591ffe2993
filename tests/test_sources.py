import base64
import json
import os
import tempfile

from pyspark.sql import functions as F

from tessera.sources import files, sinks

META = {"companies": {"description": "Company's static info", "columns": {"ticker": "Ticker symbol",
                                                                          "ipo_date": "Date it went public"}},
        "prices": {"description": "Daily prices", "columns": {"close": "Close"}}}


def _dir():
    d = tempfile.mkdtemp(prefix="tessera-src-")
    with open(os.path.join(d, "companies.csv"), "w") as f:
        f.write("company_id,ticker,name,sector,ipo_date\n1,WWS,W Co,Tech,2010-05-01\n2,XBR,X Co,Energy,2001-01-02\n")
    with open(os.path.join(d, "prices.csv"), "w") as f:
        f.write("ticker,date,close\nWWS,2025-01-02,53.00\n")
    with open(os.path.join(d, "notes.txt"), "w") as f:
        f.write("ignored")
    with open(os.path.join(d, "metadata.json"), "w") as f:
        json.dump(META, f, indent=4)
    return d


def test_csv_tables_and_metadata(spark):
    d = _dir()
    tabs = files.read_csv_tables(spark, d, {"companies": "company_id long, ticker string, name string, "
                                                         "sector string, ipo_date date"})
    assert sorted(tabs) == ["companies", "prices"]
    assert dict(tabs["companies"].dtypes)["ipo_date"] == "date" and tabs["companies"].count() == 2
    meta = files.read_table_metadata(spark, os.path.join(d, "metadata.json"))
    assert meta.filter("table = 'companies' AND column IS NOT NULL").count() == 2
    sinks.ensure_schema(spark, "fin")
    sinks.overwrite_table(tabs["companies"], "fin.companies")
    assert sinks.apply_metadata(spark, "fin.companies", meta) == 3
    desc = {r.col_name: r.comment for r in spark.sql("DESCRIBE TABLE fin.companies").collect()}
    assert desc["ticker"] == "Ticker symbol"
    tcomment = [r.data_type for r in spark.sql("DESCRIBE TABLE EXTENDED fin.companies").collect()
                if r.col_name == "Comment"]
    assert tcomment == ["Company's static info"]
    assert sinks.ensure_table_property(spark, "fin.companies", "delta.enableChangeDataFeed", "true")
    assert not sinks.ensure_table_property(spark, "fin.companies", "delta.enableChangeDataFeed", "true")
    # overwrite drops comments: re-apply afterwards
    sinks.overwrite_table(tabs["companies"], "fin.companies")
    assert sinks.apply_metadata(spark, "fin.companies", meta) == 3


def test_documents_and_image_messages(spark):
    d = tempfile.mkdtemp(prefix="tessera-docs-")
    for name, data in [("a.pdf", b"%PDF-1 a"), ("b.pdf", b"x" * 100), ("c.png", b"\x89PNG")]:
        with open(os.path.join(d, name), "wb") as f:
            f.write(data)
    docs = files.read_documents(spark, d)
    assert sorted((r.name, r.size) for r in docs.collect()) == [("a.pdf", 8), ("b.pdf", 100)]
    limited = {r.name: r for r in files.read_documents(spark, d, max_bytes=10).collect()}
    assert limited["a.pdf"].error is None and limited["a.pdf"].content is not None
    assert limited["b.pdf"].content is None and "larger than 10" in limited["b.pdf"].error
    imgs = files.read_documents(spark, d, glob="*.png")
    msgs = json.loads(files.image_messages(imgs, "Describe the picture.").first().messages)
    assert msgs[0] == {"role": "system", "content": "You are a helpful assistant."}
    url = msgs[1]["content"][1]["image_url"]["url"]
    assert msgs[1]["content"][0] == {"type": "text", "text": "Describe the picture."}
    assert url == "data:image/png;base64," + base64.b64encode(b"\x89PNG").decode()


def test_data_uri_no_line_breaks(spark):
    df = spark.createDataFrame([(b"a" * 500,)], "b binary")
    uri = df.select(files.data_uri("b").alias("u")).first().u
    assert "\n" not in uri and uri.endswith(base64.b64encode(b"a" * 500).decode())
