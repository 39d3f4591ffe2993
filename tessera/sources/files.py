"""File scans: CSV directories, the JSON metadata sidecar, binary documents,
and binary -> inline data URI chat messages. All scans run on executors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

META_SCHEMA = "map<string,struct<description:string,columns:map<string,string>>>"


def list_files(spark: SparkSession, directory: str, glob: str) -> DataFrame:
    """``(path, name, stem)`` of the files matching ``glob`` (listed by Spark)."""
    files = (spark.read.format("binaryFile").option("pathGlobFilter", glob).load(directory)
             .select("path"))
    name = F.element_at(F.split("path", "/"), -1)
    return files.select("path", name.alias("name"),
                        F.regexp_replace(name, r"\.[^.]*$", "").alias("stem"))


def read_csv_tables(spark: SparkSession, directory: str, schemas: dict[str, T.StructType | str] | None = None,
                    glob: str = "*.csv", default_schema: T.StructType | str | None = None) -> dict[str, DataFrame]:
    """One DataFrame per ``*.csv`` file stem (header row). An explicit schema per
    stem, or else ``default_schema``, is used when given (dates and decimals stay
    typed); otherwise types are inferred. The file list is small (one row per file) and is collected."""
    schemas = schemas or {}
    out = {}
    for r in list_files(spark, directory, glob).orderBy("stem").collect():
        reader = spark.read.option("header", True)
        schema = schemas.get(r.stem, default_schema)
        reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
        out[r.stem] = reader.csv(r.path)
    return out


def read_table_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Sidecar ``{table: {description, columns: {name: text}}}`` as rows
    ``(table, description, column, comment)``; ``column`` is null on the table row."""
    m = (spark.read.text(path, wholetext=True)
         .select(F.explode(F.from_json("value", META_SCHEMA)).alias("table", "meta")))
    tables = m.select("table", F.col("meta.description").alias("description"),
                      F.lit(None).cast("string").alias("column"), F.lit(None).cast("string").alias("comment"))
    cols = m.select("table", F.lit(None).cast("string").alias("description"),
                    F.explode("meta.columns").alias("column", "comment"))
    return tables.unionByName(cols)


def read_documents(spark: SparkSession, directory: str, glob: str = "*.pdf",
                   max_bytes: int | None = None) -> DataFrame:
    """Binary documents ``(content, name, path, size, error)``. A file of more than
    ``max_bytes`` keeps its row, without content and with ``error`` set, so that it
    goes to the quarantine with the documents that can't be parsed."""
    df = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(directory)
    large = F.col("length") > max_bytes if max_bytes is not None else F.lit(False)
    return df.select(F.when(~large, F.col("content")).alias("content"), F.element_at(F.split("path", "/"), -1).alias("name"),
                     "path", F.col("length").alias("size"),
                     F.when(large, F.concat(F.lit("Error parsing document: larger than "), F.lit(str(max_bytes)), F.lit(" bytes")))
                     .alias("error"))


def data_uri(content, mime: str = "image/png") -> F.Column:
    """``data:<mime>;base64,<...>`` of a binary column (Spark's base64 wraps lines
    every 76 characters; the breaks are removed)."""
    c = F.col(content) if isinstance(content, str) else content
    return F.concat(F.lit(f"data:{mime};base64,"), F.regexp_replace(F.base64(c), r"[\r\n]", ""))


def image_messages(files: DataFrame, prompt: str, system_prompt: str | None = "You are a helpful assistant.",
                   content_col: str = "content", mime: str = "image/png") -> DataFrame:
    """One chat request per image: an optional system message, then a user message
    with a text part and an ``image_url`` part holding the inline data URI.
    Adds ``messages`` (JSON text of the message list)."""
    text_part = F.struct(F.lit("text").alias("type"), F.lit(prompt).alias("text"),
                         F.lit(None).cast("struct<url:string>").alias("image_url"))
    image_part = F.struct(F.lit("image_url").alias("type"), F.lit(None).cast("string").alias("text"),
                          F.struct(data_uri(content_col, mime).alias("url")).alias("image_url"))
    user = F.struct(F.lit("user").alias("role"), F.lit(None).cast("string").alias("content"),
                    F.array(text_part, image_part).alias("parts"))
    msgs = [user]
    if system_prompt is not None:
        msgs.insert(0, F.struct(F.lit("system").alias("role"), F.lit(system_prompt).alias("content"),
                                F.lit(None).cast("array<struct<type:string,text:string,"
                                                 "image_url:struct<url:string>>>").alias("parts")))
    # to_json drops null fields, so each message shows either content or parts
    as_json = F.regexp_replace(F.to_json(F.array(*msgs)), r'"parts":', '"content":')
    return files.withColumn("messages", as_json)
