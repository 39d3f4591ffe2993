"""Document inputs derived from the ``documents`` table (text already extracted)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources.tables import load_table


def document_files(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """``(doc_id, doc_name, doc_uri, size, text)`` and ``more`` columns of the table;
    size is the UTF-8 byte length."""
    return document_columns(load_table(spark, sf_dir, "documents"), *more)


def document_columns(d: DataFrame, *more: str) -> DataFrame:
    """The file-like columns of a ``documents`` frame (batch or streaming)."""
    name = F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return d.select(
        "doc_id",
        name.alias("doc_name"),
        F.concat(F.lit("/volumes/documents/"), F.col("source"), F.lit("/"), name).alias("doc_uri"),
        F.octet_length("text").cast("bigint").alias("size"),
        "text",
        *more,
    )


DOCS_SQL = """
docs AS (
  SELECT doc_id, 'doc-' || CAST(doc_id AS VARCHAR) || '.txt' AS doc_name,
         '/volumes/documents/' || source || '/doc-' || CAST(doc_id AS VARCHAR) || '.txt' AS doc_uri,
         CAST(strlen(text) AS BIGINT) AS size, text
  FROM documents)
"""

NORM_SQL = r"trim(regexp_replace({c}, '[\s\x{{0b}}-\x{{0d}}\x{{1c}}-\x{{1f}}\x{{85}}\p{{Z}}]+', ' ', 'g'))"


def chunks_sql(source: str = "docs", step: int = 342, size: int = 1024) -> str:
    """DuckDB chunk table over a CTE with (doc_name, doc_uri, size, text)."""
    return f"""
normed AS (SELECT doc_name, doc_uri, size, {NORM_SQL.format(c='text')} AS t FROM {source}),
chunks AS (
  SELECT sha256(doc_uri || chr(1) || CAST(i AS VARCHAR)) AS id, doc_name, doc_uri,
         CAST(size AS BIGINT) AS size, substr(t, CAST(i * {step} + 1 AS BIGINT), {size}) AS content,
         '{{''chunk_index'': ' || CAST(i AS VARCHAR) || ', ''source'': ''pdf_document''}}' AS metadata,
         CAST(i AS BIGINT) AS chunk_index
  FROM normed, LATERAL (SELECT unnest(generate_series(0, (length(t) - 1) // {step})) AS i)
  WHERE length(t) > 0)
"""
