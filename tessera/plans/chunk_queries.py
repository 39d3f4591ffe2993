"""Document normalisation and chunking queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import normalize_ws
from ..operators.chunking import chunk_documents
from .catalog import register
from .doc_inputs import DOCS_SQL, NORM_SQL, chunks_sql, document_files


@register("normalize_text", f"""
SELECT doc_id, {NORM_SQL.format(c='text')} AS norm_text,
       CAST(length({NORM_SQL.format(c='text')}) AS BIGINT) AS norm_chars
FROM documents""")
def q_normalize_text(spark, sf_dir):
    d = document_files(spark, sf_dir)
    return d.select("doc_id", normalize_ws("text").alias("norm_text")) \
        .withColumn("norm_chars", F.length("norm_text").cast("bigint"))


@register("chunk_documents", "WITH " + DOCS_SQL + "," + chunks_sql() + " SELECT * FROM chunks")
def q_chunk_documents(spark, sf_dir):
    return chunk_documents(document_files(spark, sf_dir))
