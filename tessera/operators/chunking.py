"""Document text extraction, normalisation and overlapping character chunks.

Chunk rule (defaults): size 1024, overlap floor(2*size/3) = 682, step 342.
Starts 0, step, 2*step, ... < len(text); every start yields a chunk, so the
last chunks are suffixes of earlier ones; count = ceil(len/step); empty or
null text yields no chunk (and the document drops out of the chunk table).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from ..functions.ids import stable_id
from ..functions.text import join_pages, normalize_ws

CHUNK_SIZE = 1024
# Fixed value: metadata text of a chunk, exactly as a Python dict repr prints it.
METADATA_FORMAT = "{'chunk_index': %d, 'source': 'pdf_document'}"


def chunk_step(size: int = CHUNK_SIZE, overlap: int | None = None) -> int:
    if overlap is None:
        overlap = size * 2 // 3
    step = size - overlap
    if step <= 0:
        raise ValueError("overlap must be smaller than size")
    return step


def chunk_text(df: DataFrame, text_col: str, size: int = CHUNK_SIZE,
               overlap: int | None = None, normalize: bool = True) -> DataFrame:
    """Add ``chunk_index`` and ``content`` (one row per chunk) to ``df``.

    Runs as a projection + generator: no shuffle, no Python; the text is
    normalised once per document before the rows multiply.
    """
    step = chunk_step(size, overlap)
    text = normalize_ws(text_col) if normalize else F.col(text_col)
    base = df.withColumn("_text", text).withColumn("_len", F.length("_text"))
    # blank texts go after the generator: a filter in front of it would normalise each text again
    starts = F.when(F.col("_len") > 0, F.sequence(F.lit(0), F.floor((F.col("_len") - 1) / step).cast("int")))
    exploded = base.withColumn("chunk_index", F.explode_outer(starts)).filter(F.col("chunk_index").isNotNull())
    return (exploded
            .withColumn("content", F.expr(f"substring(_text, chunk_index * {step} + 1, {size})"))
            .drop("_text", "_len"))


def chunk_documents(docs: DataFrame, text_col: str = "text", name_col: str = "doc_name",
                    uri_col: str = "doc_uri", size_col: str = "size",
                    size: int = CHUNK_SIZE, overlap: int | None = None) -> DataFrame:
    """Chunk table ``(id, doc_name, doc_uri, size, content, metadata, chunk_index)``.

    ``id`` is a stable hash of (doc_uri, chunk_index) instead of a random uuid,
    so re-ingesting unchanged documents yields unchanged ids.
    """
    chunks = chunk_text(docs.select(name_col, uri_col, size_col, text_col), text_col, size, overlap)
    return chunks.select(
        stable_id(uri_col, "chunk_index").alias("id"),
        F.col(name_col).alias("doc_name"),
        F.col(uri_col).alias("doc_uri"),
        F.col(size_col).cast("bigint").alias("size"),
        "content",
        F.format_string(METADATA_FORMAT, "chunk_index").alias("metadata"),
        F.col("chunk_index").cast("bigint").alias("chunk_index"),
    )


def utf8_pages(content: bytes) -> list[str | None]:
    """Default extractor: UTF-8 text, pages separated by form feeds."""
    return content.decode("utf-8").split("\f")


EXTRACT_SCHEMA = T.StructType([
    T.StructField("path", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("error", T.StringType()),
])


def extract_text(files: DataFrame, extractor: Callable[[bytes], list[str | None]] = utf8_pages,
                 content_col: str = "content", path_col: str = "path") -> DataFrame:
    """Run a pluggable page extractor over binary rows: ``(path, text, error)``.

    Pages are joined with newlines (a missing page counts as ''). A document the
    extractor cannot read gets ``error`` set and ``text`` null, instead of
    failing the job; split it off with :func:`split_quarantine`. Null content
    gives null text (no chunks later) and the error that the scan may have set.
    """
    known = F.col("error") if "error" in files.columns else F.lit(None).cast("string")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts, errors = [], []
            for blob, error in zip(pdf[content_col], pdf["_error"]):
                if blob is None:
                    texts.append(None)
                    errors.append(error)
                    continue
                try:
                    pages = extractor(bytes(blob))
                    texts.append("\n".join(p or "" for p in pages))
                    errors.append(None)
                except Exception as ex:  # noqa: BLE001 - any parse failure is quarantined
                    texts.append(None)
                    errors.append(f"Error parsing document: {ex}")
            yield pd.DataFrame({"path": pdf[path_col], "text": texts, "error": errors})

    return files.select(path_col, content_col, known.alias("_error")).mapInPandas(run, EXTRACT_SCHEMA)


def split_quarantine(df: DataFrame, error_col: str = "error") -> tuple[DataFrame, DataFrame]:
    """(good rows, failed rows)."""
    return df.filter(F.col(error_col).isNull()), df.filter(F.col(error_col).isNotNull())


def pages_text(df: DataFrame, pages_col: str = "pages") -> DataFrame:
    """Replace an array of page texts by their newline join."""
    return df.withColumn("text", join_pages(pages_col)).drop(pages_col)
