"""A training-corpus pipeline over the ``documents`` table.

Each stage takes the documents that its predecessor kept and returns a DataFrame,
which is written as Parquet and read again for the next one. All stages but the
last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontamination, langid, line_dedup, packing, simhash
from tessera.llm.common import read_table, stored


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; profiles are learned from the learnable rows."""
    return langid.accepted(docs, langid.learn(docs))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that stand earlier in the corpus. One of which no line
    but blank ones is left goes. ``n_chars`` follows the text."""
    found = line_dedup.dedup_lines(docs)
    text = F.col("row.text")
    row = F.col("row").withField("n_chars", F.char_length(text).cast(docs.schema["n_chars"].dataType)) \
        if "n_chars" in docs.columns else F.col("row")
    changed = F.when(F.col("n_removed") > 0, row).otherwise(F.col("row"))
    return (found.where((F.col("n_removed") == 0) | (F.length(F.regexp_replace(text, r"\s+", "")) > 0))
            .select(changed.alias("row")).select("row.*"))


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return simhash.one_of_each_group(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontamination.without_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in the training sequences."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"),
                                  public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("language_id", language_id), ("line_dedup", line_dedup_stage), ("simhash_dedup", simhash_dedup),
          ("benchmark_decontamination", benchmark_decontamination), ("packing", packing_stage)]

#: SQL has no tokenizer; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over the whole ``documents`` table."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
