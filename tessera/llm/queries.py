"""The operators' queries over the benchmark tables, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers

from . import (decontamination, hard_negatives, langid, line_dedup, packing, repetition, runs, sentencepieces, sharding, simhash,
               token_counts, toxicity, warc)
from .common import read_table


def op1_simhash(spark, sf_dir):
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"))


def op2_toxicity(spark, sf_dir):
    return toxicity.score_documents(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op3_warc(spark, sf_dir):
    return warc.resolve_pages(read_table(spark, sf_dir, "pages"))


def op4_sharding(spark, sf_dir):
    return sharding.shard_documents(read_table(spark, sf_dir, "documents"))


def op5_token_counts(spark, sf_dir):
    return token_counts.count_documents(read_table(spark, sf_dir, "documents"),
                                        public_tokenizers.path("piece_bpe_32k.model"))


def op6_quality(spark, sf_dir):
    return repetition.quality_documents(read_table(spark, sf_dir, "documents"))


def op7_decontamination(spark, sf_dir):
    return decontamination.contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op8_line_dedup(spark, sf_dir):
    return line_dedup.line_dedup_report(read_table(spark, sf_dir, "documents"))


def op9_packing(spark, sf_dir):
    return packing.pack_documents(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                                  public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op10_langid(spark, sf_dir):
    return langid.identify_documents(read_table(spark, sf_dir, "documents"))


def op11_sentencepieces(spark, sf_dir):
    return sentencepieces.round_trip_digests(read_table(spark, sf_dir, "documents"),
                                             public_tokenizers.path("piece_bpe_32k.model"))


def op12_runs(spark, sf_dir):
    return runs.run_digests(read_table(spark, sf_dir, "documents"))


def op13_hard_negatives(spark, sf_dir):
    return hard_negatives.mine_embeddings(read_table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_simhash, op2_toxicity, op3_warc, op4_sharding, op5_token_counts, op6_quality,
                                  op7_decontamination, op8_line_dedup, op9_packing, op10_langid, op11_sentencepieces, op12_runs,
                                  op13_hard_negatives)}

ORACLE_SQL = {"op3_warc": warc.WARC_SQL, "op8_line_dedup": line_dedup.LINE_DEDUP_SQL,
              "op12_runs": runs.RUNS_SQL,
              "op13_hard_negatives": hard_negatives.HARD_NEGATIVES_SQL}
