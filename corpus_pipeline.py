"""Preparing a corpus for training: documents in, token ids out, one operator a stage.

Each stage sets its session up for long texts itself: whoever runs the stages one by one, as run() does, needs no other setting.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quern.llm import byte_bpe, decontaminate, language_id, order_minhash, sentence_spans
from quern.llm.common import scratch, small_batches


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told."""
    small_batches(spark)
    return language_id.keep_identified(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    small_batches(spark)
    return order_minhash.keep_first(docs)


def span_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the sentences that repeat an earlier passage; those that have nothing else go."""
    small_batches(spark)
    return sentence_spans.remove_repeats(docs).where("trim(text) <> ''")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    return decontaminate.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of the bytes that they decode to."""
    small_batches(spark)
    return byte_bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("language ID", identify), ("MinHash near-dedup", near_dedup), ("substring dedup", span_dedup), ("benchmark decontamination", decontamination), ("byte-level BPE", tokens)]

#: SQL has no support vector machines and no Order MinHash; tests/llm holds the pipeline against a plain version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder, each written as Parquet and read again as the input of the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            to = scratch(spark, f"stage-{i}")
            docs.write.parquet(to)
            docs = spark.read.schema(docs.schema).parquet(to)
    return docs
