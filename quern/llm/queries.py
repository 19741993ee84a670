"""The operators of this subpackage as queries over the given tables, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import byte_bpe, decontaminate, fill_middle, language_id, main_text, order_minhash, periodic_runs, projection_forest, sentence_spans, token_counts, token_store, url_rules, warc
from .common import scratch, small_batches

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, in a session that is set up for long texts."""
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(_table(spark, sf_dir, "documents"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op3_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    to = scratch(spark, "tokens")
    token_store.write_tokens(_table(spark, sf_dir, "documents"), to, public_tokenizers.path("word_bpe_49k.json"))
    return token_store.read_tokens(spark, to, tokens=False)


def op4_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge(_table(spark, sf_dir, "pages"), _table(spark, sf_dir, "labels"))


def op5_projection_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projection_forest.links(_table(spark, sf_dir, "embeddings"))


def op6_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.classes(_table(spark, sf_dir, "documents"))


def op7_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_spans.remove_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"), "n_removed")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.extract_pages(_table(spark, sf_dir, "pages"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.encode_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op11_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages"), scratch(spark, "archives"))


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.digests(_table(spark, sf_dir, "documents"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.digests(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_language_id,
        op2_token_counts,
        op3_token_store,
        op4_url_rules,
        op5_projection_forest,
        op6_order_minhash,
        op7_sentence_spans,
        op8_decontaminate,
        op9_main_text,
        op10_byte_bpe,
        op11_warc_archives,
        op12_fill_middle,
        op13_periodic_runs,
    )
}
ORACLES: dict[str, str] = {"op4_url_rules": url_rules.ORACLE, "op5_projection_forest": projection_forest.ORACLE, "op8_decontaminate": decontaminate.ORACLE, "op11_warc_archives": warc.ORACLE, "op12_fill_middle": fill_middle.ORACLE}
