"""The operators as named queries over whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from rillbook.llm import (
    forest_search, html_text, licences, mixing, ngram_join, phrases, prefix_bpe, pseudonyms, record_files, secret_scan,
    token_counts, weak_rules, word_runs,
)

#: Appended to every document's ids in the record files.
END_ID = 2


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_forest_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest_search.nearest(_table(spark, sf_dir, "embeddings"))


def op2_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonyms.pseudonym_report(_table(spark, sf_dir, "documents"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_spans(_table(spark, sf_dir, "documents"))


def op4_weak_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weak_rules.quality_report(_table(spark, sf_dir, "documents"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(_table(spark, sf_dir, "documents"))


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extracted(_table(spark, sf_dir, "pages"))


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join_report(_table(spark, sf_dir, "documents"))


def op8_record_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    return record_files.document_records(_table(spark, sf_dir, "documents"), path, END_ID)


def op9_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scanned(_table(spark, sf_dir, "documents"))


def op10_prefix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return prefix_bpe.encode_documents(_table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(_table(spark, sf_dir, "documents"))


def op12_word_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_runs.word_runs(_table(spark, sf_dir, "documents"), word_runs.periodic_tail)


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    return token_counts.token_counts(_table(spark, sf_dir, "documents"), path)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def llm_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (
        op1_forest_search, op2_pseudonyms, op3_secret_scan, op4_weak_rules, op5_mixing, op6_html_text, op7_ngram_join,
        op8_record_files, op9_licences, op10_prefix_bpe, op11_phrases, op12_word_runs, op13_token_counts, pipeline,
    )
    return {q.__name__: q for q in every}


def llm_oracle_sql() -> dict[str, str]:
    return {"op5_mixing": mixing.oracle(), "op9_licences": licences.oracle()}
