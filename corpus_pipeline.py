"""A training corpus from documents: five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from rillbook.llm import mixing, ngram_join, prefix_bpe, pseudonyms, weak_rules
from rillbook.llm.common import stored
from rillbook.session import configure_long_texts


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly supervised rules call good."""
    return weak_rules.good_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies."""
    return ngram_join.one_of_each(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by pseudonyms."""
    return pseudonyms.pseudonymised(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target asks for."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and hashes of every document of the mix."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return prefix_bpe.encode_documents(docs, path, public_tokenizers.PATTERN)


def in_small_batches(stage: Callable) -> Callable:
    """The stage on a session set for long texts, which it stays: what a stage returns is read later."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        return stage(configure_long_texts(spark), docs, sf_dir)

    return run


STAGES = [
    ("quality rules", in_small_batches(quality)),
    ("near duplicates", in_small_batches(near_duplicates)),
    ("personal data", in_small_batches(personal_data)),
    ("mix to target weights", in_small_batches(mix)),
    ("byte-level BPE", in_small_batches(encode)),
]

#: Expectation-maximisation, MinHash and merges are beyond SQL; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
