"""From raw documents to packed training sequences, stage by stage.

Each stage reads what its predecessor kept, as a Parquet table; the last returns packed pieces.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from cardloom.llm import dart_minhash, languages, packing, quality
from cardloom.llm.common import ready, table, written


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of predicted quality 1, by a classifier that learns from the labels of those given."""
    ready(spark)
    return quality.with_quality(docs, quality.train(docs, table(spark, sf_dir, "labels")), keep_only=True)


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages learned; those that the network cannot place, without a letter, empty and NULL ones go."""
    ready(spark)
    return languages.with_language(docs, languages.train(docs, judging=True), keep_only=True)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates: that of the smallest id."""
    ready(spark)
    return dart_minhash.keep_one(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents left, packed into sequences of at most 1024 tokens, with their ids."""
    ready(spark)
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=0)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", good_quality),
    ("language", known_language),
    ("near_duplicates", one_of_each),
    ("packing", packed),
]

# Models and tokenizers are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`."""
    docs = table(ready(spark), sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
