"""A training corpus from ``documents``: quality rules, near and substring dedup, mixing, packing.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that its predecessor kept; all but the
last return the columns of ``documents``.
"""

from __future__ import annotations

from functools import partial

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from momentra.llm import mixing, near_dedup, packing, quality, shared, substring_dedup


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return quality.filtered(docs)


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one with the smallest id."""
    return near_dedup.one_of_each(docs)


def substring_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that start in an earlier document are cut; a document of which nothing is left goes."""
    return substring_dedup.cut(docs).withColumn("n_chars", F.length("text").cast("long"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn so that source, language and topic meet their target weights."""
    return mixing.sample(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of 2048 ids."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


STAGES = [
    ("quality rules", quality_rules),
    ("minhash near-dedup", minhash_near_dedup),
    ("substring dedup", substring_dedup_stage),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written and read as the next one's input."""
    docs, last = shared.table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = shared.settled(partial(stage, spark, docs, sf_dir), name.replace(" ", "-"))
        if last is not None:
            shared.forget(last)  # its rows are in the next table
        last = docs
    return docs
