"""A corpus pipeline over ``documents``: stages that each call one operator of ``dqengine.llm``.

Quality rules take repeated lines and poor documents out, one document of each group of near copies stays, sources
are mixed to their target weights (documents may then occur up to three times), and the texts are encoded.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from dqengine.llm import bpe, line_quality, mixing, simhash
from dqengine.session import materialize

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, without the lines that are too frequent on their source."""
    return line_quality.clean(docs, length_column="n_chars")


def different_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose SimHash fingerprints (3 words) are linked by 2 or fewer bits."""
    return simhash.drop_near_duplicates(docs, words=3, most_bits=2)


def mixed_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources; a document that is taken more than once is as many rows."""
    return mixing.mix(docs)


def encoded_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number of ids of each text, and digests of the ids and of what they decode to."""
    return bpe.digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", good_documents),
    ("SimHash near-dedup", different_documents),
    ("mixing sources to target weights", mixed_documents),
    ("byte-level BPE encoding and decoding", encoded_documents),
]

#: No SQL: neither the fingerprints nor BPE have a SQL form. Tests compare with a plain version in Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each on the written result of the one before."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES):
            docs = materialize(docs, f"stage-{number}")
    return docs
