"""The training-corpus pipeline: five stages over ``documents``, each written as Parquet and read again for the next.

The first four return the columns of ``documents``; the last returns ``doc_id`` and the tokens of each text.

Defined results: null and empty texts aren't toxic, copies or repeats, and have no tokens, so that they pass the first three
stages and are left behind by the mixture; a row without an id is never cut for repeats, and goes as a copy of an equal
text; rows that repeat id and text become one; ids, if they aren't integers, rank by a hash; very long texts are taken whole;
further columns, whatever they are called, are kept up to the last stage; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from screenlake.llm import bpe, mixing, neardup, repeats, toxicity
from screenlake.llm.storage import staged

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the calibrated trees, fitted to the labelled ones, take for toxic go."""
    return toxicity.reject(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies one document stays."""
    return neardup.deduplicate(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each passage that repeats the first place stays."""
    return repeats.deduplicate(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are taken, or taken again, until each source has its share of the tokens."""
    return mixing.mix(docs)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The tokens of each text, with a check that they decode to it."""
    return bpe.encode(docs)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", reject_toxic),
    ("minhash near-dedup", drop_near_copies),
    ("suffix-array dedup", cut_repeats),
    ("mixing sources", mix_sources),
    ("byte-level bpe", encode_tokens),
]

#: Trees, transforms and tokens have no SQL: the stages are tested against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after another."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = staged(docs, f"stage{i + 1}")
    return docs
