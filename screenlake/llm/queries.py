"""Queries of this subpackage: each operator over the whole of its table, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from screenlake.llm import bpe, langmix, mixing, mtree, neardup, pseudolikelihood, repeats, reputation, syncmers, toxicity

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langmix.identify(_table(spark, sf_dir, "documents"))


def op2_mtree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mtree.neighbours(_table(spark, sf_dir, "embeddings"))


def op3_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labels whose id is that of a page are its outcomes."""
    outcomes = _table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), F.col("quality").alias("good"))
    return reputation.score(_table(spark, sf_dir, "pages"), outcomes)


def op4_closed_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.fingerprint(_table(spark, sf_dir, "documents"))


def op5_containment_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.copies(_table(spark, sf_dir, "documents"))


def op6_source_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.schedule(_table(spark, sf_dir, "documents"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(_table(spark, sf_dir, "documents"))


def op8_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.find(_table(spark, sf_dir, "documents"))


def op9_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudolikelihood.score(_table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_language_mixture, op2_mtree_search, op3_host_reputation, op4_closed_syncmers, op5_containment_ensemble, op6_source_mixture, op7_byte_bpe, op8_repeated_passages, op9_pseudo_likelihood, op10_toxicity)}


def oracle_sql() -> dict[str, str]:
    return {"op2_mtree_search": mtree.ORACLE_SQL, "op3_host_reputation": reputation.ORACLE_SQL, "op6_source_mixture": mixing.ORACLE_SQL, "op8_repeated_passages": repeats.ORACLE_SQL}
