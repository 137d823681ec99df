"""Merges by key, the state of a corpus, and what was rejected.

A merge is an anti-join of what was with the keys of what came, and a union: one shuffle of each side on the key, or
none of the old side where the new one is small enough to be sent to it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from screenlake.config import LABELS, SOURCES
from screenlake.schemas import MIRROR_STATE


def sorted_side(df: DataFrame) -> DataFrame:
    """A side of a join that grows with the input. Spark would broadcast it by the size of its files, which compress far better than rows do, and all of it would pass through the driver."""
    return df.hint("merge")


def last_of(batch: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The last row of each key."""
    w = Window.partitionBy(*keys).orderBy(*(F.desc(c) if isinstance(c, str) else c.desc() for c in order))
    return batch.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def upsert(old: DataFrame, batch: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """``old`` with the last row of each key of ``batch`` in place of its own. Rows gone upstream stay."""
    new = last_of(batch, keys, order)
    return old.join(sorted_side(new.select(*keys)), list(keys), "left_anti").select(*old.columns).unionByName(new.select(*old.columns))


def replace_by_child(old: DataFrame, batch: DataFrame, order: Sequence[Column | str], *, insert_only: bool = False) -> DataFrame:
    """Edges: those of every child in the batch go before the batch's come; with ``insert_only`` only equal edges do."""
    key = ["child_lei", "parent_lei", "relationship_type"]
    if insert_only:
        return upsert(old, batch, key, order)
    kept = old.join(batch.select("child_lei").distinct(), "child_lei", "left_anti")
    return kept.select(*old.columns).unionByName(last_of(batch, key, order).select(*old.columns))


def last_known(rows: DataFrame, key: str, order: Column, columns: Sequence[str]) -> DataFrame:
    """For each key the last value of each column that isn't null."""
    return rows.groupBy(key).agg(*(F.max_by(c, F.when(F.col(c).isNotNull(), order)).alias(c) for c in columns))


def apply_deferred(designations: DataFrame, deferred: DataFrame) -> DataFrame:
    """Programme and date of (source, source_entry_id) where ``deferred`` has a row, nulls of it too; no row is added."""
    d = deferred.select("source", "source_entry_id", F.col("program").alias("__program"), F.col("designation_date").alias("__date"), F.lit(True).alias("__hit"))
    got = designations.join(d, ["source", "source_entry_id"], "left")
    got = got.withColumn("program", F.when(F.col("__hit"), F.col("__program")).otherwise(F.col("program")))
    return got.withColumn("designation_date", F.when(F.col("__hit"), F.col("__date")).otherwise(F.col("designation_date"))).select(*designations.columns)


def tallied(rows: DataFrame, identifier: Column, name_usable: Column) -> tuple[DataFrame, DataFrame]:
    """(rows with an identifier and a usable name, counts by ``outcome``): a missing identifier is looked at first."""
    outcome = F.when(identifier.isNull(), "missing_identifier").when(~name_usable, "unusable_name").otherwise("accepted")
    marked = rows.withColumn("__outcome", outcome)
    return marked.where("__outcome = 'accepted'").drop("__outcome"), marked.groupBy(F.col("__outcome").alias("outcome")).agg(F.count("*").alias("n"))


def source_list(designations: DataFrame) -> DataFrame:
    """(source, label, records): all sources, with 0 where there are none."""
    spark = designations.sparkSession
    every = spark.createDataFrame([(s, LABELS[s]) for s in SOURCES], "source string, label string")
    counts = designations.groupBy("source").agg(F.count("*").alias("records"))
    return F.broadcast(every).join(counts, "source", "left").select("source", "label", F.coalesce("records", F.lit(0)).alias("records"))


def state(spark: SparkSession, mirror: str, status: str, completed_at: str | None, total: int, checkpoint: str | None = None) -> DataFrame:
    return spark.createDataFrame([(mirror, status, completed_at, total, checkpoint)], MIRROR_STATE)


def marked_ready(states: DataFrame, mirror: str, completed_at: str, total: int) -> DataFrame:
    new = state(states.sparkSession, mirror, "complete", completed_at, total)
    return upsert(states, new, ["mirror"], ["completed_at"])


def advanced(states: DataFrame, mirror: str, completed_at: str, total: int) -> DataFrame:
    """A delta makes a corpus fresher only if it was complete before."""
    ready = (F.col("mirror") == mirror) & F.col("completed_at").isNotNull()
    return states.withColumn("total", F.when(ready, F.lit(total)).otherwise(F.col("total"))).withColumn("completed_at", F.when(ready, F.lit(completed_at)).otherwise(F.col("completed_at")))


def readiness(states: DataFrame) -> DataFrame:
    """(mirror, ready, status, completed_at, total): ready once a run has ever been completed."""
    return states.select("mirror", F.col("completed_at").isNotNull().alias("ready"), "status", "completed_at", F.coalesce("total", F.lit(0)).alias("total"))
