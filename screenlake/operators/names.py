"""The name index: one row for each published name and alias."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from screenlake.functions.phonetic import phonetic
from screenlake.functions.text import fold, tokens
from screenlake.operators.merge import sorted_side


def name_index(designations: DataFrame, *, with_phonetic: bool = True) -> DataFrame:
    """Primary names (``name_ord`` 0) and aliases; names that fold to nothing aren't indexed. No shuffle."""
    primary = F.array(F.struct(F.col("primary_name").alias("name"), F.lit("primary").alias("name_type")))
    rows = designations.select(F.col("id").alias("designation_id"), F.posexplode(F.concat(primary, F.coalesce("aliases", F.array().cast("array<struct<name:string,name_type:string>>")))).alias("name_ord", "n"))
    rows = rows.select("designation_id", "name_ord", F.col("n.name").alias("name"), fold(F.col("n.name")).alias("normalized"), F.col("n.name_type").alias("name_type"))
    rows = rows.where("normalized != ''").withColumn("tokens", tokens(F.col("normalized")))
    key = phonetic("normalized") if with_phonetic else F.lit(None).cast("string")
    return rows.select("designation_id", "name_ord", "name", "normalized", "tokens", key.alias("phonetic"), "name_type")


def screenable(names: DataFrame, designations: DataFrame) -> DataFrame:
    """The index with what a hit shows of its designation."""
    d = designations.select(F.col("id").alias("designation_id"), "source", "source_entry_id", "entity_type", "primary_name", "program", "designation_date")
    return names.join(sorted_side(d), "designation_id")
