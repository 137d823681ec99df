"""Ids of any type as 64-bit keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def named(column: str) -> Column:
    """A column by its exact name, dots and all."""
    return F.col("`" + column.replace("`", "``") + "`")


def integral(rows: DataFrame, column: str) -> bool:
    return rows.schema[column].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint")


def key_of(rows: DataFrame, column: str) -> Column:
    """An integer id itself, or a 64-bit hash of any other; null where the id is null."""
    c = named(column)
    return c.cast("long") if integral(rows, column) else F.when(c.isNotNull(), F.xxhash64(c.cast("string")))
