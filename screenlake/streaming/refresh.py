"""Refreshes of a stored corpus: batches are merged by key, each version is a folder, and a pointer names the current one.

A version is written whole before the pointer moves, so readers see the old one or the new one, and a job that dies
leaves the old. A batch that is run again makes the same table.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from screenlake.operators import merge


class Store:
    """Tables under ``root``, any file system that Spark can write."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str) -> tuple[Any, Any]:
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def version(self, name: str) -> int:
        fs, p = self._fs(f"{self.root}/{name}")
        if not fs.exists(p):
            return 0
        marks = [s.getPath().getName() for s in fs.listStatus(p)]
        return max([int(m[5:]) for m in marks if m.startswith("done-")], default=0)

    def read(self, name: str, schema: str) -> DataFrame:
        v = self.version(name)
        return self.spark.read.schema(schema).parquet(f"{self.root}/{name}/v{v}") if v else self.spark.createDataFrame([], schema)

    def write(self, name: str, df: DataFrame, partition_by: Sequence[str] = ()) -> int:
        v = self.version(name) + 1
        df.write.mode("overwrite").partitionBy(*partition_by).parquet(f"{self.root}/{name}/v{v}")
        fs, p = self._fs(f"{self.root}/{name}/done-{v}")
        fs.create(p, True).close()
        self.prune(name)
        return v

    def prune(self, name: str, keep: int = 2) -> None:
        """Drops all but the last ``keep`` versions: readers of the one before the last may still be at work."""
        last = self.version(name)
        fs, p = self._fs(f"{self.root}/{name}")
        for s in fs.listStatus(p) if fs.exists(p) else []:
            at = s.getPath().getName()
            number = at.removeprefix("done-").removeprefix("v")
            if number.isdigit() and int(number) <= last - keep:
                fs.delete(s.getPath(), True)


def upsert_batches(stream: DataFrame, store: Store, name: str, schema: str, keys: Sequence[str], order: Sequence[str], checkpoint: str, after: Callable[[DataFrame], None] | None = None):
    """Starts a query that merges all that has come, batch by batch, and ends. ``after`` sees each batch once merged."""

    def one(batch: DataFrame, batch_id: int) -> None:
        store.write(name, merge.upsert(store.read(name, schema), batch, keys, [F.col(c) for c in order]))
        if after:
            after(batch)

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def file_stream(spark: SparkSession, folder: str, schema: str, kind: str = "parquet", max_files: int = 100) -> DataFrame:
    """Files as they come; ``max_files`` of them in a batch."""
    return spark.readStream.format(kind).schema(schema).option("maxFilesPerTrigger", max_files).load(folder)


def report(counts: DataFrame) -> str:
    """Counts by source and outcome as JSON: a few rows."""
    rows = counts.collect()
    out: dict[str, dict[str, int]] = {}
    for r in rows:
        out.setdefault(r["source"], {})[r["outcome"]] = r["n"]
    return json.dumps(out, sort_keys=True)
