"""Reading published XML: record by record, every value a string, only the fields that are used."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from screenlake.functions.normalise import fragments
from screenlake.functions.text import blank_to_null, fold, usable
from screenlake.operators.merge import tallied
from screenlake.schemas import DESIGNATION, conform

OPTIONS = {"attributePrefix": "_", "valueTag": "_VALUE", "ignoreNamespace": "true", "inferSchema": "false", "mode": "PERMISSIVE", "charset": "UTF-8"}
GUARD = r"(?is)^\s*<(!doctype\s+html|html[\s>])"


#: Bytes of a download that tell what it is.
HEAD = 1024


class WrongContent(ValueError):
    """A download is empty, or a web page in place of a feed."""


def read_records(spark: SparkSession, paths: str | Sequence[str], tag: str, schema: str) -> DataFrame:
    """The elements ``tag`` (its local name) of plain or gzipped files, one row each; large files are split."""
    return spark.read.format("xml").options(rowTag=tag, **OPTIONS).schema(schema).load(paths if isinstance(paths, str) else list(paths))


def parse_records(texts: DataFrame, column: str, tags: Sequence[str], schema: str) -> DataFrame:
    """The same from a column of markup."""
    # A search for a name is far cheaper than one for elements, and feeds of several parts are searched for each.
    held = F.lit(False)
    for t in tags:
        held = held | F.contains(F.col(column), F.lit(t))
    one = texts.select(F.explode(F.when(held, fragments(F.col(column), tags))).alias("x"))
    # Filters and fields don't go through a generator, so a record is parsed once, and not once for each use of a field.
    return one.select(F.inline(F.array(F.from_xml("x", schema, {k: v for k, v in OPTIONS.items() if k != "charset"}))))


def is_wrong(head: Column) -> Column:
    """Whether the beginning of a download is blank, or that of a web page."""
    return F.coalesce((F.trim(head) == "") | head.rlike(GUARD), F.lit(True))


def guarded(spark: SparkSession, path: str) -> None:
    """Raises WrongContent for an empty file or a web page, by its first bytes: no job, whatever the file's size."""
    raw = b""
    for at in _files(spark, path):
        stream = _system(spark, at).open(at)
        try:
            raw = bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(spark._jvm.org.apache.commons.io.input.BoundedInputStream(stream, HEAD)))
        finally:
            stream.close()
        if raw.strip():
            break
    if wrong_head(raw):
        raise WrongContent(path)


def wrong_head(raw: bytes) -> bool:
    """``is_wrong`` of the first bytes of one file."""
    head = raw.decode("utf-8", "replace").lstrip("\ufeff")
    return not head.strip() or re.match(GUARD, head) is not None


def _system(spark: SparkSession, path):
    return path.getFileSystem(spark._jsc.hadoopConfiguration())


def _files(spark: SparkSession, pattern: str) -> list:
    """The files that a path, folder or pattern names."""
    p = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    fs = _system(spark, p)
    out = []
    for found in fs.globStatus(p) or []:
        out += [s.getPath() for s in fs.listStatus(found.getPath()) if s.isFile()] if found.isDirectory() else [found.getPath()]
    return out


def inflated(spark: SparkSession, path: str, to: str) -> str:
    """The first entry of a ZIP, or what gzip holds, as a plain file ``to``; the path itself if it is neither.

    An archive is one stream; it is copied by buffers of 64 kB, so neither its size nor that of what it holds matters. The
    plain file can then be split among tasks."""
    jvm = spark._jvm
    p, target = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(to)
    stream = _system(spark, p).open(p)
    magic = bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(jvm.org.apache.commons.io.input.BoundedInputStream(stream, 4)))
    if magic[:2] not in (b"PK", b"\x1f\x8b"):
        stream.close()
        return path
    stream.seek(0)
    if magic[:2] == b"PK":
        source = jvm.java.util.zip.ZipInputStream(stream)
        if source.getNextEntry() is None:
            stream.close()
            raise WrongContent(path)
    else:
        source = jvm.java.util.zip.GZIPInputStream(stream)
    jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, _system(spark, target).create(target, True), 1 << 16, True)
    return to


def unzipped(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of small archives, many at once: the first entry of a ZIP, or what gzip holds, or the bytes as they are. For large ones: ``inflated``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import gzip

        for b in batches:
            for name, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if raw[:4] == b"PK\x03\x04":
                    with zipfile.ZipFile(io.BytesIO(raw)) as z:
                        raw = z.read(z.infolist()[0])
                elif raw[:2] == b"\x1f\x8b":
                    raw = gzip.decompress(raw)
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([raw.decode("utf-8", "replace")], pa.large_string())], ["path", "text"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, text string")


def file_url(index_json: Column, kind: str = "lei2", window: str | None = None) -> Column:
    """Where an index says the full file is, or the delta of a window."""
    base = "$.data[0].full_file.xml.url" if window is None else f"$.data[0].delta_files.{window}.xml.url"
    return F.coalesce(F.get_json_object(index_json, base), F.get_json_object(index_json, base.replace("data[0].", f"data[0].{kind}.")))


text = blank_to_null


def spaced(*parts: Column) -> Column:
    return text(F.concat_ws(" ", *map(text, parts)))


def kept(values: Column, f) -> Column:
    """A list after ``f``, without nulls; of no list an empty one."""
    return F.coalesce(F.filter(F.transform(values, f), lambda x: x.isNotNull()), F.array())


def designations(rows: DataFrame, source: str) -> tuple[DataFrame, DataFrame]:
    """(designations, counts by outcome) of rows with ``entry``, ``entity_type``, ``named`` (array of name and name_type, the primary first) and what else is known."""
    # The filter by outcome stays above a generator; else it would hold all that makes the names once more.
    rows = rows.select(*(c for c in rows.columns if c != "named"), F.inline(F.array(F.struct(F.filter("named", lambda n: usable(n["name"])).alias("named")))))
    rows = rows.withColumn("primary_name", F.get("named", F.lit(0))["name"])
    fine, counts = tallied(rows, F.col("entry"), F.col("primary_name").isNotNull())
    fine = fine.withColumn("source", F.lit(source)).withColumn("source_entry_id", F.col("entry")).withColumn("id", F.concat_ws(":", F.lit(source), "entry"))
    fine = fine.withColumn("normalized_name", fold(F.col("primary_name"))).withColumn("aliases", F.slice("named", 2, F.greatest(F.size("named"), F.lit(1))))
    return conform(fine, DESIGNATION), counts.withColumn("source", F.lit(source))
