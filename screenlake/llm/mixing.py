"""Mixing sources to target weights, to the token.

Every document has a hash-random key. Documents are range-sorted by source and key; each task sums the tokens of its
range, and what all ranges before it hold of a source (one number for each source that a range holds) is added: the
prefix sum of each document, without moving a source to one task. A source of ``size`` tokens and a budget takes
``budget // size`` whole epochs and, of one more, the documents whose prefix sum is under what is left. ``taken`` says
how many tokens of a document count, so that they add up to the budget exactly; the document in which it ends is the
only one not counted in full.

Texts aren't moved: ``schedule`` shuffles ids and counts, and ``mix`` needs no more than a whole number of epochs and
the last key for each source. It shuffles no text but that of the document in which a budget ends, and cuts that after
the word that the budget ends with, so that ``mix`` keeps budgets to the token as well.

Weights that aren't given are the square roots of the sources' sizes, in millionths; the total that isn't given is that
of the table. Defined results: null and empty texts have no tokens and take no budget; a null source is the source
``''``; a source with no given weight, or of no tokens, takes nothing; a given source without documents is left out, its
budget too; ties of keys go by id, then by the number of tokens; repeated rows, and rows without an id, are documents of
their own (of equal ones any may be those taken); a very long text is one document; ids that aren't integers tie by a
64-bit hash; an empty table gives no rows; other columns, whatever they are called, are ignored by ``schedule`` and kept
by ``mix`` (``n_chars``, if there, is counted anew in a text that is cut).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from screenlake.llm import ids
from screenlake.llm.ids import named
from screenlake.llm.storage import Scratch, staged
from screenlake.llm.textcols import word_spans

MILLION = 1_000_000
WORD = r"[^ \t\n\x0B\f\r]+"


def tokens_of(text: Column) -> Column:
    """The number of words."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def key_of(doc_id: Column, seed: int) -> Column:
    """60 random bits by id and seed."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, 15), 16, 10).cast("long")


def budgets(sizes: DataFrame, weights: dict[str, float] | None, total: int | None) -> DataFrame:
    """(source, size, budget, epochs, rest) from (source, size)."""
    if weights is None:
        raw = F.sqrt(F.col("size").cast("double"))
    else:
        given = sorted((k, float(v)) for k, v in weights.items() if v > 0)
        raw = F.coalesce(*(F.when(F.col("source") == k, F.lit(v)) for k, v in given), F.lit(0.0)) if given else F.lit(0.0)
    every = Window.partitionBy()  # one row a source
    got = sizes.where("size > 0").withColumn("raw", raw).where("raw > 0")
    got = got.withColumn("all", F.lit(total) if total is not None else F.sum("size").over(every))
    share = F.floor(F.col("raw") / F.sum("raw").over(every) * MILLION)
    got = got.withColumn("budget", F.expr("`all` div 1000000").cast("long") * share + F.expr("`all` % 1000000").cast("long") * share / MILLION)
    got = got.withColumn("budget", F.floor("budget").cast("long"))
    return got.select("source", "size", "budget", F.expr("budget div size").alias("epochs"), F.expr("budget % size").alias("rest"))


def source_of(docs: DataFrame) -> Column:
    return F.coalesce(named("source").cast("string"), F.lit(""))


def _ranged(docs: DataFrame, seed: int, scratch: Scratch) -> DataFrame:
    """(range, source, key, id, n_tokens, doc_id, local): sorted by source and key; ``local`` is the prefix sum in the range."""
    rows = docs.select(source_of(docs).alias("source"), key_of(named("doc_id"), seed).alias("key"), ids.key_of(docs, "doc_id").alias("id"), tokens_of(named("text")).alias("n_tokens"), named("doc_id").alias("doc_id"))
    order = ["source", "key", "id", "n_tokens"]
    kind = rows.schema["doc_id"].dataType.simpleString()
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("range", F.spark_partition_id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, last = 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            n = batch.column(3).to_numpy()
            source = batch.column(0).dictionary_encode()
            code = source.indices.to_numpy()
            new = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1])))
            total = np.cumsum(n)
            start = total - n
            local = start - np.repeat(start[new], np.diff(np.append(new, len(n))))
            names = source.dictionary.to_pylist()
            if names[code[0]] == last:
                local[: new[1] if len(new) > 1 else len(n)] += before
            last, before = names[code[-1]], int(local[-1] + n[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(local)], names=[*batch.schema.names, "local"])

    return scratch.staged(rows.mapInArrow(run, f"source string, key long, id long, n_tokens long, doc_id {kind}, range int, local long"), "ranges")


def _placed(docs: DataFrame, weights: dict[str, float] | None, total: int | None, seed: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """The documents with ``start``, their prefix sums; the budgets."""
    ranged = _ranged(docs, seed, scratch)
    sums = scratch.staged(ranged.groupBy("source", "range").agg(F.sum("n_tokens").alias("n")), "sums")
    before = sums.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    planned = budgets(sums.groupBy("source").agg(F.sum("n").alias("size")), weights, total)
    placed = ranged.join(before, ["source", "range"]).withColumn("start", F.col("local") + F.col("before")).join(planned, "source")
    return placed, planned


def schedule(docs: DataFrame, *, weights: dict[str, float] | None = None, total: int | None = None, seed: int = 0) -> DataFrame:
    """(doc_id, source, epoch, key, start, n_tokens, taken): one row for each time that a document is taken."""
    placed, _ = _placed(docs, weights, total, seed, Scratch(docs.sparkSession))
    last = F.col("start") < F.col("rest")
    times = (F.col("epochs") + F.when(last, 1).otherwise(0)).cast("int")
    got = placed.where("n_tokens > 0").where(times > 0).withColumn("epoch", F.explode(F.sequence(F.lit(0), times - 1)))
    taken = F.when(F.col("epoch") < F.col("epochs"), F.col("n_tokens")).otherwise(F.least(F.col("n_tokens"), F.col("rest") - F.col("start")))
    return got.select("doc_id", "source", "epoch", "key", "start", "n_tokens", taken.alias("taken"))


def first_words(text: str, n: int) -> str:
    """A text up to the end of its ``n``-th word."""
    raw = text.encode()
    _, end, _ = word_spans(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    return text if n >= len(end) else raw[: end[n - 1]].decode()


def mix(docs: DataFrame, *, weights: dict[str, float] | None = None, total: int | None = None, seed: int = 0) -> DataFrame:
    """``docs``, each row as often as ``schedule`` takes it, all columns as they were; the last of a budget only as far as it counts."""
    scratch = Scratch(docs.sparkSession)
    placed, planned = _placed(docs, weights, total, seed, scratch)
    none = F.lit(-(1 << 63))
    placed = placed.where("n_tokens > 0").withColumn("at", F.struct("key", F.coalesce("id", none).alias("id")))
    ends = placed.where("start < rest").groupBy("source").agg(F.max("at").alias("end"))
    opened = placed.join(ends, "source").where(F.col("at") == F.col("end")).groupBy("source").agg(F.min("start").alias("first"))
    cut = planned.join(ends, "source", "left").join(opened, "source", "left").select(F.col("source").alias("__source"), "end", F.struct("epochs", "rest", "first").alias("__plan"))
    cut = staged(cut, "cuts")
    scratch.drop()
    names = [f"__{i}" for i in range(len(docs.columns))]  # whatever the columns are called
    text = F.col(names[docs.columns.index("text")])
    own = F.struct(key_of(named("doc_id"), seed).alias("key"), F.coalesce(ids.key_of(docs, "doc_id"), none).alias("id"))
    rows = docs.select(*(named(c).alias(n) for c, n in zip(docs.columns, names)), own.alias("__own"), source_of(docs).alias("__source")).join(cut, "__source")
    last = F.col("__own") == F.col("end")
    times = (F.col("__plan.epochs") + F.when(F.col("__own") < F.col("end"), 1).otherwise(0)).cast("int")
    whole = rows.where(~F.coalesce(last, F.lit(False))).withColumn("__times", times).where(F.col("__times") > 0).where(text.rlike(WORD))
    whole = whole.withColumn("__time", F.explode(F.sequence(F.lit(1), F.col("__times")))).select(*names)
    # The documents of one key in which a budget ends: one, unless its id is repeated.
    edge = rows.where(last).withColumn("__n", tokens_of(text)).where("__n > 0")
    start = F.col("__plan.first") + F.sum("__n").over(Window.partitionBy("__source").orderBy("__n").rowsBetween(Window.unboundedPreceding, 0)) - F.col("__n")
    edge = edge.withColumn("__take", F.greatest(F.lit(0), F.least(F.col("__n"), F.col("__plan.rest") - start)))
    counts = F.concat(F.array_repeat(F.col("__n"), F.col("__plan.epochs").cast("int")), F.when(F.col("__take") > 0, F.array(F.col("__take"))).otherwise(F.array()))
    edge = edge.withColumn("__take", F.explode(counts)).select(*names, "__take")
    where, size = docs.columns.index("text"), docs.columns.index("n_chars") if "n_chars" in docs.columns else -1

    def trim(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = list(b.columns[:-1])
            old = cols[where].to_pylist()
            new = [first_words(t, n) for t, n in zip(old, b.column(b.num_columns - 1).to_pylist())]
            cols[where] = pa.array(new, cols[where].type)
            if size >= 0:
                cols[size] = pa.array([n if x == y else len(y) for n, x, y in zip(cols[size].to_pylist(), old, new)], cols[size].type)
            yield pa.RecordBatch.from_arrays(cols, schema=pa.schema(list(b.schema)[:-1]))

    got = whole.unionByName(edge.mapInArrow(trim, whole.schema))
    return got.select(*(F.col(n).alias(c) for n, c in zip(names, docs.columns)))


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS source, ('0x' || substr(md5('0:' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS key,
                  coalesce(len(regexp_extract_all(text, '[^ \t\n\v\f\r]+')), 0)::BIGINT AS n_tokens FROM documents),
s AS (SELECT source, sum(n_tokens)::BIGINT AS size FROM d GROUP BY 1 HAVING sum(n_tokens) > 0),
t AS (SELECT source, size, floor(sqrt(size::DOUBLE) / sum(sqrt(size::DOUBLE)) OVER () * 1000000)::HUGEINT AS share, (sum(size) OVER ())::HUGEINT AS total FROM s),
b AS (SELECT source, (total * share // 1000000)::BIGINT // size AS epochs, (total * share // 1000000)::BIGINT % size AS rest FROM t),
p AS (SELECT d.*, epochs, rest, (sum(n_tokens) OVER (PARTITION BY d.source ORDER BY key, doc_id NULLS FIRST, n_tokens ROWS UNBOUNDED PRECEDING) - n_tokens)::BIGINT AS start
      FROM d JOIN b USING (source)),
e AS (SELECT *, unnest(range(0, epochs + CASE WHEN start < rest THEN 1 ELSE 0 END)) AS epoch FROM p WHERE n_tokens > 0)
SELECT doc_id, source, epoch::INTEGER AS epoch, key, start, n_tokens, CASE WHEN epoch < epochs THEN n_tokens ELSE least(n_tokens, rest - start) END AS taken FROM e
"""
