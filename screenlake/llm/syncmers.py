"""Document fingerprints: closed syncmers over the bytes of a text.

A k-mer (``k`` bytes of the text in ASCII lower case, any white space as a blank) is an anchor if the smallest of its
inner s-mers, by a 32-bit hash, is its first or its last one. Whether it is depends on its own bytes alone, so equal
passages of at least ``k`` bytes have equal anchors at equal distances, whatever stands around them; about
``2 / (k - s + 1)`` of all k-mers are anchors, and at least one of any ``k - s + 1`` in a row is. So a stretch of
``2 * k - s`` bytes (40) without an edit keeps an anchor. A text that has none, as it is short, is one itself.

Two fingerprints are matched by position: equal passages have equal anchors at one distance of their positions, so the distance
that most shared anchors have tells where one text lies in the other, and how much of it.

Defined results: null and empty texts have no anchors; all others have at least one; an s-mer as small as the first or
last counts as no smaller (ties choose); repeated rows each get their row; a very long text has one long row; ids are of any
type and may be null; other columns, whatever they are called, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from screenlake.llm.textcols import LOWER, blocks, list_array, range_hash, ranges, sliding_min

K, S = 24, 8


def anchors(data: np.ndarray, offsets: np.ndarray, k: int = K, s: int = S) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, position in it, hash of the k-mer) of each anchor of a block."""
    low, n = LOWER[data], len(data)
    if n < k:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(0, np.uint64)
    at = np.arange(n - s + 1)
    small = (range_hash(low, at, at + s) >> np.uint64(32)).astype(np.uint32)
    w = k - s + 1
    least = sliding_min(small, w)
    at = np.flatnonzero((small[: len(least)] == least) | (small[w - 1 :] == least))
    doc = np.searchsorted(offsets, at, "right") - 1
    whole = at + k <= offsets[doc + 1]
    at, doc = at[whole], doc[whole]
    return doc, at - offsets[doc], range_hash(low, at, at + k)


def whole(data: np.ndarray, offsets: np.ndarray, k: int = K, s: int = S) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As ``anchors``, with the whole text as the anchor of each that isn't empty and has none."""
    doc, at, h = anchors(data, offsets, k, s)
    bare = np.flatnonzero((np.bincount(doc, minlength=len(offsets) - 1) == 0) & (np.diff(offsets) > 0))
    if not len(bare):
        return doc, at, h
    place = np.searchsorted(doc, bare)
    own = range_hash(LOWER[data], offsets[bare], offsets[bare + 1])
    return np.insert(doc, place, bare), np.insert(at, place, 0), np.insert(h, place, own)


def fingerprint(docs: DataFrame, *, k: int = K, s: int = S) -> DataFrame:
    """(doc_id, n_anchors, positions, hashes) for every row of ``docs``, in one pass without a shuffle."""
    if not 0 < s < k:
        raise ValueError("0 < s < k")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in blocks(batch.column(1)):
                doc, at, h = whole(b.data, b.offsets, k, s)
                n = np.bincount(doc, minlength=b.hi - b.lo)
                pointer = np.concatenate(([0], np.cumsum(n)))
                cols = [batch.column(0).slice(b.lo, b.hi - b.lo), pa.array(n, pa.int32()), list_array(pa.array(at, pa.int32()), pointer), list_array(pa.array(h.view(np.int64)), pointer)]
                yield pa.RecordBatch.from_arrays(cols, schema=pa.schema([batch.schema.field(0), ("n_anchors", pa.int32()), ("positions", pa.list_(pa.int32())), ("hashes", pa.list_(pa.int64()))]))

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_anchors int, positions array<int>, hashes array<bigint>")


def align(prints: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, shared, shift, aligned) of each of ``pairs`` (a, b), ids of fingerprints: anchors that both have, the distance in bytes from
    ``a`` to ``b`` that most pairs of equal anchors have (of several the smallest), and how many anchors of ``a`` have it.

    Pairs without a shared anchor have 0, null and 0; a pair of an unknown or null id has no row; an id with several
    fingerprints is matched with each."""
    side = lambda c: prints.select(F.col("doc_id").alias(c), F.col("positions").alias(f"at_{c}"), F.col("hashes").alias(f"h_{c}"))
    both = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b").select("a", "b", "at_a", "h_a", "at_b", "h_b")
    kinds = [both.schema[c].dataType.simpleString() for c in ("a", "b")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shared, shift, aligned = [], [], []
            for i in range(batch.num_rows):
                at_a, h_a, at_b, h_b = (np.asarray(batch.column(c)[i].values) for c in (2, 3, 4, 5))
                order = np.argsort(h_b, kind="stable")
                lo, hi = np.searchsorted(h_b[order], h_a), np.searchsorted(h_b[order], h_a, "right")
                times = hi - lo
                shared.append(int(np.count_nonzero(times)))
                who = np.repeat(np.arange(len(h_a)), times)
                values, n = np.unique(at_b[order[ranges(lo, times)]].astype(np.int64) - at_a[who], return_counts=True)
                best = int(n.argmax()) if len(n) else -1
                shift.append(int(values[best]) if best >= 0 else None)
                aligned.append(int(n[best]) if best >= 0 else 0)
            cols = [batch.column(0), batch.column(1), pa.array(shared, pa.int32()), pa.array(shift, pa.int64()), pa.array(aligned, pa.int32())]
            yield pa.RecordBatch.from_arrays(cols, schema=pa.schema([batch.schema.field(0), batch.schema.field(1), ("shared", pa.int32()), ("shift", pa.int64()), ("aligned", pa.int32())]))

    return both.mapInArrow(run, f"a {kinds[0]}, b {kinds[1]}, shared int, shift bigint, aligned int")
