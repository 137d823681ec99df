"""Suffix-array dedup: merged Burrows-Wheeler transforms of the passages that may repeat.

A repeat is a window of ``words`` words (ASCII white space separates, every byte counts) that stands at more than one
place of the corpus. Every window is sent to the bucket of its smallest inner ``GRAM``-word hash, so equal windows meet
whatever stands around them; a run of windows of one bucket travels as one string, once for each distinct string of an
Arrow batch. A bucket is small and is worked on alone, wherever its strings came from.

In a bucket the strings are dealt to shards, and each shard has its own Burrows-Wheeler transform. The transforms are
merged by refining the interleave: it starts with one shard after another, and each round distributes the shards' next
symbols stably, which sorts by one more symbol; the round in which two neighbours part is their common prefix. Rounds end
after ``words`` of them, or when all have parted. Neighbours with a common prefix of ``words`` are the repeated intervals,
and no suffix was compared with one of another shard. Strings that are the only one of their anchor, and hold no window twice, need no transform: all their windows
stand where they do.

In each interval the first place stays (smallest id, then smallest position); the others are reported with it.

Defined results: null and empty texts, texts under ``words`` words and rows without an id have no repeats; rows that
repeat an id with an equal text are one document, with another text they are two; ids that aren't integers rank by a
64-bit hash; a very long text repeats itself like any other; other columns, whatever they are called, are ignored by ``find``
and kept by ``deduplicate``; a text of which all is cut stays as an empty text; an empty table has no repeats.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from screenlake.llm.ids import integral, key_of, named
from screenlake.llm.textcols import blocks, range_hash, ranges, release, slices, sliding_min, word_spans

WORDS, GRAM, SHARDS = 50, 4, 4
#: Bytes of strings that are merged at a time, at the least one anchor's.
CHUNK = 8 << 20
FORM = "anchor long, string long, windows int, inner boolean, body binary, docs array<long>, versions array<long>, places array<int>"
FOUND = "doc_id long, version long, start int, windows int, first_doc long, first_version long, first_start int"


def strings(data: np.ndarray, offsets: np.ndarray, words: int, gram: int = GRAM) -> dict[str, np.ndarray]:
    """The runs of windows of a block that share an anchor, by arrays of one length."""
    start, end, pointer = word_spans(data, offsets)
    n = np.diff(pointer)
    windows = np.maximum(n - words + 1, 0)
    p = ranges(pointer[:-1], windows)
    if not len(p):
        return {}
    w = range_hash(data, start, end)
    i = np.arange(len(w) - gram + 1)
    g = range_hash(w, i, i + gram)
    least = sliding_min(g, words - gram + 1)[p]
    new = np.ones(len(p), bool)
    new[1:] = (p[1:] != p[:-1] + 1) | (least[1:] != least[:-1])
    new[np.searchsorted(p, pointer[:-1][windows > 0])] = True
    at = np.flatnonzero(new)
    count, first = np.diff(np.append(at, len(p))), p[at]
    # The anchor twice in a string: a window may be in it twice.
    inside = count + words - gram
    hits = g[ranges(first, inside)] == np.repeat(least[at], inside)
    twice = np.add.reduceat(hits, np.concatenate(([0], np.cumsum(inside)[:-1])), dtype=np.int64) > 1
    doc = np.searchsorted(pointer, first, "right") - 1
    last = first + count + words - 1
    return {"anchor": least[at], "string": range_hash(w, first, last), "windows": count, "inner": twice, "lo": start[first], "hi": end[last - 1], "doc": doc, "place": first - pointer[doc]}


def _lists(values: np.ndarray, ends: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, kind))


def _cut_strings(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1, write_checksum=False).compress
        for batch in (part for whole in batches for part in slices(whole, 2)):
            ids, versions = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            parts: list[dict[str, np.ndarray]] = []
            raw: list[bytes] = []
            for b in blocks(batch.column(2)):
                got = strings(b.data, b.offsets, words)
                if got:
                    got["doc"] = got["doc"] + b.lo
                    got["block"] = np.full(len(got["doc"]), len(raw))
                    parts.append(got), raw.append(b.data.tobytes())
            if not parts:
                continue
            x = {k: np.concatenate([q[k] for q in parts]) for k in parts[0]}
            order = np.lexsort((x["string"], x["anchor"]))
            a, s = x["anchor"][order], x["string"][order]
            first = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (s[1:] != s[:-1]))))
            one, ends = order[first], np.append(first, len(order))
            body = [pack(raw[k][lo:hi]) for k, lo, hi in zip(x["block"][one].tolist(), x["lo"][one].tolist(), x["hi"][one].tolist())]
            doc = x["doc"][order]
            yield pa.RecordBatch.from_arrays(
                [pa.array(x["anchor"][one].view(np.int64)), pa.array(x["string"][one].view(np.int64)), pa.array(x["windows"][one], pa.int32()), pa.array(x["inner"][one]), pa.array(body, pa.binary()), _lists(ids[doc], ends, pa.int64()), _lists(versions[doc], ends, pa.int64()), _lists(x["place"][order], ends, pa.int32())],
                ["anchor", "string", "windows", "inner", "body", "docs", "versions", "places"],
            )

    return run


def shard_transform(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffix order, Burrows-Wheeler transform) of a circular text, ordered by at least ``depth`` symbols."""
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    order, h = np.argsort(rank, kind="stable"), 1
    while h < depth:
        key = rank * n + rank[(np.arange(n) + h) % n]
        order = np.argsort(key, kind="stable")
        k = key[order]
        new = np.concatenate(([0], np.cumsum(k[1:] != k[:-1])))
        rank = np.empty(n, np.int64)
        rank[order] = new
        if new[-1] == n - 1:
            break
        h *= 2
    return order, text[order - 1]


def merge_transforms(transforms: list[np.ndarray], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(interleave, common prefix with the one before, at most ``depth``) of all suffixes, sorted by ``depth`` symbols.

    ``interleave`` has the shard of each; those of one shard stand in the shard's own order."""
    n = sum(map(len, transforms))
    kind = np.uint16 if max((int(t.max(initial=0)) for t in transforms), default=0) < 1 << 16 else np.int32
    transforms = [t.astype(kind) for t in transforms]
    shard = np.repeat(np.arange(len(transforms), dtype=np.uint8), [len(t) for t in transforms])
    block, common = np.zeros(n, np.int32), np.full(n, depth, np.int32)
    common[:1] = 0
    symbol = np.empty(n, kind)
    for h in range(depth):
        for i, t in enumerate(transforms):
            symbol[shard == i] = t
        order = np.argsort(symbol, kind="stable")
        s, b = symbol[order], block[order]
        shard = shard[order]
        part = (s[1:] != s[:-1]) | (b[1:] != b[:-1])
        common[1:][part & (common[1:] > h)] = h
        if part.all():
            break
        block = np.concatenate(([0], np.cumsum(part, dtype=np.int32))).astype(np.int32)
    return shard, common


def equal_windows(ids: np.ndarray, pointer: np.ndarray, words: int, shards: int = SHARDS) -> tuple[np.ndarray, np.ndarray]:
    """(place in ``ids``, interval) of the windows that stand at several places of the strings, intervals together."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    count = np.bincount(ids)
    rare = count[ids] < 2
    # A word that stands once is in no window that stands twice: strings end there.
    stop = np.zeros(len(ids) + 1, bool)
    stop[pointer] = True
    cut = np.flatnonzero(stop[:-1] | rare)
    begin = np.unique(np.concatenate((cut[~rare[cut]], np.flatnonzero(rare) + 1)))
    begin = begin[begin < len(ids)]
    bound = np.append(np.unique(np.concatenate((np.flatnonzero(stop), np.flatnonzero(rare)))), len(ids))
    end = bound[np.searchsorted(bound, begin, "right")] if len(begin) else begin
    keep = (end - begin >= words) & ~rare[begin]
    begin, size = begin[keep], (end - begin)[keep]
    if not len(begin):
        return none
    names, code = np.unique(ids[ranges(begin, size)], return_inverse=True)
    lo = np.concatenate(([0], np.cumsum(size)))
    orders, transforms, places, left = [], [], [], []
    for i in range(min(shards, len(begin))):
        mine = np.arange(i, len(begin), shards)
        n = size[mine] + 1
        text = np.zeros(int(n.sum()), np.int64)
        to = ranges(np.concatenate(([0], np.cumsum(n)[:-1])), size[mine])
        text[to] = code[ranges(lo[mine], size[mine])] + 1
        place, rest = np.full(len(text), -1), np.zeros(len(text), np.int64)
        place[to] = ranges(begin[mine], size[mine])
        rest[to] = np.repeat(end[keep][mine], size[mine]) - place[to]
        order, transform = shard_transform(text, words)
        orders.append(order), transforms.append(transform), places.append(place[order]), left.append(rest[order])
    shard, common = merge_transforms(transforms, words)
    block = np.cumsum(common < words)
    place, rest = np.empty(len(shard), np.int64), np.empty(len(shard), np.int64)
    for i in range(len(orders)):
        place[shard == i], rest[shard == i] = places[i], left[i]
    whole = rest >= words
    place, block = place[whole], block[whole]
    several = np.bincount(block)[block] > 1
    return place[several], block[several]


def _repeated(table: pa.Table, words: int, shards: int) -> Iterator[pa.RecordBatch]:
    """Runs of repeated windows among the strings of whole anchors, sorted by anchor and string."""
    anchor, string, windows, inner = (table.column(i).to_numpy() for i in range(4))
    new = np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (string[1:] != string[:-1])))
    one = np.flatnonzero(new)
    lists = [table.column(i).combine_chunks() for i in (5, 6, 7)]
    ends = np.append(lists[0].offsets.to_numpy()[one] - lists[0].offsets[0].as_py(), len(lists[0].flatten()))
    doc, version, place = (x.flatten().to_numpy() for x in lists)
    times = np.diff(ends)
    alone = np.bincount(np.unique(anchor[one], return_inverse=True)[1])
    many = np.repeat(alone, alone)  # strings of the anchor
    inner = np.logical_or.reduceat(inner, one)
    hard = (many > 1) | inner
    keep = hard | (times > 1)
    if not keep.any():
        return
    one, windows, times, hard = one[keep], windows[one][keep].astype(np.int64), times[keep], hard[keep]
    at = ranges(ends[:-1][keep], times)
    doc, version, place = doc[at], version[at], place[at].astype(np.int64)
    owner = np.repeat(np.arange(len(one)), times)
    # The documents by rank, so that a place in the corpus is one number.
    order = np.lexsort((version, doc))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (doc[order][1:] != doc[order][:-1]) | (version[order][1:] != version[order][:-1])
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(fresh) - 1
    names = doc[order[fresh]], version[order[fresh]]
    spot = (rank << 32) | place
    order = np.lexsort((spot, owner))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (owner[order][1:] != owner[order][:-1]) | (spot[order][1:] != spot[order][:-1])
    order = order[fresh]  # rows of equal id and text are one document
    doc, version, spot, times = doc[order], version[order], spot[order], np.bincount(owner[order], minlength=len(one))
    least = np.minimum.reduceat(spot, np.concatenate(([0], np.cumsum(times)[:-1])))
    # For each window of each distinct string its first place: that of the string, or of an equal window elsewhere.
    base = np.concatenate(([0], np.cumsum(windows)))
    first = np.repeat(least, windows) + ranges(np.zeros(len(windows), np.int64), windows)
    if hard.any():
        which = np.flatnonzero(hard)
        bodies = table.column(4).combine_chunks().take(pa.array(one[which])).to_pylist()
        unpack = zstandard.ZstdDecompressor().decompress
        bodies = [unpack(b) for b in bodies]
        raw = np.frombuffer(b"".join(bodies), np.uint8)
        offsets = np.concatenate(([0], np.cumsum([len(b) for b in bodies])))
        start, end, pointer = word_spans(raw, offsets)
        ids = np.unique(range_hash(raw, start, end), return_inverse=True)[1]
        spots, interval = equal_windows(ids, pointer, words, shards)
        if len(spots):
            mine = np.searchsorted(pointer, spots, "right") - 1
            flat = base[which[mine]] + spots - pointer[mine]
            edges = np.flatnonzero(np.concatenate(([True], interval[1:] != interval[:-1])))
            best = np.minimum.reduceat(first[flat], edges)
            first[flat] = np.repeat(best, np.diff(np.append(edges, len(flat))))
    # Runs of windows whose first places follow one another, then one row for each place of the string.
    cut = np.ones(len(first), bool)
    cut[1:] = first[1:] != first[:-1] + 1
    cut[base[:-1]] = True
    run = np.flatnonzero(cut)
    length = np.diff(np.append(run, len(first)))
    of = np.searchsorted(base, run, "right") - 1
    back = np.concatenate(([0], np.cumsum(times)))
    occ = ranges(back[of], times[of])
    r = np.repeat(np.arange(len(run)), times[of])
    there = spot[occ] + (run - base[of])[r]
    moved = there != first[run][r]
    occ, r, there = occ[moved], r[moved], there[moved]
    if not len(r):
        return
    origin = first[run][r]
    source = origin >> 32
    yield pa.RecordBatch.from_arrays(
        [pa.array(doc[occ]), pa.array(version[occ]), pa.array(there & 0xFFFFFFFF, pa.int32()), pa.array(length[r], pa.int32()), pa.array(names[0][source]), pa.array(names[1][source]), pa.array(origin & 0xFFFFFFFF, pa.int32())],
        ["doc_id", "version", "start", "windows", "first_doc", "first_version", "first_start"],
    )


def _merge(words: int, shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if held and size >= CHUNK:
                key, end = batch.column(0).to_numpy(), held[-1].column(0)[-1].as_py()
                cut = int(np.argmax(key != end)) if (key != end).any() else batch.num_rows
                held.append(batch.slice(0, cut))
                if cut < batch.num_rows:
                    yield from _repeated(pa.Table.from_batches(held), words, shards)
                    held, size = [], 0
                    release()
                batch = batch.slice(cut)
            if batch.num_rows:
                held.append(batch)
                size += batch.nbytes
        if held:
            yield from _repeated(pa.Table.from_batches(held), words, shards)
        release()

    return run


def _runs(docs: DataFrame, words: int, shards: int) -> DataFrame:
    """(doc_id, version, start, n_words, first_doc, first_start): the longest runs of windows with one first place each."""
    if words < GRAM:
        raise ValueError(f"a repeat has at least {GRAM} words")
    rows = docs.select(key_of(docs, "doc_id").alias("doc_id"), F.xxhash64("text").alias("version"), named("text").alias("text")).where("doc_id IS NOT NULL AND text IS NOT NULL")
    cut = rows.mapInArrow(_cut_strings(words), FORM)
    met = cut.repartition("anchor").sortWithinPartitions("anchor", "string").mapInArrow(_merge(words, shards), FOUND)
    one = ["doc_id", "version", "first_doc", "first_version", "shift"]
    w = Window.partitionBy(*one).orderBy("start")
    met = met.withColumn("shift", F.col("first_start") - F.col("start"))
    met = met.withColumn("new", F.when(F.lag(F.col("start") + F.col("windows")).over(w) == F.col("start"), 0).otherwise(1))
    met = met.withColumn("island", F.sum("new").over(w))
    return met.groupBy(*one, "island").agg(F.min("start").alias("start"), (F.sum("windows") + (words - 1)).cast("int").alias("n_words"), F.min("first_start").alias("first_start"))


def find(docs: DataFrame, *, words: int = WORDS, shards: int = SHARDS) -> DataFrame:
    """(doc_id, start, n_words, first_doc, first_start): every passage that stands at ``first_start`` of ``first_doc`` before."""
    got = _runs(docs, words, shards).select("doc_id", "start", "n_words", "first_doc", "first_start")
    if integral(docs, "doc_id"):
        return got
    names = docs.where("doc_id IS NOT NULL").select(key_of(docs, "doc_id").alias("key"), named("doc_id").alias("name")).dropDuplicates(["key"])
    for c in ("doc_id", "first_doc"):
        got = got.join(names.withColumnRenamed("key", c), c).drop(c).withColumnRenamed("name", c)
    return got.select("doc_id", "start", "n_words", "first_doc", "first_start")


def without(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """A text without the words of the spans (first word, number of words) and the white space after each of them."""
    raw = np.frombuffer(text, np.uint8)
    start, _, _ = word_spans(raw, np.array([0, len(raw)]))
    gone = np.zeros(len(start) + 1, np.int64)
    for a, n in spans:
        gone[a] += 1
        gone[min(a + n, len(start))] -= 1
    gone = np.cumsum(gone)[:-1] > 0
    edge = np.flatnonzero(np.diff(np.concatenate(([False], gone, [False])).astype(np.int8)))
    byte = np.append(start, len(raw))
    out, at = [], 0
    for a, b in edge.reshape(-1, 2):
        out.append(text[at : byte[a]])
        at = byte[b]
    return b"".join([*out, text[at:]])


def deduplicate(docs: DataFrame, *, words: int = WORDS, shards: int = SHARDS) -> DataFrame:
    """``docs`` with every repeat but its first place cut from ``text`` (and ``n_chars``, if there, counted anew)."""
    spans = _runs(docs, words, shards).groupBy("doc_id", "version").agg(F.collect_list(F.struct("start", "n_words")).alias("__spans"))
    spans = spans.select(F.col("doc_id").alias("__doc"), F.col("version").alias("__version"), "__spans")
    names = [f"__{i}" for i in range(len(docs.columns))]  # whatever the columns are called
    where, key = docs.columns.index("text"), docs.columns.index("doc_id")
    rows = docs.select(*(named(c).alias(n) for c, n in zip(docs.columns, names)))
    both = rows.join(spans, (key_of(rows, names[key]) == F.col("__doc")) & (F.xxhash64(names[where]) == F.col("__version")), "left").select(*names, "__spans")
    size = docs.columns.index("n_chars") if "n_chars" in docs.columns else -1

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for whole in batches for part in slices(whole, where)):
            spans, cols = b.column(b.num_columns - 1), list(b.columns[:-1])
            hit = np.flatnonzero(spans.is_valid().to_numpy(zero_copy_only=False))
            if len(hit):
                text = cols[where].to_pylist()
                n = cols[size].to_pylist() if size >= 0 else []
                for i in hit.tolist():
                    own = spans[i].values
                    text[i] = without(text[i].encode(), list(zip(own.field(0).to_pylist(), own.field(1).to_pylist()))).decode()
                    if size >= 0:
                        n[i] = len(text[i])
                cols[where] = pa.array(text, cols[where].type)
                if size >= 0:
                    cols[size] = pa.array(n, cols[size].type)
            yield pa.RecordBatch.from_arrays(cols, schema=pa.schema(list(b.schema)[:-1]))

    done = both.mapInArrow(cut, both.drop("__spans").schema)
    return done.select(*(F.col(n).alias(c) for c, n in zip(docs.columns, names)))


ORACLE_SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(text, '[^ \t\n\v\f\r]+') AS w FROM documents WHERE doc_id IS NOT NULL),
p AS (SELECT doc_id, w, unnest(range(0, len(w) - {WORDS - 1})) AS start FROM d WHERE len(w) >= {WORDS}),
h AS (SELECT doc_id, start, array_to_string(w[start + 1 : start + {WORDS}], ' ') AS passage FROM p),
f AS (SELECT doc_id, start, min(doc_id::HUGEINT * 4294967296 + start) OVER (PARTITION BY passage) AS first FROM h),
r AS (SELECT doc_id, start, (first // 4294967296)::BIGINT AS first_doc, (first % 4294967296)::BIGINT AS first_start FROM f WHERE first <> doc_id::HUGEINT * 4294967296 + start),
g AS (SELECT *, start - row_number() OVER (PARTITION BY doc_id, first_doc, first_start - start ORDER BY start) AS island FROM r)
SELECT doc_id, min(start)::INTEGER AS start, (count(*) + {WORDS - 1})::INTEGER AS n_words, first_doc, min(first_start)::INTEGER AS first_start
FROM g GROUP BY doc_id, first_doc, first_start - start, island
"""
