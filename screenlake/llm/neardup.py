"""MinHash near-dedup by a containment ensemble.

A document is the set of its shingles (``SHINGLE`` words in ASCII lower case; one shingle of all words if it has fewer).
A document A is a near copy of B if B ranks before it (more shingles, or as many and a smaller id) and holds at least
``threshold`` of its shingles, however much larger B is.

Documents of equal sets are one class; only its first document, the one that ranks first, goes on. Classes are partitioned
by size, four partitions to each doubling. For each pair of partitions less than ``GAPS`` apart the containment threshold
becomes a Jaccard threshold at the largest ratio of sizes that the pair allows, and banding is tuned apart for each: the
most rows a band for which bands that find a pair at that threshold with probability ``recall`` need no more than
``hashes`` minima. Band values are shuffled with no more than the class; only where a value is shared the sketches (4
bits of each of ``SKETCH`` minima) come to it. Pairs that share a value are let through if their sketches are as equal as
a pair at the threshold for their sizes would be, less ``sketch_z`` standard deviations.

From ``GAPS`` on, Jaccard thresholds sink so low that bands would outnumber shingles. There the smaller document asks
with its shingles, those with the ``ASKS`` smallest hashes if it has more, and every shingle of the larger ones answers. A document that holds
``threshold`` of another has at least ``needed`` of what it asks (always, if it asks with all; else with probability
``recall``), so it has ``m`` of any ``k - needed + m`` of the ``k`` that meet a larger document: the rarest of them make
candidates, and documents of which fewer than ``needed`` meet one have none. Shingles are shuffled in buckets of packed,
sorted hashes, as many buckets as the corpus asks for.

Candidates are checked exactly on the texts, in two rounds, so that a group of n copies costs about n checks and not
n * n: first each class against the one most like it among those that rank highest in its band values, and against the
largest that meets most of what it asks; those that no such check settles are then checked against every candidate. The
smaller text travels to the larger one, which travels once. No candidate is capped, sampled or left out for its ratio.

Defined results: documents without words (null, empty) are never copies; a row without an id is a document that ranks
after those of its size that have one; rows that repeat id and text are one document, with another text they are two;
ids that aren't integers rank by a 64-bit hash; very long texts are one set like any other; ties in size go by id;
other columns, whatever they are called, are ignored by ``copies`` and kept by ``deduplicate``; an empty table has no
copies.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from screenlake.llm.ids import key_of, named
from screenlake.llm.storage import Scratch, staged
from screenlake.llm.textcols import LOWER, blocks, list_array, mix, range_hash, ranges, release, slices, word_spans

SHINGLE = 3
SKETCH = 256
PARTS = 4
#: Partitions so far apart are compared by containment.
GAPS = 4
ASKS = 64
#: Of the asked shingles that candidates must hold, how many are looked for at the least.
HELD = 3
#: Shingles of a bucket, and of what a task packs at once.
BUCKET, CHUNK = 1 << 19, 1 << 20
#: Of 2 ** SPARE random shingles one is taken for another, whatever the size of the corpus; checks are exact.
SPARE = 13
#: Smaller texts that go to one copy of a larger one.
GUESTS = 4096
_SEEDS = np.random.default_rng(20240607).integers(1, 1 << 63, SKETCH, dtype=np.uint64) | np.uint64(1)
_LOW4 = np.uint64(0x1111111111111111)
#: Bytes of a sketch.
WIDE = SKETCH // 2


@dataclass(frozen=True)
class Ensemble:
    """Thresholds and banding by the distance of two size partitions."""

    threshold: float = 0.7
    recall: float = 0.96
    sketch_z: float = 3.0
    hashes: int = 72

    def jaccard(self, ratio: np.ndarray | float) -> np.ndarray | float:
        """The Jaccard index at the threshold, of sets of which one is ``ratio`` times the other."""
        return self.threshold / (1 + ratio - self.threshold)

    def bands(self, gap: int) -> tuple[int, int]:
        """(bands, rows of each) of partitions that are ``gap`` apart, for the largest ratio of sizes in them."""
        j = self.jaccard(2.0 ** ((gap + 1) / PARTS))
        best = (0, 0)
        for rows in range(1, 9):
            n = max(1, math.ceil(math.log(1 - self.recall) / math.log(1 - j**rows) - 1e-9))
            if rows == 1 or n * rows <= self.hashes:
                best = n, rows
        return best

    def tuned(self) -> np.ndarray:
        """(first, last + 1) of the bands that count, by gap: bands of as many rows are shared by all gaps."""
        want = [self.bands(g) for g in range(GAPS)]
        first, at = {}, 0
        for rows in sorted({r for _, r in want}):
            first[rows] = at
            at += max(n for n, r in want if r == rows)
        return np.array([(first[r], first[r] + n) for n, r in want])

    def layout(self) -> list[int]:
        """Rows of each band."""
        want, last = [self.bands(g) for g in range(GAPS)], self.tuned()
        out = [1] * int(last[:, 1].max())
        for (n, r), (lo, hi) in zip(want, last):
            out[lo:hi] = [r] * n
        return out

    def needed(self) -> list[int]:
        """How many of its asked shingles are shared at the least, of a document of 0 to ``ASKS`` shingles or, last, more."""
        tail = [sum(math.comb(ASKS, j) * self.threshold**j * (1 - self.threshold) ** (ASKS - j) for j in range(t, ASKS + 1)) for t in range(ASKS + 1)]
        return [max(1, math.ceil(self.threshold * n - 1e-9)) for n in range(ASKS + 1)] + [max(1, max(t for t, p in enumerate(tail) if p >= self.recall))]

    def least_equal(self, ratio: np.ndarray) -> np.ndarray:
        """How many sketch values of a pair are equal at the least."""
        p = self.jaccard(ratio)
        p = p + (1 - p) / 16
        return np.floor(SKETCH * p - self.sketch_z * np.sqrt(SKETCH * p * (1 - p)))


def partition(size: np.ndarray) -> np.ndarray:
    return np.floor(PARTS * np.log2(size)).astype(np.int64)


def shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, pointer): the distinct shingles of each text, sorted."""
    start, end, pointer = word_spans(data, offsets)
    w = range_hash(LOWER[data], start, end)
    n = np.diff(pointer)
    count = np.where(n >= SHINGLE, n - SHINGLE + 1, np.minimum(n, 1))
    first = ranges(pointer[:-1], count)
    last = np.minimum(first + SHINGLE, np.repeat(pointer[1:], count))
    h = range_hash(w, first, last)
    doc = np.repeat(np.arange(len(n)), count)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc = h[new], doc[new]
    return h, np.searchsorted(doc, np.arange(len(n) + 1))


def _set_hash(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each set, whatever its order."""
    return np.add.reduceat(mix(h), at).view(np.int64)


def _signatures(layout: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds = _SEEDS.astype(np.uint32) | np.uint32(1)
        k = len(layout)
        for batch in (part for whole in batches for part in slices(whole, 3)):
            for b in blocks(batch.column(3)):
                h, pointer = shingles(b.data, b.offsets)
                size = np.diff(pointer)
                full = np.flatnonzero(size)
                if not len(full):
                    continue
                at = pointer[:-1][full]
                keys = np.empty((len(full), k), np.uint64)
                j = 0
                for band, rows in enumerate(layout):
                    value = np.full(len(full), band + 1, np.uint64)
                    for _ in range(rows):
                        value = mix(value + np.minimum.reduceat((h ^ (_SEEDS[j] >> np.uint64(3))) * _SEEDS[j], at))
                        j += 1
                    keys[:, band] = value
                # The sketch has minima of 32 bits: half the work, and equal by chance in none of 2**20 sets.
                short = (mix(h ^ np.uint64(0x2545F4914F6CDD1D)) >> np.uint64(32)).astype(np.uint32)
                sketch = np.zeros((len(full), WIDE), np.uint8)
                for j in range(SKETCH):
                    least = np.minimum.reduceat((short ^ seeds[(j + 1) % SKETCH]) * seeds[j], at)
                    sketch[:, j // 2] |= (((least * np.uint32(0x9E3779B1)) >> np.uint32(28)) << np.uint32(4 * (j % 2))).astype(np.uint8)
                take = pa.array(full + b.lo)
                rows = pa.FixedSizeBinaryArray.from_buffers(pa.binary(WIDE), len(full), [None, pa.py_buffer(sketch)]).cast(pa.binary())
                two = np.add.reduceat(mix(h ^ np.uint64(0x5BF03635D1FE2A4B)), at).view(np.int64)
                cols = [*(batch.column(i).take(take) for i in range(3)), pa.array(size[full], pa.int32()), pa.array(_set_hash(h, at)), pa.array(two), rows, list_array(pa.array(keys.ravel().view(np.int64)), np.arange(0, keys.size + 1, k))]
                yield pa.RecordBatch.from_arrays(cols, schema=pa.schema([*(batch.schema.field(i) for i in range(3)), ("size", pa.int32()), ("doc", pa.int64()), ("two", pa.int64()), ("sketch", pa.binary()), ("keys", pa.list_(pa.int64()))]))

    return run


def runs(batches: Iterator[pa.RecordBatch], column: int = 0) -> Iterator[pa.Table]:
    """Tables of whole runs of equal values in ``column``, from batches sorted by it."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(column).to_numpy()
        cut = int(np.searchsorted(key, key[-1])) if key[0] <= key[-1] else 0
        if cut == 0 and held and held[-1].column(column)[-1].as_py() != key[0]:
            yield pa.Table.from_batches(held)
            held = []
        if cut:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows whose band value another row has too."""
    for t in runs(batches):
        key = t.column(0).to_numpy()
        same = key[1:] == key[:-1]
        keep = np.zeros(len(key), bool)
        keep[1:] |= same
        keep[:-1] |= same
        yield from t.filter(pa.array(keep)).combine_chunks().to_batches()


def equal_values(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many 4-bit values of sketches (rows of 64-bit words) are equal."""
    out = np.zeros(len(a), np.int64)
    for i in range(a.shape[1]):
        x = a[:, i] ^ b[:, i]
        x |= x >> np.uint64(1)
        x |= x >> np.uint64(2)
        out += 16 - np.bitwise_count(x & _LOW4).astype(np.int64)
    return out


def _pairs(ensemble: Ensemble, every: bool):
    """(a, b, equal) in each run of equal band values, ordered by rank: b the highest-ranked that may hold a, or every such."""
    bands = ensemble.tuned()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches):
            key, band, ids, size = (t.column(i).to_numpy() for i in range(4))
            sketch = np.frombuffer(b"".join(t.column(4).to_pylist()), np.uint64).reshape(len(key), -1)
            part = partition(size)
            new = np.concatenate(([True], key[1:] != key[:-1]))
            first = np.flatnonzero(new)[np.cumsum(new) - 1]
            active = np.flatnonzero(t.column(5).to_numpy(zero_copy_only=False)) if every else np.arange(len(key))
            # Sizes fall within a run: the first that isn't too large.
            order = first * (1 << 32) - size.astype(np.int64)
            step = np.searchsorted(order, first[active] * (1 << 32) - np.floor(2 ** (GAPS / PARTS) * size[active]).astype(np.int64))
            held: list[tuple[np.ndarray, ...]] = []
            n = 0
            while True:
                on = step < active
                active, step = active[on], step[on]
                if not len(active):
                    break
                b = step
                gap = part[b] - part[active]
                own = bands[np.minimum(gap, GAPS - 1)]
                fine = (gap < GAPS) & (band[active] >= own[:, 0]) & (band[active] < own[:, 1])
                c = np.flatnonzero(fine)
                equal = equal_values(sketch[active[c]], sketch[b[c]])
                passed = equal >= ensemble.least_equal(size[b[c]] / size[active[c]])
                c, equal = c[passed], equal[passed]
                held.append((ids[active[c]], ids[b[c]], equal))
                n += len(c)
                if not every:
                    keep = np.ones(len(active), bool)
                    keep[c] = False
                    active, step = active[keep], step[keep]
                step = step + 1
                if n > 1 << 19:
                    yield _table(held)
                    held, n = [], 0
            if n:
                yield _table(held)
            release()

    return run


def _table(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    a, b, equal = (np.concatenate([x[i] for x in held]) for i in range(3))
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(equal, pa.int32())], ["a", "b", "equal"])


def _planes(x: np.ndarray, width: int) -> bytes:
    """The low ``width`` bytes of unsigned values, byte by byte, so that small values pack well."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T[:width]).tobytes()


def _values(raw: bytes, at: int, n: int, width: int) -> tuple[np.ndarray, int]:
    out = np.zeros((8, n), np.uint8)
    out[:width] = np.frombuffer(raw, np.uint8, n * width, at).reshape(width, n)
    return np.ascontiguousarray(out.T).reshape(-1).view("<u8"), at + n * width


def _spread(bits: int, wide: int):
    """(bucket, body): shingles by the first ``bits`` of their ``wide``-bit keys, with their documents, and whether they ask."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1, write_checksum=False).compress

        def packed(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
            key, asks, ids, size = (np.concatenate(x) for x in zip(*held))
            row = np.repeat(np.arange(len(ids)), size)
            order = np.argsort(key, kind="stable")
            key, asks, row = key[order], asks[order], row[order]
            cut = np.searchsorted(key >> np.uint64(wide - bits), np.arange((1 << bits) + 1, dtype=np.uint64))
            full = np.flatnonzero(np.diff(cut))
            rows = []
            for lo, hi in zip(cut[full], cut[full + 1]):
                index, place = np.unique(row[lo:hi], return_inverse=True)
                n = np.array([hi - lo, len(index)])
                rows.append(pack(n.tobytes() + _planes(np.diff(key[lo:hi], prepend=np.uint64(0)), 8) + _planes(place, 4) + _planes(np.diff(ids[index], prepend=0).view(np.uint64), 8) + _planes(size[index], 4) + np.packbits(asks[lo:hi]).tobytes()))
            return pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array(rows, pa.binary())], ["bucket", "body"])

        held: list[tuple[np.ndarray, ...]] = []
        n = 0
        for batch in (part for whole in batches for part in slices(whole, 0)):
            for b in blocks(batch.column(0)):
                h, pointer = shingles(b.data, b.offsets)
                size = np.diff(pointer)
                full = size > 0
                ids = np.zeros(len(size), np.int64)
                if full.any():
                    ids[full] = _set_hash(h, pointer[:-1][full])
                held.append((mix(h ^ np.uint64(0x1B873593CC9E2D51)) >> np.uint64(64 - wide), np.arange(len(h)) - np.repeat(pointer[:-1], size) < ASKS, ids, size))
                n += len(h)
                if n > CHUNK:
                    yield packed(held)
                    held, n = [], 0
                    release()
        if n:
            yield packed(held)

    return run


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, doc, size, part, larger, top, holds): shingles that ask and meet ``larger`` far larger classes, ``top`` one of the
    largest, and with ``holds`` those that they meet. A class counts once, however many documents it has."""
    unpack = zstandard.ZstdDecompressor().decompress
    for t in runs(batches):
        bucket = t.column(0).to_numpy()
        bodies = t.column(1).combine_chunks()
        edge = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1], [True])))
        for lo, hi in zip(edge[:-1], edge[1:]):
            held = []
            for i in range(lo, hi):
                raw = unpack(bodies[i].as_py())
                n, docs = (int(x) for x in np.frombuffer(raw, np.int64, 2))
                key, at = _values(raw, 16, n, 8)
                place, at = _values(raw, at, n, 4)
                ids, at = _values(raw, at, docs, 8)
                size, at = _values(raw, at, docs, 4)
                place = place.astype(np.int64)
                held.append((np.cumsum(key), np.cumsum(ids.view(np.int64))[place], size.astype(np.int32)[place], np.unpackbits(np.frombuffer(raw, np.uint8, offset=at), count=n).astype(bool)))
            key, ids, size, asks = (np.concatenate(x) for x in zip(*held))
            order = np.argsort(key, kind="stable")  # of sorted runs
            same = key[order[1:]] == key[order[:-1]]
            several = np.zeros(len(key), bool)
            several[1:] |= same
            several[:-1] |= same
            order = order[several]
            key, ids, size, asks = key[order], ids[order], size[order], asks[order]
            # By key, then from the largest partition down.
            part = partition(size)
            low = (key << np.uint64(8)) | (255 - part).astype(np.uint64)
            order = np.lexsort((ids, low))
            new = np.ones(len(order), bool)
            new[1:] = (low[order[1:]] != low[order[:-1]]) | (ids[order[1:]] != ids[order[:-1]])
            order = order[new]
            low, key, ids, size, asks, part = low[order], key[order], ids[order], size[order], asks[order], part[order]
            q = np.flatnonzero(asks)
            first = np.searchsorted(key, key[q])
            larger = np.searchsorted(low, (key[q] << np.uint64(8)) | (255 - part[q] - GAPS).astype(np.uint64), "right") - first
            q, first, larger = q[larger > 0], first[larger > 0], larger[larger > 0]
            cover = np.zeros(len(key) + 1, np.int64)
            np.add.at(cover, first, 1)
            np.add.at(cover, first + larger, -1)
            holds = np.cumsum(cover)[:-1] > 0
            met, top = np.zeros(len(key), np.int64), np.zeros(len(key), np.int64)
            met[q], top[q] = larger, ids[first]
            keep = np.flatnonzero(holds | (met > 0))
            for at in range(0, len(keep), 1 << 18):
                k = keep[at : at + (1 << 18)]
                cols = [pa.array(key[k].astype(np.int64)), pa.array(ids[k]), pa.array(size[k]), pa.array(part[k], pa.int32()), pa.array(met[k], pa.int32()), pa.array(top[k]), pa.array(holds[k])]
                yield pa.RecordBatch.from_arrays(cols, ["key", "doc", "size", "part", "larger", "top", "holds"])
            release()


def _alive(ensemble: Ensemble):
    """Rows (a, size, larger, key, top) by a, rarest first, to (a, part, key, held, top, n): of those of which enough meet larger
    classes, the rarest, of which ``held`` must be shared; ``top`` is the class that answers most, ``n`` times."""
    need = np.array(ensemble.needed())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches):
            a, size, key, top = (t.column(i).to_numpy() for i in (0, 1, 3, 4))
            edge = np.flatnonzero(np.concatenate(([True], a[1:] != a[:-1], [True])))
            n = np.diff(edge)
            least = need[np.minimum(size[edge[:-1]], ASKS + 1)]
            on = np.flatnonzero(n >= least)
            if not len(on):
                continue
            held = np.minimum(HELD, least[on])
            take = np.minimum(n[on] - least[on] + held, n[on])
            rows = ranges(edge[on], take)
            every = ranges(edge[on], n[on])
            of = np.repeat(np.arange(len(on)), n[on])
            order = np.lexsort((top[every], of))
            of, tops = of[order], top[every][order]
            run_ = np.flatnonzero(np.concatenate(([True], (of[1:] != of[:-1]) | (tops[1:] != tops[:-1]))))
            times = np.diff(np.append(run_, len(of)))
            best = np.lexsort((times, of[run_]))  # the last of each has most
            last = np.flatnonzero(np.append(of[run_][best][1:] != of[run_][best][:-1], True))
            who, many = tops[run_][best][last], times[best][last]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (a[rows], partition(size[rows]).astype(np.int32), key[rows], np.repeat(held, take).astype(np.int32), np.repeat(who, take), np.repeat(many, take))], ["a", "part", "key", "held", "top", "n"])

    return run


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pack = zstandard.ZstdCompressor(level=1, write_checksum=False).compress
    for batch in (part for whole in batches for part in slices(whole, 1)):
        body = [None if x is None else pack(x) for x in batch.column(1).cast(pa.binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(body, pa.binary())], ["row", "body"])


def _contained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, containment, size_a, size_b) from rows (b, salt, a, body) by b and salt, its own text (a is null) before those of its guests."""
    unpack = zstandard.ZstdDecompressor().decompress
    host, held = None, np.zeros(0, np.uint64)
    for batch in batches:
        for p in slices(batch, 3, 1 << 20):
            to, salt, guest = p.column(0).to_numpy(), p.column(1).to_numpy(), p.column(2)
            own = guest.is_null().to_numpy(zero_copy_only=False)
            guest = guest.fill_null(0).to_numpy()
            row = 0
            out: list[tuple] = []
            for x in blocks(pa.array([unpack(b) for b in p.column(3).to_pylist()], pa.binary()).cast(pa.string())):
                h, pointer = shingles(x.data, x.offsets)
                for i in range(len(pointer) - 1):
                    mine = h[pointer[i] : pointer[i + 1]]
                    if own[row]:
                        host, held = (to[row], salt[row]), mine
                    elif host == (to[row], salt[row]) and len(mine) and len(held):
                        at = np.minimum(np.searchsorted(held, mine), len(held) - 1)
                        out.append((guest[row], to[row], np.count_nonzero(held[at] == mine) / len(mine), len(mine), len(held)))
                    row += 1
            cols = list(zip(*out)) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32()))], ["a", "b", "containment", "size_a", "size_b"])


@dataclass
class Classes:
    """``members``: (name, rank, row, doc, two, size) of the rows with words; ``firsts``: (doc, two, size, rank, row, name, sketch, keys) of
    the classes; ``links``: (doc, copy_of, containment) between classes, one for each that is a copy."""

    members: DataFrame
    firsts: DataFrame
    links: DataFrame


def _rows(docs: DataFrame) -> DataFrame:
    """(name, rank, row, text): the id as it is, its place among ids, the 64-bit key of id and text."""
    rank = F.coalesce(key_of(docs, "doc_id"), F.lit((1 << 63) - 1))
    return docs.select(named("doc_id").alias("name"), rank.alias("rank"), F.xxhash64(rank, F.col("text")).alias("row"), F.col("text").alias("text"))


def _classes(docs: DataFrame, ensemble: Ensemble, lasting: Scratch) -> Classes:
    """What the result reads goes with ``lasting``, all else at once."""
    scratch = Scratch(docs.sparkSession)
    rows = _rows(docs).where("text IS NOT NULL")
    kind = rows.schema["name"].dataType.simpleString()
    form = f"name {kind}, rank long, row long, size int, doc long, two long, sketch binary, keys array<long>"
    members = lasting.staged(rows.mapInArrow(_signatures(ensemble.layout()), form), "signatures")
    best = F.min(F.struct("rank", "row", "name")).alias("m")
    firsts = members.groupBy("doc", "two", "size").agg(best, F.first("sketch").alias("sketch"), F.first("keys").alias("keys"))
    firsts = lasting.staged(firsts.select("doc", "two", "size", "m.rank", "m.row", "m.name", "sketch", "keys"), "classes")

    found = firsts.select(F.posexplode("keys").alias("band", "key"), "doc", "size", "rank").select("key", F.col("band").cast("int").alias("band"), "doc", "size", "rank")
    met = scratch.staged(found.repartition("key").sortWithinPartitions("key").mapInArrow(_shared, "key long, band int, doc long, size int, rank long"), "bands")
    sketched = firsts.select("doc", "size", "sketch")

    def near(some: DataFrame, every: bool) -> DataFrame:
        """Candidate pairs. ``some`` has ``open``: whether a row's class is still to be settled."""
        full = some.join(sketched, ["doc", "size"]).select("key", "band", "doc", "size", "sketch", "open", "rank")
        return full.repartition("key").sortWithinPartitions("key", F.desc("size"), "rank", "doc").mapInArrow(_pairs(ensemble, every), "a long, b long, equal int")

    packed = rows.select("row", "text").mapInArrow(_packed, "row long, body binary")

    def checked(pairs: DataFrame) -> DataFrame:
        """(doc, copy_of, containment, size_b) of those pairs (a, b) of which b holds a and ranks before it; for each a the best."""
        pairs = scratch.staged(pairs.select("a", "b").distinct(), "pairs")
        salts = pairs.groupBy("b").agg(F.ceil(F.count("*") / GUESTS).cast("int").alias("salts"))
        guests = pairs.join(salts, "b").select(F.col("a").alias("doc"), "b", F.pmod(F.xxhash64("a"), F.col("salts")).cast("int").alias("salt"), "a")
        hosts = salts.select(F.col("b").alias("doc"), "b", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(None).cast("long").alias("a"))
        asked = guests.unionByName(hosts).join(firsts.select("doc", "row"), "doc")
        texts = packed.groupBy("row").agg(F.first("body").alias("body"))  # rows that repeat are one
        both = asked.join(texts, "row").select("b", "salt", "a", "body").repartition("b", "salt").sortWithinPartitions("b", "salt", "a")
        done = both.mapInArrow(_contained, "a long, b long, containment double, size_a int, size_b int").where(F.col("containment") >= ensemble.threshold)
        rank = firsts.select("doc", "rank")
        done = done.join(rank.select(F.col("doc").alias("a"), F.col("rank").alias("rank_a")), "a").join(rank.select(F.col("doc").alias("b"), F.col("rank").alias("rank_b")), "b")
        before = (F.col("size_b") > F.col("size_a")) | ((F.col("size_b") == F.col("size_a")) & ((F.col("rank_b") < F.col("rank_a")) | ((F.col("rank_b") == F.col("rank_a")) & (F.col("b") < F.col("a")))))
        best = F.max(F.struct("containment", (-F.col("rank_b")).alias("minus"), "b")).alias("m")
        return done.where(before).groupBy("a").agg(best).select(F.col("a").alias("doc"), F.col("m.b").alias("copy_of"), F.col("m.containment").alias("containment"))

    total = firsts.agg(F.sum("size")).first()[0] or 1
    bits = min(30, max(4, math.ceil(math.log2(total / BUCKET))))
    spread = rows.select("text").mapInArrow(_spread(bits, min(56, max(bits, math.ceil(math.log2(total))) + SPARE)), "bucket int, body binary")
    far = scratch.staged(spread.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_met, "key long, doc long, size int, part int, larger int, top long, holds boolean"), "met")
    asks = far.where("larger > 0").select(F.col("doc").alias("a"), "size", "larger", "key", "top").repartition("a").sortWithinPartitions("a", "larger", "key")
    asks = scratch.staged(asks.mapInArrow(_alive(ensemble), "a long, part int, key long, held int, top long, n long"), "asks")

    likely = near(met.withColumn("open", F.lit(True)), False).groupBy("a").agg(F.max(F.struct("equal", "b")).alias("m")).select("a", "m.b")
    led = scratch.staged(checked(likely.unionByName(asks.select("a", F.col("top").alias("b")))), "led")

    settled = led.select("doc", F.lit(False).alias("open"))
    left = met.join(settled, "doc", "left").select("key", "band", "doc", "size", "rank", F.coalesce("open", F.lit(True)).alias("open"))
    left = left.join(left.where("open").select("key").distinct(), "key", "left_semi")
    rare = asks.join(settled.select(F.col("doc").alias("a")), "a", "left_anti").select("key", "a", "part", "held")
    holds = far.where("holds").select("key", F.col("doc").alias("b"), F.col("part").alias("part_b"))
    apart = rare.join(holds, "key").where(f"part_b >= part + {GAPS} AND a != b").groupBy("a", "b").agg(F.count("*").alias("n"), F.first("held").alias("held")).where("n >= held")
    links = led.unionByName(checked(near(left, True).select("a", "b").unionByName(apart.select("a", "b"))))
    links = lasting.staged(links, "links")
    scratch.drop()
    return Classes(members.select("name", "rank", "row", "doc", "two", "size"), firsts, links)


def copies(docs: DataFrame, ensemble: Ensemble = Ensemble()) -> DataFrame:
    """(doc_id, copy_of, containment): one row for each document that is an exact or near copy, with one it copies.

    The first document of a class has the class that its own is a near copy of; the others have the first, with 1."""
    c = _classes(docs, ensemble, Scratch(docs.sparkSession))
    firsts = c.firsts.select("doc", "two", "size", F.col("row").alias("first_row"), F.col("name").alias("first"))
    target = c.firsts.select(F.col("doc").alias("copy_of"), F.col("name").alias("to"))
    linked = firsts.join(c.links.join(target, "copy_of").select("doc", "to", "containment"), "doc", "left")
    rows = c.members.join(linked, ["doc", "two", "size"]).where("row != first_row OR to IS NOT NULL OR containment IS NOT NULL")
    own = F.col("row") == F.col("first_row")
    got = rows.select(F.col("name").alias("doc_id"), "row", F.when(own, F.col("to")).otherwise(F.col("first")).alias("copy_of"), F.when(own, F.round("containment", 6)).otherwise(1.0).alias("containment"))
    return got.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("copy_of").alias("copy_of"), F.first("containment").alias("containment")).select("doc_id", "copy_of", "containment")


def deduplicate(docs: DataFrame, ensemble: Ensemble = Ensemble()) -> DataFrame:
    """``docs`` without the copies, all columns as they were: of each group the document that ranks first stays, as one row."""
    scratch = Scratch(docs.sparkSession)
    c = _classes(docs, ensemble, scratch)
    firsts = c.firsts.select("doc", "two", "size", F.col("row").alias("first_row")).join(c.links.select("doc", F.lit(True).alias("linked")), "doc", "left")
    rows = c.members.groupBy("row").agg(F.first("doc").alias("doc"), F.first("two").alias("two"), F.first("size").alias("size"), F.count("*").alias("times"))
    marks = staged(rows.join(firsts, ["doc", "two", "size"]).where("row != first_row OR linked OR times > 1").select(F.col("row").alias("__row"), (F.coalesce("linked", F.lit(False)) | (F.col("row") != F.col("first_row"))).alias("__gone")), "marks")
    scratch.drop()
    names = [f"__{i}" for i in range(len(docs.columns))]  # whatever the columns are called
    rank = F.coalesce(key_of(docs, "doc_id"), F.lit((1 << 63) - 1))
    keyed = docs.select(*(named(x).alias(n) for x, n in zip(docs.columns, names)), F.xxhash64(rank, F.col("text")).alias("__row"))
    once = keyed.join(marks, "__row", "left_anti")
    again = keyed.join(marks.where("NOT __gone"), "__row", "left_semi").dropDuplicates(["__row"])
    return once.unionByName(again).select(*(F.col(n).alias(x) for n, x in zip(names, docs.columns)))
