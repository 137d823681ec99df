"""Vectorised views of Arrow string columns: byte blocks, words, rolling hashes.

Every operator of this subpackage that has to leave the JVM reads whole texts through these helpers. A batch is
walked in blocks of whole documents of about ``BLOCK`` bytes, so that the temporaries of a task are bounded by the
block, or by the longest single document, and never by the number of rows of a batch.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

BLOCK = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POWERS: dict[str, np.ndarray] = {}

#: ASCII white space, the only word separators.
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: ASCII lower case, every kind of white space as a blank.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
LOWER[SPACE] = 32


@dataclass
class Block:
    """Rows ``lo`` to ``hi`` of a batch: their bytes and the offsets of each text in them. Null texts are empty."""

    lo: int
    hi: int
    data: np.ndarray
    offsets: np.ndarray


def string_buffer(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null has no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if pa.types.is_large_string(column.type):
        kind = np.int64
    else:
        column, kind = column.cast(pa.string()), np.int32
    n, first = len(column), column.offset
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, kind)[first : first + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: int, size: int = 8 * BLOCK) -> Iterator[pa.RecordBatch]:
    """A batch in slices of whole rows, of about ``size`` bytes in a string or binary column. Memory goes back after each."""
    n = batch.num_rows
    if n:
        raw = batch.column(column)
        at = np.concatenate(([0], np.cumsum(np.asarray(pa.compute.fill_null(pa.compute.binary_length(raw), 0), np.int64))))
        lo = 0
        while lo < n:
            hi = min(n, max(lo + 1, int(np.searchsorted(at, at[lo] + size, "right")) - 1))
            yield batch.slice(lo, hi - lo)
            release()
            lo = hi


def release() -> None:
    """Gives freed memory back to the system: workers stay from stage to stage, and several share an executor."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not every C library has it
        pass


def blocks(column: pa.Array, size: int = BLOCK) -> Iterator[Block]:
    """Blocks of whole texts of about ``size`` bytes."""
    data, offsets = string_buffer(column)
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + size, "right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield Block(lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        lo = hi


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64, at least ``n`` of them."""
    have = _POWERS.get("p")
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        for key, base in (("p", _BASE), ("i", _BASE_INV)):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            _POWERS[key] = np.multiply.accumulate(x)
    return _POWERS["p"], _POWERS["i"]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so that all bits of a rolling hash are usable."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def range_hash(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of ``values[start:end]`` for each pair, by prefix sums of a polynomial hash."""
    n = len(values)
    p, inv = powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * p[:n], out=total[1:])
    return mix((total[end] - total[start]) * inv[start])


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, pointer): byte spans of the words, and for each text the index of its first word (n + 1 values)."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets), np.int64)
    solid = ~SPACE[data]
    begin, finish = solid.copy(), solid.copy()
    begin[1:] &= ~solid[:-1]
    finish[:-1] &= ~solid[1:]
    cuts = offsets[(offsets > 0) & (offsets < n)]
    begin[cuts] = solid[cuts]
    finish[cuts - 1] = solid[cuts - 1]
    start, end = np.flatnonzero(begin), np.flatnonzero(finish) + 1
    return start, end, np.searchsorted(start, offsets)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each window of ``width`` values, by doubling."""
    if len(x) < width:
        return x[:0]
    out, have = x, 1
    while 2 * have <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    rest = width - have
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def segment_sums(values: np.ndarray, pointer: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between successive pointers; an empty segment has 0."""
    total = np.zeros(len(values) + 1, np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=total[1:], dtype=total.dtype)
    return total[pointer[1:]] - total[pointer[:-1]]


def ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Concatenated ``start[i] .. start[i] + count[i] - 1``."""
    total = int(count.sum())
    if not total:
        return np.zeros(0, np.int64)
    first = np.repeat(start - np.concatenate(([0], np.cumsum(count)[:-1])), count)
    return first + np.arange(total)


def list_array(values: pa.Array, pointer: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(pointer, pa.int32()), values)
