"""Byte-level BPE encoding and decoding as a monoid over text segments.

A text is halved until a piece has at most ``leaf`` characters; pieces are encoded on their own and joined pairwise up
the tree. A join re-encodes a window that grows to both sides of the seam until each of its outer ends is a *cut*: a
place where white space follows something that isn't white space. The pretokenising pattern can't match across such a
place, wherever the match began, and from it on it looks at nothing to its left. So tokens outside the window are those
of the joined text, for any vocabulary. Where a seam lies in a long run of one kind of characters (letters, digits, marks
or white space), which the pattern keeps whole, a window of tokens of the run grows instead until both its outer pairs are
stable: until a token and its neighbour, encoded together, are these two again. A sequence of which all neighbouring pairs
are stable is the encoding of its bytes, so nothing outside such a window changes. Where neither is found the window takes
the whole side. Decoding concatenates the bytes of tokens, half by half.

Defined results: a null text has null tokens and counts; an empty text has no tokens; the round trip of each text is
checked and reported. Repeated rows are encoded each on its own; a very long text is a taller tree; ids are of any type and
may be null; all other columns, whatever they are called, are ignored by ``encode``.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Folder of the public vocabulary files; they are read where they lie.
VOCABULARY_DIR = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LEAF = 512
#: Characters to either side of a seam that make a long run.
RUN = 256
_RUNS = regex.compile(r"\p{L}+|\p{N}+|[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+")
_CODERS: dict[str, "Coder"] = {}


class Coder:
    """Tokens of whole texts under one vocabulary."""

    def __init__(self, path: str, leaf: int = LEAF) -> None:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.leaf = leaf
        self.encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.pieces = [b""] * (max(ranks.values()) + 1)
        for piece, i in ranks.items():
            self.pieces[i] = piece
        self.sizes = np.fromiter(map(len, self.pieces), np.int64, len(self.pieces))

    def encode(self, text: str) -> np.ndarray:
        """Encodes halves and joins them."""
        if len(text) <= self.leaf:
            return np.asarray(self.encoding.encode_ordinary(text), np.int32)
        middle = len(text) // 2
        a, b = text[:middle], text[middle:]
        return self.join(a, self.encode(a), b, self.encode(b))

    def join(self, a: str, left: np.ndarray, b: str, right: np.ndarray) -> np.ndarray:
        """Tokens of ``a + b`` from those of ``a`` and of ``b``."""
        if not a or not b:
            return left if a else right
        near = self._growing(_cut_before, a), self._growing(_cut_after, b)
        if None in near:
            joined = self._inside(a, left, b, right)
            if joined is not None:
                return joined
        i, j = (self._growing(f, t, whole=True) if c is None else c for f, t, c in zip((_cut_before, _cut_after), (a, b), near))
        seam = np.asarray(self.encoding.encode_ordinary(a[i:] + b[:j]), np.int32)
        keep = self._held(left, len(a[i:].encode()), last=True)
        drop = self._held(right, len(b[:j].encode()), last=False)
        return np.concatenate((left[: len(left) - keep], seam, right[drop:]))

    @staticmethod
    def _growing(cut, text: str, whole: bool = False) -> int | None:
        """The cut nearest to the seam, within ``RUN`` characters or anywhere."""
        width = 4 * RUN if whole else 16
        while (at := cut(text, width)) is None:
            width *= 4
            if width > RUN and not whole:
                return None
        return at

    def _inside(self, a: str, left: np.ndarray, b: str, right: np.ndarray) -> np.ndarray | None:
        """Where the seam is inside a long run: tokens of it, re-encoded as far as pairs aren't stable."""
        around = a[-RUN:] + b[:RUN]
        if len(around) < 2 * RUN or _RUNS.fullmatch(around) is None:
            return None
        # The outer characters may belong to other pieces: a blank before letters, the last one of white space.
        room = min(len(a[-RUN + 2 :].encode()), len(b[: RUN - 2].encode()))
        n = 1
        while n < min(len(left), len(right)):
            one, two = left[len(left) - n :], right[:n]
            if max(int(self.sizes[one].sum()), int(self.sizes[two].sum())) + int(self.sizes[[left[-n - 1], right[n]]].max()) > room:
                return None
            mid = self._piece(b"".join(map(self.pieces.__getitem__, [*one.tolist(), *two.tolist()])))
            if self._stable(int(left[-n - 1]), mid[0]) and self._stable(mid[-1], int(right[n])):
                return np.concatenate((left[: len(left) - n], np.asarray(mid, np.int32), right[n:]))
            n *= 2
        return None

    def _piece(self, raw: bytes) -> list[int]:
        return self.encoding._encode_single_piece(raw)

    def _stable(self, x: int, y: int) -> bool:
        return self._piece(self.pieces[x] + self.pieces[y]) == [x, y]

    def _held(self, tokens: np.ndarray, size: int, last: bool) -> int:
        """How many tokens at an end make up exactly ``size`` bytes."""
        if not size:
            return 0
        n = min(len(tokens), size)
        sizes = self.sizes[tokens[len(tokens) - n :][::-1] if last else tokens[:n]]
        k = int(np.searchsorted(np.cumsum(sizes), size)) + 1
        if int(sizes[:k].sum()) != size:
            raise ValueError("a cut isn't a token boundary")
        return k

    def decode(self, tokens: np.ndarray) -> bytes:
        """Concatenates up the tree."""
        if len(tokens) <= 4 * self.leaf:
            return b"".join(map(self.pieces.__getitem__, tokens.tolist()))
        middle = len(tokens) // 2
        return self.decode(tokens[:middle]) + self.decode(tokens[middle:])


def _is_cut(text: str, i: int) -> bool:
    return text[i].isspace() and not text[i - 1].isspace() and not _odd(text[i]) and not _odd(text[i - 1])


def _odd(c: str) -> bool:
    """The four separators that ``str.isspace`` has and the pattern's white space hasn't."""
    return "\x1c" <= c <= "\x1f"


def _cut_before(a: str, width: int) -> int | None:
    """The last cut of ``a`` within ``width`` characters of its end, 0 if it is wholly within, None if there is none."""
    low = max(1, len(a) - width)
    for i in range(len(a) - 1, low - 1, -1):
        if _is_cut(a, i):
            return i
    return 0 if len(a) <= width else None


def _cut_after(b: str, width: int) -> int | None:
    """The first cut of ``b`` within ``width`` characters, its length if it is wholly within, None if there is none."""
    for j in range(1, min(width, len(b))):
        if _is_cut(b, j):
            return j
    return len(b) if len(b) <= width else None


def coder(path: str, leaf: int = LEAF) -> Coder:
    """One coder for each vocabulary and worker process."""
    key = f"{path}:{leaf}"
    if key not in _CODERS:
        _CODERS[key] = Coder(path, leaf)
    return _CODERS[key]


SCHEMA = "tokens array<int>, n_tokens int, n_bytes bigint, round_trip boolean"
_ARROW = [pa.field("tokens", pa.list_(pa.int32())), pa.field("n_tokens", pa.int32()), pa.field("n_bytes", pa.int64()), pa.field("round_trip", pa.bool_())]


def encode(docs: DataFrame, *, vocabulary_dir: str = VOCABULARY_DIR, vocabulary: str = VOCABULARY, leaf: int = LEAF) -> DataFrame:
    """(doc_id, tokens, n_tokens, n_bytes, round_trip) for every row of ``docs``, in one pass without a shuffle."""
    path = os.path.join(vocabulary_dir, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(path, leaf)
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                tokens, counts, sizes, same = [], [], [], []
                for text in part.column(1).to_pylist():
                    if text is None:
                        counts.append(None), sizes.append(None), same.append(None)
                        continue
                    t, raw = own.encode(text), text.encode()
                    tokens.append(t), counts.append(len(t)), sizes.append(len(raw)), same.append(own.decode(t) == raw)
                values = np.concatenate(tokens) if tokens else np.zeros(0, np.int32)
                ends = np.cumsum([c or 0 for c in counts])
                mask = pa.array([c is None for c in counts])
                offsets = pa.array(np.concatenate(([0], ends)), pa.int32())
                lists = pa.ListArray.from_arrays(offsets, pa.array(values, pa.int32()), mask=mask)
                cols = [part.column(0), lists, pa.array(counts, pa.int32()), pa.array(sizes, pa.int64()), pa.array(same, pa.bool_())]
                yield pa.RecordBatch.from_arrays(cols, schema=pa.schema([batch.schema.field(0), *_ARROW]))

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {SCHEMA}")
