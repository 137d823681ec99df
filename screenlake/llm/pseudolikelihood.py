"""LM scoring: masked pseudo-likelihood under a bidirectional window network.

Tokens are the bytes of a text, all 256 of them, so every script counts alike. The network sees ``SIDE`` bytes on either
side of a masked one. Each is embedded, the embeddings go through one hidden layer of rectified units, and a two-level softmax gives the
distribution of the masked byte: its high half, then its low half given the high one. A score is the sum over all bytes
of a text of the log-probability of each given both sides.

Training is distributed, in numpy, and every byte of the corpus is trained on: documents are dealt to ``rounds`` by a hash
of their text; in a round each task starts from the common weights and takes Adam steps over all windows of its own
documents of that round, ``batch`` at a time, drawn from all over a block of texts; the weights are then averaged, each
task's by its bytes, as sums by weight in a shuffle. So the steps, and what is gathered, grow with the corpus, and only
the averages, of a fixed number, come to the driver. The biases start from the counts of all bytes of all texts. For scores each task has
what all pairs of symbols add to the hidden units, 33 MB.

Defined results: a null text has null scores; an empty text has 0 tokens, the sum 0 and no mean; outside a text stands a
symbol of its own; a corpus without bytes has a network of equal probabilities; repeated rows are trained on and scored
each; a very long text is read in chunks; ids are of any type and may be null; other columns, whatever they are called,
are ignored. Which windows share a task follows from how the table is split, so scores differ a little between
layouts of the same rows.
"""

from __future__ import annotations

import functools
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from screenlake.llm.ids import named
from screenlake.llm.textcols import Block, blocks

SIDE, WIDTH, HIDDEN = 5, 8, 24
ROUNDS, BATCH, RATE = 3, 4096, 0.02
#: Windows in one row of a product with the hidden layer: wider products are faster, but have more weights of 0.
NEXT = 3
#: More columns than there are windows: rows a power of two apart would share places in the cache.
APART = 40
#: Symbols scored at a time.
SCORED = 8192
#: Stands outside of texts.
OUTSIDE = 256


@functools.cache
def _layout(side: int, width: int, hidden: int) -> tuple[tuple[str, slice, tuple[int, ...]], ...]:
    """(name, place in the vector, shape) of each array of weights."""
    shapes = {"embedding": (width, 257), "inner": (hidden, 2 * side * width), "bias": (hidden,), "high": (16, hidden), "high_bias": (16,), "low": (16, 16, hidden), "low_bias": (16, 16)}
    edge = list(itertools.accumulate((math.prod(s) for s in shapes.values()), initial=0))
    return tuple((name, slice(lo, hi), shape) for (name, shape), lo, hi in zip(shapes.items(), edge, edge[1:]))


class Network:
    """Weights as views of one vector. Arrays have one column for each token."""

    def __init__(self, theta: np.ndarray | None = None, side: int = SIDE, width: int = WIDTH, hidden: int = HIDDEN) -> None:
        self.side, self.width, self.hidden = side, width, hidden
        layout = _layout(side, width, hidden)
        self.theta = np.zeros(layout[-1][1].stop, np.float32) if theta is None else theta
        for name, at, shape in layout:
            setattr(self, name, self.theta[at].reshape(shape))

    @classmethod
    def start(cls, counts: np.ndarray, seed: int = 0, **shape: int) -> "Network":
        """Biases give each byte its share of ``counts``."""
        net = cls(**shape)
        r = np.random.default_rng(seed)
        net.embedding[:] = r.normal(0, 0.5, net.embedding.shape)
        net.inner[:] = r.normal(0, (net.side * net.width) ** -0.5, net.inner.shape)
        share = (counts + 1.0).reshape(16, 16)
        net.high_bias[:] = np.log(share.sum(1) / share.sum())
        net.low_bias[:] = np.log(share / share.sum(1, keepdims=True))
        return net

    def forward(self, piece: np.ndarray, told: bool = True) -> tuple[np.ndarray | None, tuple]:
        """Log-probabilities of the symbols of each row of ``piece`` but for ``side`` at either end, 0 for those outside, if ``told``; what
        ``gradient`` needs.

        No window is copied. The rows stand one after another; ``NEXT`` windows in a row are one row of a product, with weights of 0 for the symbols
        that are masked or in other windows; every ``step`` symbols such rows don't overlap, so the embeddings themselves are the matrix of these.
        """
        side, width, hidden, span = self.side, self.width, self.hidden, 2 * self.side + 1
        symbol, (rows, long) = piece.ravel(), piece.shape
        ahead = NEXT + span - 1
        step = -(-ahead // NEXT) * NEXT
        q = -(-len(symbol) // step)
        near = np.zeros((step * (q + 1), width), np.float32)
        near[: len(symbol)] = np.ascontiguousarray(self.embedding.T).take(symbol, 0)
        windows = _windows(near, NEXT, step, q, ahead)
        taps, inner = self._taps(), np.zeros((ahead, width, NEXT, hidden), np.float32)
        for i in range(NEXT):
            inner[i : i + span, :, i] = taps
        inner = inner.reshape(ahead * width, -1)
        every = np.empty((q, step // NEXT, NEXT * hidden), np.float32)
        np.matmul(windows, inner, out=every.transpose(1, 0, 2))
        every = every.reshape(q, -1)
        every += np.tile(self.bias, step)
        np.maximum(every, np.zeros(step * hidden, np.float32), out=every)
        inside = np.zeros((rows, long), bool)
        np.less(piece[:, side : long - side], OUTSIDE, out=inside[:, side : long - side])
        order = symbol.argsort(kind="stable")
        at = order[inside.ravel()[order]]
        h = np.empty((len(at), hidden + 1), np.float32)
        h[:, :-1] = units = every.reshape(-1, hidden).take(at - side, 0)
        h[:, -1] = 1
        del every
        own, kept = self._told(h, symbol.take(at), self._levels(), told)
        logp = None
        if told:
            logp = np.zeros(len(symbol), np.float32)
            logp[at] = own
            logp = logp.reshape(rows, long)[:, side : long - side].ravel()
        return logp, (symbol, windows, inner, order, at, units, *kept)

    def _taps(self) -> np.ndarray:
        """Weights by symbol of a window, with 0 for the masked one."""
        side, width, hidden = self.side, self.width, self.hidden
        taps = np.zeros((2 * side + 1, width, hidden), np.float32)
        by = self.inner.T.reshape(2 * side, width, hidden)
        taps[:side], taps[side + 1 :] = by[:side], by[side:]
        return taps

    def _levels(self) -> np.ndarray:
        """Weights of both levels of the softmax for each high half, with the biases last."""
        levels = np.empty((16, 32, self.hidden + 1), np.float32)
        levels[:, :16, :-1], levels[:, :16, -1], levels[:, 16:, :-1], levels[:, 16:, -1] = self.high, self.high_bias, self.low, self.low_bias
        return levels

    def _told(self, h: np.ndarray, token: np.ndarray, levels: np.ndarray, told: bool = True) -> tuple[np.ndarray | None, tuple]:
        """Log-probabilities of the symbols ``token``, which are in order, if ``told``; what ``gradient`` needs.

        ``h`` has the hidden units of each, and a 1 for the biases. As symbols are in order, both levels of the softmax are one product for each high half.
        """
        n = len(h)
        edge = token.searchsorted(np.arange(0, 257, 16, dtype=token.dtype)).tolist()
        parts = [(v, slice(edge[v], edge[v + 1])) for v in range(16) if edge[v] < edge[v + 1]]
        z = np.empty((32, n + APART), np.float32)
        z[:, n:] = 0
        place = token.astype(np.int64)
        place &= 15
        place += 16
        place *= n + APART
        place += np.arange(n)
        own = np.empty((2, n), np.float32) if told else None
        both = z.reshape(2, 16, -1)
        for careful in (False, True):
            for v, s in parts:
                zs = z[:, s]
                np.matmul(levels[v], h[s].T, out=zs)
                if told:
                    own[0, s] = zs[v]
            if told:
                z.reshape(-1).take(place, out=own[1], mode="clip")
            if careful:
                top = both.max(1)
                both -= top[:, None]
                if told:
                    own -= top[:, :n]
            with np.errstate(over="ignore"):
                np.exp(z, out=z)
                total = both.sum(1)
            if 1e-30 < total.min() and total.max() < 1e30:  # else exponentials left the range of their type
                break
            z[:, n:] = 0
        if told:
            own -= np.log(total[:, :n])
            own = own[0] + own[1]
        return own, (h, parts, levels, z, total, place)

    def gradient(self, kept: tuple) -> np.ndarray:
        """Of the mean negative log-probability of the real tokens, as one vector. What ``forward`` kept is used up."""
        symbol, windows, inner, order, at, units, h, parts, levels, z, total, place = kept
        side, width, hidden, span, (phases, q, _) = self.side, self.width, self.hidden, 2 * self.side + 1, windows.shape
        out = Network(np.zeros_like(self.theta), side, width, hidden)
        n, step, ahead = len(at), phases * NEXT, NEXT + span - 1
        share = np.float32(1 / max(1, n))
        both = z.reshape(2, 16, -1)
        both *= (share / total)[:, None]
        z.reshape(-1)[place] -= share
        slopes, weights = np.zeros_like(levels), np.ascontiguousarray(levels[:, :, :-1])
        back = np.empty((n + 1, hidden), np.float32)
        back[n] = 0  # of windows that count for nothing
        for v, s in parts:
            zs = z[:, s]
            zs[v] -= share
            np.matmul(zs, h[s], out=slopes[v])
            np.matmul(zs.T, weights[v], out=back[s])
        high = slopes[:, :16].sum(0)
        out.high[:], out.high_bias[:], out.low[:], out.low_bias[:] = high[:, :-1], high[:, -1], slopes[:, 16:, :-1], slopes[:, 16:, -1]
        back[:n] *= units > 0
        out.bias[:] = np.ones(n, np.float32) @ back[:n]
        # Row i: what comes back to the window that begins at symbol i
        row = np.full(step * q, n)
        row[at - side] = np.arange(n)
        back = back.take(row, 0).reshape(q, phases, NEXT * hidden).transpose(1, 0, 2)
        g = np.matmul(back.transpose(0, 2, 1), windows).sum(0).reshape(NEXT, hidden, ahead * width)
        g = sum(g[i, :, i * width : (i + span) * width] for i in range(NEXT))
        out.inner[:, : side * width], out.inner[:, side * width :] = g[:, : side * width], g[:, (side + 1) * width :]
        # What comes back to the symbols of these windows, and its sums by symbol
        near, turned = np.zeros((q + 1) * step * width, np.float32), np.ascontiguousarray(inner.T)
        for i in range(phases):
            first = i * NEXT * width
            near[first : first + q * step * width].reshape(q, -1)[:, : ahead * width] += back[i] @ turned
        near = np.ascontiguousarray(near.reshape(-1, width).take(order, 0).T)
        count = np.bincount(symbol, minlength=257)
        some = np.flatnonzero(count)
        out.embedding[:, some] = np.add.reduceat(near, (np.cumsum(count) - count)[some], 1)
        return out.theta

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """(what each pair of symbols around a masked one adds to the hidden units, with the biases at the first; levels). For many texts with
        the same weights: ``forward`` goes without."""
        side, width = self.side, self.width
        one = np.zeros((2 * side, 257, self.hidden + 1), np.float32)
        for k in range(2 * side):
            one[k, :, :-1] = self.embedding.T @ self.inner[:, k * width : (k + 1) * width].T
        one[0] += np.append(self.bias, np.float32(1))
        return (one[::2, :, None] + one[1::2, None]).reshape(side, 257 * 257, -1), self._levels()

    def tell(self, x: np.ndarray, pairs: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """Log-probabilities of the symbols of ``x`` but for ``side`` at either end."""
        side, (table, levels) = self.side, pairs
        n = len(x) - 2 * side
        place = [k + (k >= side) for k in range(2 * side)]
        code = {gap: x[:-gap] * np.int64(257) + x[gap:] for gap in {b - a for a, b in zip(place[::2], place[1::2])}}
        every = more = None
        for k, (a, b) in enumerate(zip(place[::2], place[1::2])):
            if every is None:
                every = table[k].take(code[b - a][a : a + n], 0)
                more = np.empty_like(every)
            else:
                every += table[k].take(code[b - a][a : a + n], 0, out=more, mode="clip")
        np.maximum(every, np.zeros_like(every), out=every)
        token = x[side : side + n]
        order = token.argsort(kind="stable")[: np.count_nonzero(token < OUTSIDE)]
        out = np.zeros(n, np.float32)
        out[order] = self._told(every.take(order, 0), token.take(order), levels)[0]
        return out


def _windows(x: np.ndarray, apart: int, step: int, rows: int, long: int) -> np.ndarray:
    """For each beginning, ``apart`` from the last and before ``step``, ``rows`` rows of ``long`` rows of ``x``, ``step`` apart. A view."""
    one = x.strides[0]
    return np.ndarray((step // apart, rows, long * x.shape[1]), x.dtype, x, 0, (apart * one, step * one, x.itemsize))


class Adam:
    """Steps of a network."""

    def __init__(self, net: Network, rate: float) -> None:
        self.net, self.rate, self.t = net, rate, 0
        self.m, self.v = np.zeros_like(net.theta), np.zeros_like(net.theta)

    def step(self, piece: np.ndarray) -> None:
        _, kept = self.net.forward(piece, told=False)
        g = self.net.gradient(kept)
        self.t += 1
        self.m += 0.1 * (g - self.m)
        g *= g
        g -= self.v
        g *= 0.001
        self.v += g
        np.divide(self.v, 1 - 0.999**self.t, out=g)
        np.sqrt(g, out=g)
        g += 1e-8
        np.divide(self.m, g, out=g)
        g *= self.rate / (1 - 0.9**self.t)
        self.net.theta -= g


def symbols(b: Block, side: int) -> tuple[np.ndarray, np.ndarray]:
    """(the texts of a block with ``side`` symbols from outside around each, where each begins)."""
    n = np.diff(b.offsets)
    start = b.offsets[:-1] + side * np.arange(1, len(n) + 1)
    out = np.full(len(b.data) + side * (len(n) + 1), OUTSIDE, np.uint16)
    out[np.arange(len(b.data)) + np.repeat(start - b.offsets[:-1], n)] = b.data
    return out, start


def pieces(x: np.ndarray, side: int, batch: int) -> Iterator[np.ndarray]:
    """All windows of a block in batches of about ``batch``, each with runs of 64 from all over it."""
    run = min(64, batch)
    rows = max(1, min(batch // run, -(-len(x) // run)))
    length = -(-len(x) // (rows * run)) * run
    wide = np.full(rows * length + 2 * side, OUTSIDE, np.uint16)
    wide[side : side + len(x)] = x
    view = np.lib.stride_tricks.as_strided(wide, (rows, length + 2 * side), (2 * length, 2))
    for j in range(0, length, run):
        piece = view[:, j : j + run + 2 * side]
        if (piece[:, side : side + run] < OUTSIDE).any():
            yield piece


def byte_counts(docs: DataFrame) -> np.ndarray:
    """How often each byte is in all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(256, np.int64)
        for batch in batches:
            for b in blocks(batch.column(0)):
                n += np.bincount(b.data, minlength=256)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(n[some])], ["byte", "n"])

    out = np.zeros(256)
    for row in docs.select("text").mapInArrow(run, "byte int, n bigint").groupBy("byte").agg(F.sum("n").alias("n")).collect():  # 256 rows
        out[row.byte] = row.n
    return out


def fit(docs: DataFrame, *, rounds: int = ROUNDS, batch: int = BATCH, rate: float = RATE, epochs: int = 1, seed: int = 0, **shape: int) -> Network:
    """Weights averaged over tasks after each round; each text is in one round, and trained on ``epochs`` times there."""
    net = Network.start(byte_counts(docs), seed, **shape)
    for turn in range(rounds):
        start, now = net.theta.copy(), rate * (1 - turn / (rounds + 1))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = Network(start.copy(), net.side, net.width, net.hidden)
            adam, n = Adam(own, now), 0
            for got in batches:
                for b in blocks(got.column(0)):
                    x, _ = symbols(b, own.side)
                    for _ in range(epochs):
                        for piece in pieces(x, own.side, batch):
                            adam.step(piece)
                    n += len(b.data)
            if n:
                at = np.arange(len(own.theta), dtype=np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(own.theta.astype(np.float64) * n), pa.array(np.full(len(at), n, np.int64))], ["i", "w", "n"])

        mine = docs.where(F.col("text").isNotNull() & (F.pmod(F.xxhash64("text"), F.lit(rounds)) == turn)).select("text")
        rows = mine.mapInArrow(run, "i int, w double, n bigint").groupBy("i").agg((F.sum("w") / F.sum("n")).alias("w")).collect()  # a row for each weight
        for row in rows:
            net.theta[row.i] = row.w
    return net


def log_likelihoods(net: Network, b: Block, pairs: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """The score of each text of a block."""
    pairs = pairs or net.pairs()
    x, start = symbols(b, net.side)
    out = np.zeros(len(x) + 1)
    for lo in range(net.side, len(x) - net.side, SCORED):
        hi = min(lo + SCORED, len(x) - net.side)
        out[lo:hi] = net.tell(x[lo - net.side : hi + net.side], pairs)
    total = np.concatenate(([0.0], np.cumsum(out)))
    return total[start + np.diff(b.offsets)] - total[start]


def score(docs: DataFrame, **how: float) -> DataFrame:
    """(doc_id, n_tokens, log_likelihood, mean_log_likelihood) for every row of ``docs``, by a network trained on them."""
    rows = docs.select(named("doc_id").alias("doc_id"), named("text").alias("text"))
    fitted = fit(rows, **how)
    theta, shape = fitted.theta, (fitted.side, fitted.width, fitted.hidden)
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Network(theta, *shape)
        pairs = net.pairs()
        for batch in batches:
            null = batch.column(1).is_null()
            for b in blocks(batch.column(1)):
                total, n = log_likelihoods(net, b, pairs), np.diff(b.offsets)
                no = null.slice(b.lo, b.hi - b.lo).to_numpy(zero_copy_only=False)
                cols = [batch.column(0).slice(b.lo, b.hi - b.lo), pa.array(n, pa.int64(), mask=no), pa.array(np.round(total, 6), mask=no), pa.array(np.round(total / np.maximum(n, 1), 6), mask=no | (n == 0))]
                yield pa.RecordBatch.from_arrays(cols, schema=pa.schema([batch.schema.field(0), ("n_tokens", pa.int64()), ("log_likelihood", pa.float64()), ("mean_log_likelihood", pa.float64())]))

    return rows.mapInArrow(run, f"doc_id {kind}, n_tokens bigint, log_likelihood double, mean_log_likelihood double")
