"""Language ID by multilingual mixture inference.

Each language (each value of ``lang``) has a model of byte trigrams, hashed to 2**16 cells, counted over all documents
that name it. A document is a mixture: each word comes from one language, with the likelihood of its trigrams, and
expectation-maximisation estimates the proportions, until none moves by more than ``TOLERANCE``. The set of languages is the one with the highest likelihood less a
penalty of ``penalty * ln(words)`` for each language beyond the first: the best single language is compared with the
mixture of all, and where that gains more than one penalty, languages are taken away one by one, that of the smallest
loss first, each set being fitted anew.

Defined results: a text without words (null, empty, white space) has no language, no shares and a null likelihood;
documents without ``lang`` are scored and not counted; without any language no row has one; ties go to the language that
comes first by name; repeated rows count and are scored each; a very long text is one mixture, for which a task holds a
number for each of its words and languages; ids are of any type and may be null; other columns, whatever they are
called, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from screenlake.llm.textcols import LOWER, blocks, segment_sums, word_spans

CELLS = 1 << 16
PENALTY, ITERATIONS, TOLERANCE = 3.0, 100, 1e-4


def trigrams(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each byte the cell of the trigram around it; blanks stand outside the text."""
    x = LOWER[data].astype(np.uint32)
    n = len(x)
    before, after = np.full(n, 32, np.uint32), np.full(n, 32, np.uint32)
    before[1:], after[:-1] = x[:-1], x[1:]
    full = np.diff(offsets) > 0
    before[offsets[:-1][full]] = 32
    after[offsets[1:][full] - 1] = 32
    return ((((before << 16) | (x << 8) | after) * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.int64)


def counts(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages by name, and the count of each cell in each of them, over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[str, np.ndarray] = {}
        for batch in batches:
            coded = batch.column(1).dictionary_encode()
            names, code = coded.dictionary.to_pylist(), coded.indices.fill_null(len(coded.dictionary)).to_numpy().astype(np.int64)
            for b in blocks(batch.column(0)):
                start, end, _ = word_spans(b.data, b.offsets)
                solid = np.zeros(len(b.data) + 1, np.int8)
                np.add.at(solid, start, 1), np.add.at(solid, end, -1)
                inside = np.cumsum(solid[:-1]).astype(bool)
                language = np.repeat(code[b.lo : b.hi], np.diff(b.offsets))
                table = np.bincount((language * CELLS + trigrams(b.data, b.offsets))[inside], minlength=(len(names) + 1) * CELLS).reshape(-1, CELLS)
                for i, name in enumerate(names):
                    if table[i].any():
                        own[name] = own.get(name, 0) + table[i]
        for name, n in own.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at)), pa.array(at.astype(np.int32)), pa.array(n[at])], ["lang", "cell", "n"])

    rows = docs.where("lang IS NOT NULL").select("text", F.col("lang").cast("string").alias("lang")).mapInArrow(run, "lang string, cell int, n bigint").groupBy("lang", "cell").agg(F.sum("n").alias("n"))
    got = rows.toPandas()  # 2**16 rows a language at most
    names = sorted(got["lang"].unique())
    table = np.zeros((len(names), CELLS))
    table[got["lang"].map({x: i for i, x in enumerate(names)}).to_numpy(np.int64), got["cell"].to_numpy()] = got["n"]
    return names, table


def model(table: np.ndarray) -> np.ndarray:
    """(languages, CELLS) log-probabilities, with half a count added to each cell."""
    return np.log((table + 0.5) / (table.sum(1, keepdims=True) + 0.5 * CELLS)).astype(np.float32)


def mixture(like: np.ndarray, top: np.ndarray, pointer: np.ndarray, allowed: np.ndarray, iterations: int = ITERATIONS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """EM: (shares, log-likelihood, loss of it without each language) of each document. ``like`` has the likelihood of each word in
    each language over the largest, whose logarithm is ``top``; ``allowed`` is a mask of each document's languages."""
    n = np.diff(pointer)
    share = allowed / np.maximum(allowed.sum(1, keepdims=True), 1)
    open_ = np.flatnonzero(n > 0)
    word = np.arange(len(like))
    at = pointer
    for _ in range(iterations):
        if not len(open_):
            break
        m = n[open_]
        r = like[word] * np.repeat(share[open_], m, axis=0).astype(np.float32)
        r /= np.maximum(r.sum(1, keepdims=True), 1e-30)
        at = np.concatenate(([0], np.cumsum(m)))
        new = np.column_stack([segment_sums(r[:, k], at) for k in range(like.shape[1])]) / m[:, None]
        moved = np.abs(new - share[open_]).max(1) > TOLERANCE
        share[open_] = new
        word, open_ = word[np.repeat(moved, m)], open_[moved]
    part = like * np.repeat(share, n, axis=0).astype(np.float32)
    p = np.maximum(part.sum(1), 1e-30)
    loss = np.column_stack([segment_sums(np.log(p) - np.log(np.maximum(p - part[:, k], 1e-30)), pointer) for k in range(like.shape[1])])
    return share, segment_sums(top, pointer) + segment_sums(np.log(p), pointer), loss


def infer(logp: np.ndarray, data: np.ndarray, offsets: np.ndarray, penalty: float = PENALTY, iterations: int = ITERATIONS) -> tuple[np.ndarray, np.ndarray]:
    """(shares with zeros for languages outside the set, log-likelihood) of each text of a block."""
    start, end, pointer = word_spans(data, offsets)
    n, languages = np.diff(pointer), len(logp)
    words, cells, total = np.empty((len(start), languages), np.float32), trigrams(data, offsets), np.zeros(len(data) + 1)
    for k in range(languages):  # one at a time: memory doesn't follow bytes times languages
        np.cumsum(logp[k].take(cells), out=total[1:], dtype=np.float64)
        words[:, k] = total[end] - total[start]
    top = words.max(1) if len(words) else np.zeros(0, np.float32)
    single = np.column_stack([segment_sums(words[:, k], pointer) for k in range(languages)])
    best = single.argmax(1)
    rows = np.arange(len(n))
    share, like = np.zeros((len(n), languages)), single[rows, best]
    share[rows, best] = n > 0
    fee = penalty * np.log(np.maximum(n, 2))
    # No mixture is likelier than the best language of each word: where that gains less than a penalty, one it is.
    open_ = np.flatnonzero((n > 1) & (segment_sums(top, pointer) - like > fee))
    if not len(open_) or languages < 2:
        return share, like

    def of(docs: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        k = np.repeat(pointer[docs] - np.concatenate(([0], np.cumsum(n[docs])[:-1])), n[docs]) + np.arange(n[docs].sum())
        return mixture(np.exp(words[k] - top[k, None]), top[k], np.concatenate(([0], np.cumsum(n[docs]))), allowed, iterations)

    allowed = np.ones((len(open_), languages), bool)
    s, l, loss = of(open_, allowed)
    value = l - fee[open_] * (languages - 1)
    gained = l - like[open_] > fee[open_]
    open_, s, l, value, allowed, loss = open_[gained], s[gained], l[gained], value[gained], allowed[gained], loss[gained]
    best_s, best_l, best_v = s.copy(), l.copy(), value.copy()
    for size in range(languages - 1, 1, -1):
        if not len(open_):
            break
        weakest = np.where(allowed, loss, np.inf).argmin(1)
        allowed = allowed.copy()
        allowed[np.arange(len(open_)), weakest] = False
        s, l, loss = of(open_, allowed)
        value = l - fee[open_] * (size - 1)
        better = value >= best_v
        best_s[better], best_l[better], best_v[better] = s[better], l[better], value[better]
    wins = best_v > like[open_]
    share[open_[wins]], like[open_[wins]] = best_s[wins], best_l[wins]
    return share, like


def identify(docs: DataFrame, *, penalty: float = PENALTY, iterations: int = ITERATIONS) -> DataFrame:
    """(doc_id, language, n_languages, shares, log_likelihood) for every row of ``docs``."""
    names, table = counts(docs)
    kind = docs.schema["doc_id"].dataType.simpleString()
    if not names:
        return docs.select("doc_id", F.lit(None).cast("string").alias("language"), F.lit(0).alias("n_languages"), F.expr("cast(array() as array<struct<language:string,share:double>>)").alias("shares"), F.lit(None).cast("double").alias("log_likelihood"))
    logp = model(table)
    pair = pa.struct([("language", pa.string()), ("share", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        label = np.array(names, object)
        for batch in batches:
            for b in blocks(batch.column(1), 1 << 19):
                share, like = infer(logp, b.data, b.offsets, penalty, iterations)
                none = ~(share > 0).any(1)
                order = np.argsort(-share, axis=1, kind="stable")
                ranked = np.take_along_axis(share, order, 1)
                kept = ranked > 0
                n = kept.sum(1)
                values = pa.StructArray.from_arrays([pa.array(label[order[kept]], pa.string()), pa.array(np.round(ranked[kept], 6))], ["language", "share"])
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))), pa.int32()), values)
                cols = [batch.column(0).slice(b.lo, b.hi - b.lo), pa.array(label[order[:, 0]], pa.string(), mask=none), pa.array(n, pa.int32()), lists, pa.array(np.round(like, 6), mask=none)]
                yield pa.RecordBatch.from_arrays(cols, schema=pa.schema([batch.schema.field(0), ("language", pa.string()), ("n_languages", pa.int32()), ("shares", pa.list_(pair)), ("log_likelihood", pa.float64())]))

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, language string, n_languages int, shares array<struct<language:string,share:double>>, log_likelihood double")
