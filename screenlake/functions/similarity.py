"""Jaro-Winkler over whole Arrow batches, and what fuzzy screening measures with it.

All pairs of a batch are compared at once: position by position of the left strings, over a matrix of the right ones.
Transpositions count as halves, and common prefixes of up to four characters always count.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from screenlake.functions.text import length_ratio

PREFIX_SCALE = 0.1
LEAST_RATIO = 0.5
MEASURES = StructType([StructField("whole", DoubleType()), StructField("token", DoubleType()), StructField("covered", IntegerType())])


def _matrix(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points by row, 0 beyond the end; lengths."""
    size = np.fromiter(map(len, values), np.int64, len(values))
    wide = max(1, int(size.max(initial=0)))
    return np.array(values, dtype=f"U{wide}").view(np.uint32).reshape(len(values), wide), size


def jaro_pairs(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Jaro similarity of each pair of strings."""
    out = np.zeros(len(left))
    # Long and short pairs apart, so that one long string doesn't widen all.
    size = np.fromiter((max(len(a), len(b)) for a, b in zip(left, right)), np.int64, len(left))
    for band in np.unique(np.ceil(np.log2(np.maximum(size, 8)))):
        rows = np.flatnonzero(np.ceil(np.log2(np.maximum(size, 8))) == band)
        step = max(1, (1 << 22) >> int(band))
        for lo in range(0, len(rows), step):
            part = rows[lo : lo + step]
            out[part] = _jaro(left[part], right[part])
    return out


def _jaro(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    a, na = _matrix(left)
    b, nb = _matrix(right)
    n = len(a)
    reach = np.maximum(np.maximum(na, nb) // 2 - 1, 0)
    free = np.arange(b.shape[1]) < nb[:, None]
    column = np.arange(b.shape[1])
    hit = np.zeros(a.shape, bool)
    for i in range(a.shape[1]):
        can = free & (b == a[:, i : i + 1]) & (np.abs(column - i) <= reach[:, None]) & (i < na)[:, None]
        j = can.argmax(1)
        got = can[np.arange(n), j]
        hit[:, i] = got
        free[np.flatnonzero(got), j[got]] = False
    taken = (column < nb[:, None]) & ~free
    m = hit.sum(1)
    # The matched characters of both sides, in order: they stand flat by row.
    differ = a[hit] != b[taken]
    row = np.repeat(np.arange(n), m)
    half = np.bincount(row, differ, n) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        score = (m / na + m / nb + (m - half) / m) / 3
    score[m == 0] = 0
    score[left == right] = 1
    return score


def jaro_winkler_pairs(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    score = jaro_pairs(left, right)
    common = np.fromiter((next((i for i in range(min(4, len(a), len(b))) if a[i] != b[i]), min(4, len(a), len(b))) for a, b in zip(left, right)), np.int64, len(left))
    return np.where(score == 0, 0.0, score + common * PREFIX_SCALE * (1 - score))


def _over(pairs, a: pd.Series, b: pd.Series) -> pd.Series:
    known = (a.notna() & b.notna()).to_numpy()
    out = np.full(len(a), np.nan)
    if known.any():
        out[known] = pairs(a.to_numpy(object)[known], b.to_numpy(object)[known])
    return pd.Series(out).astype(object).where(known, None)


@F.pandas_udf(DoubleType())
def jaro(a: pd.Series, b: pd.Series) -> pd.Series:
    return _over(jaro_pairs, a, b)


@F.pandas_udf(DoubleType())
def jaro_winkler(a: pd.Series, b: pd.Series) -> pd.Series:
    return _over(jaro_winkler_pairs, a, b)


def measure(query: np.ndarray, name: np.ndarray, floor: np.ndarray) -> pd.DataFrame:
    """(whole, token, covered) of folded queries and names. Equal pairs are measured once."""
    n = len(query)
    whole = jaro_winkler_pairs(query, name)
    qs, ns = [q.split() for q in query], [c.split() for c in name]
    left, right, pair, word = [], [], [], []
    for i, (q, c) in enumerate(zip(qs, ns)):
        for w, x in enumerate(q):
            left += [x] * len(c)
            right += c
            pair += [i] * len(c)
            word += [w] * len(c)
    token, covered = np.zeros(n), np.zeros(n, np.int64)
    if left:
        lr = pd.MultiIndex.from_arrays([left, right])
        code, distinct = lr.factorize()
        score = jaro_winkler_pairs(np.array(distinct.get_level_values(0), object), np.array(distinct.get_level_values(1), object))[code]
        p, w = np.array(pair), np.array(word)
        np.maximum.at(token, p, score)
        most = pd.Series(score).groupby([p, w]).max()
        at = most.index.get_level_values(0).to_numpy()
        covered = np.bincount(at, most.to_numpy() >= floor[at], n).astype(np.int64)
    return pd.DataFrame({"whole": whole, "token": token, "covered": covered})


@F.pandas_udf(MEASURES)
def measures(query: pd.Series, name: pd.Series, floor: pd.Series) -> pd.DataFrame:
    """Whole-string score, best score of a pair of tokens, and how many query tokens have one at the floor."""
    return measure(query.to_numpy(object), name.to_numpy(object), floor.to_numpy(float))


def admitted(query: Column, name: Column, n_tokens: Column, m: Column, floor: Column) -> Column:
    """Whether a candidate explains enough of a query: as a whole at a like length, or by half of its tokens."""
    whole = (m["whole"] >= floor) & (length_ratio(query, name) >= LEAST_RATIO)
    return whole | ((m["token"] >= floor) & (m["covered"] * 2 >= n_tokens))
