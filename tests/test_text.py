import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from screenlake.functions.phonetic import name_key
from screenlake.functions.similarity import jaro_pairs, jaro_winkler_pairs, measure
from screenlake.functions.text import fold, fold_text, grams, prefix_keys, tokens

FOLDS = {"Müller-Schmidt, GmbH": "muller schmidt gmbh", "  José  Peña  ": "jose pena", "O'Brien & Sons, Inc.": "o brien sons inc", "---": "", "Straße": "stra e", "Øre Łódź": "re odz", "ﬁnance": "finance", "½": "1 2", "": "", "İstanbul": "istanbul", "Ｆｕｌｌ": "full", "Иван": "", "𝐁old": "bold", "①st": "1st", "ǆ": "dz"}
KEYS = {"ivan testovich volkov": "AFN TSTFX FLKF", "ivan wolkow": "AFN ALK", "fictional trading company llc": "FKTNL TRTNK KMPN LK", "katarina beispiel": "KTRN PSPL", "katarina example": "KTRN AKSMPL", "catherine pyotrov": "K0RN PTRF", "imaginary front organisation": "AMJNR FRNT ARKNSTN", "van der berg shipping": "FN TR PRK XPNK", "aurelio ferdinand castellanos": "ARL FRTNNT KSTLNS", "mohammed": "MHMT", "muhammad": "MHMT", "geoff": "JF", "jeff": "JF", "7": "", "scheme": "SKM"}


@pytest.mark.parametrize(("raw", "want"), FOLDS.items())
def test_fold_of_strings(raw, want):
    assert fold_text(raw) == want


def test_fold_in_spark_is_that_of_strings(spark):
    rows = [(x,) for x in [*FOLDS, None]]
    got = spark.createDataFrame(rows, "x string").select("x", fold(F.col("x")).alias("f")).collect()
    assert [r.f for r in got] == [fold_text(r.x) for r in got]


def test_tokens_prefixes_and_pieces(spark):
    row = spark.createDataFrame([("a de dexter",)], "x string").select(tokens(F.col("x")).alias("t"), prefix_keys(tokens(F.col("x"))).alias("p"), grams(F.lit("abca")).alias("g"), grams(F.lit("a")).alias("one"), tokens(F.lit("")).alias("none")).first()
    assert row.t == ["a", "de", "dexter"] and row.p == ["de", "dex"] and set(row.g) == {"ab", "bc", "ca", "abc", "bca"} and row.one == [] and row.none == []


@pytest.mark.parametrize(("name", "key"), KEYS.items())
def test_phonetic_keys(name, key):
    assert name_key(name) == key


@given(st.text("ABCDEFGHIJKLMNOPQRSTUVWXYZ", max_size=12))
def test_phonetic_keys_have_few_signs(word):
    assert set(name_key(word)) <= set("ABCDEFGHIJKLMNOPQRSTUVWXYZ0")


def slow_jaro(a, b):
    if a == b:
        return 1.0
    w = max(0, max(len(a), len(b)) // 2 - 1)
    used, left = [False] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - w), min(len(b), i + w + 1)):
            if not used[j] and b[j] == c:
                used[j] = True
                left.append(c)
                break
    right = [c for c, u in zip(b, used) if u]
    m = len(left)
    if not m:
        return 0.0
    return (m / len(a) + m / len(b) + (m - sum(x != y for x, y in zip(left, right)) / 2) / m) / 3


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.text("abcde ", max_size=14), st.text("abcde ", max_size=40)), min_size=1, max_size=20))
def test_jaro_of_batches(pairs):
    a, b = (np.array([p[i] for p in pairs], object) for i in (0, 1))
    got = jaro_pairs(a, b)
    assert np.allclose(got, [slow_jaro(x, y) for x, y in pairs], atol=1e-12)
    assert ((got >= 0) & (got <= 1)).all() and np.allclose(jaro_winkler_pairs(a, a), 1)


def test_jaro_winkler_goldens():
    want = {("nonexistent", "noni"): 0.8515, ("nicolas maduroo moros", "nicolas"): 0.8667, ("ferdinand aquino delgado", "ferdinand"): 0.875, ("vanderbergshipping", "van der berg shipping"): 0.9667, ("volkov", "volkow"): 0.9333, ("martha", "marhta"): 0.9611, ("abcd", "axyz"): 0.55, ("oo cao", "oo ocoa"): 0.9083, ("", ""): 1, ("", "x"): 0}
    got = jaro_winkler_pairs(np.array([a for a, _ in want], object), np.array([b for _, b in want], object))
    assert np.round(got, 4).tolist() == list(want.values())


def test_coverage_counts_query_tokens():
    q, n = np.array(["zzqxwv nonexistent qqpzm", "ivan volkov qqzzxw", "ann ann"], object), np.array(["noni", "ivan testovich volkov", "ann"], object)
    assert measure(q, n, np.full(3, 0.85))["covered"].tolist() == [1, 2, 2]
