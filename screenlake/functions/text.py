"""Folding and tokens, wholly in the JVM.

Spark has no compatibility decomposition. But a folded name holds only ``a-z0-9`` and blanks, so the decomposition of
each character can be worked out here once: characters that fold to one sign are a ``translate``, and the few that fold
to several are looked up one by one, only in rows that hold one.
"""

from __future__ import annotations

import functools
import sys
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sign(c: str) -> str:
    """What one character adds to a folded name, before blanks are put together."""
    out = []
    for d in unicodedata.normalize("NFKD", c):
        if not 0x300 <= ord(d) <= 0x36F:
            low = d.lower()
            out.append(low if len(low) == 1 and ("a" <= low <= "z" or "0" <= low <= "9") else " ")
    return "".join(out)


@functools.cache
def _tables() -> tuple[str, str, str, dict[str, str]]:
    """(characters that become one sign, those signs, characters that vanish, those that become several)."""
    one, to, none, several = [], [], [], {}
    for i in range(sys.maxunicode + 1):
        if 0xD800 <= i <= 0xDFFF or 0xAC00 <= i <= 0xD7A3:
            continue
        c = chr(i)
        s = _sign(c)
        if s == c or not s.strip() and s:
            continue
        if not s:
            none.append(c)
        elif len(s) == 1:
            one.append(c), to.append(s)
        else:
            several[c] = s
    return "".join(one), "".join(to), "".join(none), several


def fold_text(raw: str | None) -> str | None:
    """``fold`` of one Python string, for single queries and tests."""
    return None if raw is None else " ".join("".join(map(_sign, raw)).split())


def fold(raw: Column) -> Column:
    """Compatibility-decomposed, without accents, lower case, everything but ``a-z0-9`` a blank, blanks put together."""
    one, to, none, several = _tables()
    signs = F.str_to_map(F.lit("\x02".join(f"{c}\x01{s}" for c, s in several.items())), F.lit("\x02"), F.lit("\x01"))
    wide = F.array_join(F.transform(F.split(raw, ""), lambda c: F.coalesce(signs[c], c)), "")
    # A hash lookup a character tells whether there are any; a pattern would try each of them in turn.
    spelt = F.when(F.translate(raw, "".join(several), "") != raw, wide).otherwise(raw)
    return F.trim(F.regexp_replace(F.translate(spelt, one + none, to), "[^a-z0-9]+", " "))


def tokens(folded: Column) -> Column:
    """The words of a folded name."""
    return F.filter(F.split(folded, " "), lambda t: t != "")


def prefix_keys(words: Column) -> Column:
    """Distinct first three characters of words, where at least two are there."""
    return F.array_distinct(F.filter(F.transform(words, lambda t: F.substring(t, 1, 3)), lambda p: F.length(p) >= 2))


def grams(folded: Column) -> Column:
    """All distinct 2- and 3-character pieces of a folded name: what a prefix key can be found by."""
    piece = lambda n: F.when(F.length(folded) >= n, F.transform(F.sequence(F.lit(1), F.length(folded) - n + 1), lambda i: F.substr(folded, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(piece(2), piece(3)))


def length_ratio(a: Column, b: Column) -> Column:
    """The shorter length over the longer; 1 for two empty names."""
    most = F.greatest(F.length(a), F.length(b))
    return F.when(most == 0, 1.0).otherwise(F.least(F.length(a), F.length(b)) / most)


def usable(name: Column) -> Column:
    """A name that isn't blank and has no replacement character."""
    return F.coalesce((F.trim(name) != "") & ~F.contains(name, F.lit("�")), F.lit(False))


def blank_to_null(value: Column) -> Column:
    return F.nullif(F.trim(value), F.lit(""))
