"""A reduced Double Metaphone: one key a word, spelt out as rules.

A rule is (pattern at the current letter, pattern that the letters before must end with, code, letters used); the first
that holds is applied. Letters without a rule are skipped.
"""

from __future__ import annotations

import functools
import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

V = "[AEIOUY]"


def _rules(text: str) -> list[tuple[re.Pattern, re.Pattern | None, str, int]]:
    out = []
    for line in text.strip().splitlines():
        ahead, behind, code, used = line.split()
        out.append((re.compile(ahead), None if behind == "*" else re.compile(f"(?:{behind})$"), "" if code == "-" else code, int(used)))
    return out


#: In a pattern for what is behind, ^ is the start of the word.
_TABLE: dict[str, list[tuple[re.Pattern, re.Pattern | None, str, int]]] = {}
for _c in "AEIOUY":
    _TABLE[_c] = _rules(". ^ A 1\n. * - 1")
for _c, _k in zip("BFJKLMNQRVZ", "PFJKLMNKRFS"):
    _TABLE[_c] = _rules(f"{_c}{_c} * {_k} 2\n. * {_k} 1")
_TABLE["D"] = _rules("DG[IEY] * J 3\nDG * J 2\nD[TD] * T 2\n. * T 1")
_TABLE["H"] = _rules(f"H{V} ^|{V} H 2\n. * - 1")
_TABLE["P"] = _rules("PH * F 2\nPP * P 2\n. * P 1")
_TABLE["T"] = _rules("T?TH * 0 2\nTC * - 1\nTT * T 2\n. * T 1")
_TABLE["W"] = _rules(f"WH * A 2\nW{V} * A 1\n. * - 1")
_TABLE["X"] = _rules("X[CX] * KS 2\n. * KS 1")
# ACH after a consonant, learned beginnings, then CH by its neighbours.
_TABLE["C"] = _rules(
    r"""
CH [^AEIOUY]A K 2
CAESAR ^ S 2
CHIA * K 2
CHAE .+ K 2
CH(?!ORE)(?:ARAC|ARIS|OR|YM|IA|EM) ^ K 2
CH ^SCH.* K 2
CHES .*OR K 2
CHIT .*AR K 2
CHID .*OR K 2
CH[TS] * K 2
CH[LRNMBHFVW] ^|[AOUE] K 2
CH ^M|^MC.* K 2
CH * X 2
"""
)
_TABLE["S"] = _rules(
    r"""
SL [IY] - 1
SUGAR ^ X 1
SH(?:EIM|OEK|OLM|OLZ) * S 2
SH * X 2
SI[OA] * S 3
SZ * S 2
S[MNLW] ^ S 1
SCH(?:OO|ER|EN|UY|ED|EM) * SK 3
SCH * X 3
SC[IEY] * S 3
SC * SK 3
SS * S 2
. * S 1
"""
)
_C_REST = _rules(
    r"""
CZ (?<!WI) S 2
CCIA * X 3
CC[IE] ^(?!M$).* KS 3
CCH(?!U) ^(?!M$).* KS 3
CC ^(?!M$).* K 2
C[KGQ] * K 2
C[IEY] * S 2
CC(?![EI]) * K 2
. * K 1
"""
)
_TABLE["C"] += _C_REST
_SLAVIC = re.compile("W|K|CZ")
_G = _rules(
    r"""
GH [^AEIOUY] K 2
GHI ^ J 2
GH ^ K 2
GH [BHD].|[BHD]..|.*[BH]... - 2
GH [CGLRT].U F 2
GH [^I] K 2
GH * - 2
"""
)
_GN = _rules("GN ^[AEIOUY] KN 2\nGN(?!EY) * N 2\nGN * KN 2\nGLI * KL 2")
_GN_SLAVIC = _rules("GN * KN 2")
_G_REST = _rules(
    r"""
G(?:Y|ES|EP|EB|EL|EY|IB|IL|IN|IE|EI|ER) ^ K 2
"""
)
_G_SOFT = _rules("G(?:ER|Y) ^|[^EI] K 2")
_G_LAST = _rules("G[EIY] ^SCH.* K 2\nGET * K 2\nG[EIY] * J 2\nGGI ^SCH.*[AO] K 2\nGGI [AO] J 2\nGG * K 2\n. * K 1")


def _for_g(word: str, at: int) -> list[tuple[re.Pattern, re.Pattern | None, str, int]]:
    gn = _GN_SLAVIC if _SLAVIC.search(word) else _GN
    soft = [] if re.match("[DRM]ANGER", word) or word[max(0, at - 1) : at + 2] in ("RGY", "OGY") else _G_SOFT
    return [*_G, *gn, *_G_REST, *soft, *_G_LAST]


@functools.lru_cache(1 << 16)
def word_key(word: str) -> str:
    """The key of one word; letters only count."""
    s = re.sub("[^A-Z]", "", word.upper())
    out, at = [], 1 if re.match("GN|KN|PN|WR|PS", s) else 0
    if s[:1] == "X":
        out.append("S")
        at = 1
    while at < len(s):
        for ahead, behind, code, used in _for_g(s, at) if s[at] == "G" else _TABLE[s[at]]:
            if ahead.match(s, at) and (behind is None or behind.search(s[:at])):
                out.append(code)
                at += used
                break
        else:
            at += 1
    return "".join(out)


def name_key(folded: str | None) -> str | None:
    """Keys of the words, words without one left out."""
    return None if folded is None else " ".join(filter(None, map(word_key, folded.split())))


@F.pandas_udf(StringType())
def phonetic(folded: pd.Series) -> pd.Series:
    """Each distinct word of a batch is spelt out once."""
    names = folded.dropna().unique()
    keys = {w: word_key(w) for w in {w for n in names for w in n.split()}}
    whole = {n: " ".join(filter(None, map(keys.__getitem__, n.split()))) for n in names}
    return folded.map(whole, na_action="ignore").astype(object).where(folded.notna(), None)
