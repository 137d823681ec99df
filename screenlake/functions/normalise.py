"""What publishers write, in one form: dates, addresses, kinds of entities, fragments of markup."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from screenlake.functions.text import blank_to_null


def composed_date(year: Column, month: Column, day: Column) -> Column:
    """``Y``, ``Y-MM`` or ``Y-MM-DD``, as far as parts are known in that order."""
    y, m, d = map(blank_to_null, (year, month, day))
    two = lambda x: F.lpad(x, 2, "0")
    return F.when(y.isNull(), None).when(m.isNull(), y).when(d.isNull(), F.concat_ws("-", y, two(m))).otherwise(F.concat_ws("-", y, two(m), two(d)))


def remark_date(remarks: Column) -> Column:
    """The first day that remarks mention, as written."""
    return F.nullif(F.regexp_extract(remarks, r"(\d{1,2} [A-Za-z]+ \d{4}|\d{4}-\d{2}-\d{2})", 1), F.lit(""))


def joined_address(*parts: Column) -> Column:
    """Parts that aren't blank, with commas; null if all are."""
    return F.nullif(F.concat_ws(", ", *map(blank_to_null, parts)), F.lit(""))


def births(dates: Column, places: Column) -> Column:
    """Dates and places of birth paired by their order, the longer list to its end; pairs of nothing go."""
    none = F.array().cast("array<string>")
    both = F.zip_with(F.coalesce(dates, none), F.coalesce(places, none), lambda d, p: F.struct(d.alias("date"), p.alias("place")))
    return F.filter(both, lambda b: b["date"].isNotNull() | b["place"].isNotNull())


def _mapped(value: Column, table: dict[str, str], other: str = "unknown") -> Column:
    out = F.when(F.lit(False), "")
    for key, to in table.items():
        out = out.when(value == key, to)
    return out.otherwise(other)


def sdn_type(value: Column) -> Column:
    return _mapped(F.lower(F.trim(value)), {"individual": "person", "entity": "organization", "vessel": "vessel", "aircraft": "aircraft"})


def party_type(party: Column, label: Column | None = None) -> Column:
    """By the number of the party's type; the labels vessel and aircraft come first."""
    by_number = _mapped(party, {"1": "person", "2": "organization", "4": "vessel", "5": "organization"})
    if label is None:
        return by_number
    low = F.lower(label)
    return F.when(low == "vessel", "vessel").when(low == "aircraft", "aircraft").otherwise(by_number)


def eu_type(code: Column) -> Column:
    return _mapped(F.lower(F.trim(code)), {"p": "person", "person": "person", "e": "organization", "enterprise": "organization"})


def uk_type(value: Column) -> Column:
    return _mapped(F.lower(F.trim(value)), {"individual": "person", "person": "person", "entity": "organization", "organisation": "organization", "organization": "organization", "ship": "vessel", "vessel": "vessel"})


def fragments(markup: Column, tags: Sequence[str]) -> Column:
    """All complete elements of some names, with or without a namespace; one that the text ends in is left out."""
    names = "|".join(tags)
    return F.regexp_extract_all(markup, F.lit(rf"(?s)<((?:[\w.-]+:)?(?:{names}))(?:\s[^>]*)?>.*?</\1\s*>"), F.lit(0))
