"""Codes, value maps, bins and texts."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from .times import col

MISSING = ("", "NA", "N/A", "null", "NULL")
# Smoking states as recorded, and the class of each.
SMOKING = {
    "Hver dag": "Frequently",
    "Storryger": "Frequently",
    "Aktuel hverdagsryger": "Frequently",
    "Nogle dage": "Rarely",
    "Lejlighedsvis ryger": "Rarely",
    "Aldrig": "Never",
    "Aldrig været ryger": "Never",
    "Tidligere": "Previously",
    "Tidligere ryger": "Previously",
    "Udsat for passiv rygning - aldrig været ryger": "Passive",
    "Ryger, aktuel status ukendt": "Frequently",
}
# Codes of the sexes and the order of flags.
SEX = {"Mand": 0, "Kvinde": 1}
FLAG_ORDER = {"Lav": 1, "Normal": 2, "Høj": 3}
TRUE, FALSE = ("true", "t", "yes", "ja", "1"), ("false", "f", "no", "nej", "0")


def recode(c, mapping: dict) -> Column:
    """The mapped value; values that are not in the map become null."""
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(mapping.items())])[col(c)]


def unmark(c, markers=MISSING) -> Column:
    return F.when(~F.coalesce(col(c).isin(*markers), F.lit(False)), col(c))


def boolean(c) -> Column:
    text = F.lower(F.trim(col(c).cast("string")))
    return F.when(text.isin(*TRUE), F.lit(True)).when(text.isin(*FALSE), F.lit(False))


def normal_code(c) -> Column:
    """Trimmed and upper-cased; texts that stand for null become null."""
    code = F.upper(F.trim(col(c)))
    return F.when(~code.isin("", "NAN", "NONE", "NULL", "NA", "<NA>"), code)


# How codes look in descriptions, and the short form of one.
EMBEDDED = r"\bD[A-Z]{1,3}[0-9]{1,6}[A-Z]{0,3}\b"
SHORT = r"^([A-Za-z]{2}[0-9]{2})"


def embedded_code(c) -> Column:
    """The first D + 1-3 letters + 1-6 digits + 0-3 letters of a description; brackets and dashes separate."""
    spaced = F.regexp_replace(col(c), r"[()\[\]{}\-–]", " ")
    found = F.regexp_extract(spaced, EMBEDDED, 0)
    return F.when(found != "", found)


def short_code(c) -> Column:
    found = F.regexp_extract(col(c), SHORT, 1)
    return F.when(found != "", found)


def rolled_up(c, width: int = 4, sep: str = ",") -> Column:
    """Each token of a joined list cut to its first width characters; distinct, sorted, joined again."""
    tokens = F.filter(F.transform(F.split(col(c), sep), lambda t: F.substring(F.trim(t), 1, width)), lambda t: t != "")
    return F.array_join(F.array_sort(F.array_distinct(tokens)), sep)


def binned(c, cuts: list[float], labels: list[str], right: bool = True) -> Column:
    """The label of the interval between two cuts that holds the value, closed on its right or left; outside: null."""
    out = None
    for lo, hi, label in zip(cuts[:-1], cuts[1:], labels, strict=True):
        inside = ((col(c) > lo) & (col(c) <= hi)) if right else ((col(c) >= lo) & (col(c) < hi))
        out = F.when(inside, F.lit(label)) if out is None else out.when(inside, F.lit(label))
    return out
