"""Free-text dosing schedules to categories, and categories to times per day."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .times import col

# Danish number words; "to" and "ti" are numbers before a counted noun only.
NUMBERS = {"nul": 0, "en": 1, "én": 1, "et": 1, "tre": 3, "fire": 4, "fem": 5, "seks": 6, "syv": 7, "otte": 8, "ni": 9, "elleve": 11, "tolv": 12, "tretten": 13, "fjorten": 14, "femten": 15, "seksten": 16, "sytten": 17, "atten": 18, "nitten": 19, "tyve": 20}
# What is counted, periods, units, days of the week, times of day and the days of a unit.
COUNTED = "gang|gange|tablet|tabletter|kapsel|kapsler|time|timer|dag|dage|uge|uger|måned|måneder|år"
PERIODS = {"daily": "dagligt|daglig|om dagen", "weekly": "ugentligt|om ugen", "monthly": "månedligt|om måneden", "yearly": "årligt|om året"}
UNITS = {"hour(s)": "timer?", "day(s)": "dage?", "week(s)": "uger?", "month(s)": "måned(?:er)?", "year(s)": "år"}
WEEKDAYS = ("mandag|man|ma", "tirsdag|tir|ti", "onsdag|ons|on", "torsdag|tor|to", "fredag|fre|fr", "lørdag|lør|lø", "søndag|søn|sø")
TIMES_OF_DAY = "tidlig morgen|sen eftermiddag|før sengetid|morgen|middag|aften|nat"
DAYS = {"day(s)": 1.0, "week(s)": 7.0, "month(s)": 30.0, "year(s)": 365.25}

# Java's \b and \w follow Unicode only with (?U).
_U = "(?U)"


def _first(text: Column, pattern: str) -> Column:
    found = F.regexp_extract(text, _U + pattern, 1)
    return F.when(found != "", found)


def cleaned(c) -> Column:
    text = F.lower(F.trim(col(c)))
    text = F.trim(F.regexp_replace(F.regexp_replace(text, _U + r"[^\w\s]", " "), _U + r"\s+", " "))
    for word, n in NUMBERS.items():
        text = F.regexp_replace(text, rf"{_U}\b{word}\b", str(n))
    for word, n in (("to", 2), ("ti", 10)):
        text = F.regexp_replace(text, rf"{_U}\b{word}\b(?=\s+({COUNTED}))", str(n))
    return text


def category(c) -> Column:
    """as needed, daily n, weekly n, monthly n, yearly n, once only, continuous, every n unit(s), unspecified [n].

    The first rule that fits decides: need, a stated maximum, counts per period, once, continuous, every n units,
    named weekdays, named times of day, plain daily.
    """
    text = cleaned(c)
    rules = []
    for lead in ("højst ([0-9]+) gange ", "([0-9]+) gange ", "([0-9]+) gang "):
        for name, words in PERIODS.items():
            rules.append(F.concat(F.lit(name + " "), _first(text, rf"{lead}(?:{words})")))
        if lead.startswith("højst"):
            rules.append(F.concat(F.lit("unspecified "), _first(text, "højst ([0-9]+) gange")))
    rules.append(F.when(text.contains("kun 1"), F.lit("once only")))
    rules.append(F.when(text.contains("kontinuerligt"), F.lit("continuous")))
    any_unit = "|".join(UNITS.values())
    at = _first(text, rf"(hver\s+[0-9]+\s*(?:{any_unit}))")
    number = F.regexp_extract(at, "([0-9]+)", 1)
    for name, words in UNITS.items():
        rules.append(F.when(at.rlike(rf"{_U}[0-9]\s*(?:{words})$"), F.concat(F.lit("every "), number, F.lit(" " + name))))
    named = sum((F.coalesce(text.rlike(rf"{_U}\b(?:{words})\b").cast("int"), F.lit(0)) for words in WEEKDAYS), F.lit(0))
    rules.append(F.when(named > 0, F.concat(F.lit("weekly "), named.cast("string"))))
    times = F.coalesce(F.regexp_count(text, F.lit(rf"{_U}\b(?:{TIMES_OF_DAY})\b")), F.lit(0))
    rules.append(F.when(times > 0, F.concat(F.lit("daily "), times.cast("string"))))
    rules.append(F.when(text.isin("dagligt", "daglig"), F.lit("daily 1")))
    blank = col(c).isNull() | text.isin("", "nan", "none", "null", "na")
    return F.when(blank, F.lit("unspecified")).when(text.contains("behov"), F.lit("as needed")).otherwise(F.coalesce(*rules, F.lit("unspecified")))


def times_per_day(c) -> Column:
    """Times per day of a category; null where it has no fixed rate."""

    def number(lead: str) -> Column:
        return F.regexp_extract(col(c), f"^{lead}", 1).try_cast("double")

    fixed = [number(rf"{name} ([0-9]+)") / per for name, per in (("daily", 1.0), ("weekly", 7.0), ("monthly", 30.0), ("yearly", 365.25))]
    every = [F.try_divide(F.lit(1.0), number(rf"every ([0-9]+) {unit.replace('(', chr(92) + '(').replace(')', chr(92) + ')')}") * n) for unit, n in DAYS.items()]
    hours = F.try_divide(F.lit(24.0), number(r"every ([0-9]+) hour\(s\)"))
    return F.coalesce(*fixed, hours, *every)
