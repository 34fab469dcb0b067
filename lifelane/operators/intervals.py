"""Interval series: repair, collapse, overlap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.times import DAY, instant, micros
from .blocks import carry_in, in_blocks
from .cleaning import once
from .history import swept

HOURS_48 = 2 * DAY


def repaired(df: DataFrame, start: str, end: str, administered: str, *, lo: str, hi: str, ongoing: str) -> DataFrame:
    """Rows with a start; a missing end becomes the administration or `ongoing`; an end before the start moves the start.

    Adds has_administration, has_prescription, their counts, and possibly_ongoing, which looks at the ends as given.
    Keeps rows whose start and end both lie in [lo, hi).
    """
    by_hand = F.col(administered).isNotNull()
    out = df.where(F.col(start).isNotNull()).withColumns(
        {
            "has_administration": by_hand,
            "has_prescription": ~by_hand,
            "administrations": by_hand.cast("int"),
            "prescriptions": (~by_hand).cast("int"),
            "possibly_ongoing": F.col(end).isNull() & ~by_hand,
        }
    )
    stamp = lambda text: F.lit(text).cast("timestamp_ntz")
    out = out.withColumn(end, F.coalesce(end, administered, stamp(ongoing))).withColumn(start, F.least(start, end))
    inside = lambda c: (F.col(c) >= stamp(lo)) & (F.col(c) < stamp(hi))
    return out.where(inside(start) & inside(end))


def islands(df: DataFrame, keys: list[str], start: str, end: str, gap: int = HOURS_48, block: int | None = None) -> DataFrame:
    """df with island: the number, within keys, of the run of intervals that lie within gap microseconds of one another.

    One pass: an interval begins an island if it starts more than gap after the latest end before it. Open ends reach
    nobody, so what follows only open intervals begins anew. block: keys of more rows than this are dealt over tasks by
    start; the latest end and the number of islands of earlier blocks are carried in. It takes a count of the keys first.
    """
    rows, blocks = in_blocks(df.withColumns({"_s": micros(start), "_e": micros(end)}), keys, "_s", block)
    w = Window.partitionBy(*keys, *(["_block"] if blocks else [])).orderBy(F.col("_s"), F.col("_e").asc_nulls_last())
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    latest = F.max("_e").over(before)
    if blocks:
        rows = carry_in(rows, keys, blocks, {"_reach": F.max("_e")}, F.max)
        latest = F.greatest(latest, "_reach")
    joined = F.coalesce(F.col("_s") <= latest + gap, F.lit(False))
    rows = rows.withColumn("_new", (~joined).cast("int"))
    island = F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))
    if blocks:
        rows = carry_in(rows, keys, blocks, {"_before": F.sum("_new")}, F.sum)
        island += F.coalesce("_before", F.lit(0))
    return rows.withColumn("island", island).select(*df.columns, "_s", "_e", "island")


def collapse(df: DataFrame, keys: list[str], start: str, end: str, *, gap: int = HOURS_48, aggs: dict[str, Column] | None = None, distinct: bool = True, block: int | None = None) -> DataFrame:
    """One row per island of keys: its start, end, days and the given aggregates.

    distinct: duplicate rows count once; that takes a sort of whole rows, so say False where no aggregate minds them.
    block: see islands(). days: 1 where the island is shorter than a day but not empty, the span in days else; null for open islands.
    """
    rows = islands(once(df, df.columns) if distinct else df, keys, start, end, gap, block)
    out = rows.groupBy(*keys, "island").agg(F.min("_s").alias("_s"), F.max("_e").alias("_e"), *[a.alias(k) for k, a in (aggs or {}).items()])
    span = (F.col("_e") - F.col("_s")) / float(DAY)
    return out.select(*keys, instant("_s").alias(start), instant("_e").alias(end), F.when((span > 0) & (span < 1), F.lit(1.0)).otherwise(span).alias("days"), *(aggs or {}))


def provenance(administered: Column, prescribed: Column) -> Column:
    return F.when(administered & prescribed, F.lit("both")).when(administered, F.lit("administration")).when(prescribed, F.lit("prescription")).otherwise(F.lit("unknown"))


def weighted_mean(value: Column, weight: Column) -> Column:
    """Mean by weight as an aggregate; null where no weight counts."""
    return F.try_divide(F.sum(value * weight), F.sum(F.when(value.isNotNull(), weight)))


def overlapping_codes(df: DataFrame, key: str, code: str, start: str, end: str, ident: str) -> DataFrame:
    """key, ident, codes: the other codes of intervals of the key that run, or end, after this one's start and began before it or with it.

    No self-join on inequalities: see history.swept(). Rows without key, start or code are dropped.
    """
    rows = swept(df.select(key, ident, code, start, end), key, code, start, end, end_inclusive=True, past_inclusive=False, exclude_own=True, starting=False)
    return rows.select(key, ident, F.col("_active").alias("codes"))
