"""Ranks and exact quantiles without a task that sorts everything."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def value_counts(df: DataFrame, value: str, group: tuple[str, ...] = (), sums: dict | None = None, buckets: int = 32, place: Column | None = None, few: bool = False) -> DataFrame:
    """One row per (group, value): n, below (rows of the group with smaller values), total; null values are left out.

    sums: further aggregates by name; each also gets <name>_below, its sum over smaller values, and <name>_total.
    place: the value as a double that is never out of order, where it is no number itself. Values are dealt over buckets
    by approximate quantiles, one small row that is broadcast (few: a row for each group, where groups are few, as
    columns are); sums run within a bucket, and the buckets' totals, a few rows for each group, are added. Ties come for
    free, as a value is one row. Nothing runs before the result is asked for.
    """
    held = df.where(F.col(value).isNotNull())
    counts = held.groupBy(*group, value).agg(F.count("*").alias("n"), *[a.alias(k) for k, a in (sums or {}).items()])
    shares = [i / buckets for i in range(1, buckets)]
    at = F.col(value).cast("double") if place is None else place
    cuts = held.groupBy(*(group if few else ())).agg(F.percentile_approx(at, shares, 1000).alias("_cuts"))
    counts = counts.join(F.broadcast(cuts), [*group]) if few else counts.crossJoin(F.broadcast(cuts))
    bucket = F.size(F.filter(F.array_distinct("_cuts"), lambda e: e < at))
    names = ["n", *(sums or {})]
    inner = Window.partitionBy(*group, "_b").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    rows = counts.withColumn("_b", bucket).drop("_cuts")
    per = rows.groupBy(*group, "_b").agg(*[F.sum(k).alias(f"_{k}") for k in names])
    outer = Window.partitionBy(*(group or [F.lit(1)])).orderBy("_b")
    whole = Window.partitionBy(*(group or [F.lit(1)]))
    for k in names:
        per = per.withColumn(f"_{k}_before", F.sum(f"_{k}").over(outer) - F.col(f"_{k}")).withColumn(f"_{k}_all", F.sum(f"_{k}").over(whole))
    for k in names:
        rows = rows.withColumn(f"_{k}_in", F.coalesce(F.sum(k).over(inner), F.lit(0)))
    same = F.col("r._b") == F.col("p._b")
    for g in group:
        same &= F.col(f"r.{g}").eqNullSafe(F.col(f"p.{g}"))
    below = lambda k: (F.col(f"r._{k}_in") + F.col(f"p._{k}_before"))
    out = [F.col(f"r.{c}") for c in [*group, value, *names]]
    for k in names:
        out += [below(k).alias("below" if k == "n" else f"{k}_below"), F.col(f"p._{k}_all").alias("total" if k == "n" else f"{k}_total")]
    return rows.alias("r").join(per.alias("p"), same).select(*out)


def quantiles(df: DataFrame, value: str, shares: dict[str, float], group: tuple[str, ...] = (), size: str | None = None, accuracy: int = 10_000) -> DataFrame:
    """Exact quantiles, linear between neighbours, as columns named by the keys of shares; one row per group.

    Selection by narrowing: one pass brackets each wanted rank by approximate quantiles of its group, whose error is
    bounded; a second counts what lies below a bracket and keeps the values within it, a few in ten thousand, and only
    these are sorted. Groups of up to 2 * accuracy values are their own bracket. df is read twice: write what is dear to
    compute. size: a name for the number of values of the group.
    """
    held = df.where(F.col(value).isNotNull()).select(*group, F.col(value).cast("double").alias("_v"))
    slack = 3 / accuracy
    ends = [max(0.0, min(1.0, q + way * slack)) for q in shares.values() for way in (-1, 1)]
    brackets = held.groupBy(*group).agg(F.count("*").alias("_n"), F.percentile_approx("_v", ends, accuracy).alias("_b"))

    # NaN lies above all else.
    end = lambda i: F.lit(float("nan" if i % 2 else "-inf")) if ends[i] in (0.0, 1.0) else F.col("_b")[i]
    brackets = brackets.select(*group, "_n", (F.col("_n") <= 2 * accuracy).alias("_whole"), *[end(i).alias(f"_b{i}") for i in range(len(ends))])
    if group:
        same = F.lit(True)
        for g in group:
            same &= F.col(f"r.`{g}`").eqNullSafe(F.col(f"b.`{g}`"))
        rows = held.alias("r").join(brackets.alias("b"), same).select("r.*", "b._n", "b._whole", *[f"b._b{i}" for i in range(len(ends))])
    else:
        rows = held.crossJoin(F.broadcast(brackets))  # one row
    # What lies below a bracket is one row of a task, with no value. Cells of a whole group, -1, are of use to all shares.
    whole = F.when(F.col("_whole"), F.struct(F.lit(-1).alias("j"), F.col("_v").alias("v")))
    cell = lambda j: F.when(~F.col("_whole") & (F.col("_v") <= F.col(f"_b{2 * j + 1}")), F.struct(F.lit(j).alias("j"), F.when(F.col("_v") >= F.col(f"_b{2 * j}"), F.col("_v")).alias("v")))
    cells = rows.select(*group, "_n", F.explode(F.array(whole, *[cell(j) for j in range(len(shares))])).alias("e")).where("e IS NOT NULL")
    cells = cells.groupBy(*group, F.col("e.j").alias("_j"), F.col("e.v").alias("_v")).agg(F.count("*").alias("_c"), F.max("_n").alias("_n"))
    below = Window.partitionBy(*group, "_j").orderBy(F.asc_nulls_first("_v")).rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("_below", F.coalesce(F.sum("_c").over(below), F.lit(0)))
    aggs = [F.max("_n").alias(size)] if size else []
    for j, (k, q) in enumerate(shares.items()):
        p = q * (F.col("_n") - 1)
        nth = lambda position, j=j: F.max(F.when(F.col("_j").isin(j, -1) & (F.col("_below") <= position) & (position < F.col("_below") + F.col("_c")), F.col("_v")))
        aggs += [nth(F.floor(p)).alias(f"_{k}_lo"), nth(F.ceil(p)).alias(f"_{k}_hi"), F.max(p - F.floor(p)).alias(f"_{k}_w")]
    wide = cells.groupBy(*group).agg(*aggs)
    return wide.select(*group, *([size] if size else []), *[(F.col(f"_{k}_lo") + (F.col(f"_{k}_hi") - F.col(f"_{k}_lo")) * F.col(f"_{k}_w")).alias(k) for k in shares])
