"""Typing, missing values, filters and duplicates."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import coding, ranks
from ..functions.times import YEAR_DAYS, days


@dataclass(frozen=True)
class Roles:
    """Which columns of a table hold what; columns that are absent are passed over."""

    numeric: tuple[str, ...] = ()
    instant: tuple[str, ...] = ()
    category: tuple[str, ...] = ()
    boolean: tuple[str, ...] = ()
    markers: tuple[str, ...] = coding.MISSING


def typed(df: DataFrame, roles: Roles) -> DataFrame:
    """df with its columns coerced by role, after markers of missing values became null; what doesn't parse is null."""

    def one(c: str) -> Column:
        text = isinstance(df.schema[c].dataType, T.StringType)
        source = coding.unmark(c, roles.markers) if text else F.col(c)
        if c in roles.numeric:
            source = source.try_cast("double")
        elif c in roles.instant:
            source = (F.try_to_timestamp(source) if text else source).cast("timestamp_ntz")
        elif c in roles.category:
            source = source.cast("string")
        elif c in roles.boolean:
            source = coding.boolean(source)
        return source.alias(c)

    return df.select(*[one(c) for c in df.columns])


def within(df: DataFrame, ts: str, lo: str, hi: str) -> DataFrame:
    """Rows whose instant lies in [lo, hi); plain comparisons, so they reach the scan."""
    return df.where((F.col(ts) >= F.lit(lo).cast(df.schema[ts].dataType)) & (F.col(ts) < F.lit(hi).cast(df.schema[ts].dataType)))


def of_age(df: DataFrame, ts: str, born: str, lo: float = 18, hi: float = 120) -> DataFrame:
    return df.where((days(ts, born) / YEAR_DAYS).between(lo, hi))


def in_code_range(df: DataFrame, code: str, value: str, ranges: DataFrame) -> DataFrame:
    """ranges: (code, lo, hi). Rows of a code in it must lie in its range, a null value fails; others pass."""
    bounds = ranges.select(F.col("code").alias("_code"), "lo", "hi")
    rows = df.join(bounds, F.col(code) == F.col("_code"), "left")
    return rows.where(F.col("lo").isNull() | F.coalesce(F.col(value).between(F.col("lo"), F.col("hi")), F.lit(False))).drop("_code", "lo", "hi")


def without_tails(df: DataFrame, value: str, lo: float = 0.001, hi: float = 0.999, approximate: bool = False) -> DataFrame:
    """Rows strictly between two quantiles of the whole column; approximate ones need no sort of the values."""
    if approximate:
        cut = df.agg(F.percentile_approx(value, lo, 10_000).alias("_lo"), F.percentile_approx(value, hi, 10_000).alias("_hi"))
    else:
        cut = ranks.quantiles(df, value, {"_lo": lo, "_hi": hi})
    # One row of two numbers.
    return df.join(F.broadcast(cut)).where((F.col(value) > F.col("_lo")) & (F.col(value) < F.col("_hi"))).drop("_lo", "_hi")


def without_iqr_outliers(df: DataFrame, value: str, group: str) -> DataFrame:
    """Rows of each group within 1.5 interquartile ranges of its quartiles, ends included."""
    cut = ranks.quantiles(df, value, {"_q1": 0.25, "_q3": 0.75}, (group,))
    reach = 1.5 * (F.col("_q3") - F.col("_q1"))
    return df.join(cut, group).where(F.col(value).between(F.col("_q1") - reach, F.col("_q3") + reach)).drop("_q1", "_q3")


def with_enough(df: DataFrame, key: str, value: str, least: int = 1) -> DataFrame:
    return df.withColumn("_n", F.count(value).over(Window.partitionBy(key))).where(F.col("_n") >= least).drop("_n")


def guarded_rate(df: DataFrame, change: str, gap_days: str, limit: float = 0.6) -> DataFrame:
    """df with rate (change per day); rows outside (-limit, limit) or with a gap below a day are dropped."""
    return df.withColumn("rate", F.try_divide(F.col(change), F.col(gap_days))).where((F.col("rate") > -limit) & (F.col("rate") < limit) & (F.col(gap_days) >= 1))


def null_shares(df: DataFrame, columns: list[str]) -> dict[str, float]:
    """Share of nulls by column, in one pass; one row comes to the driver."""
    if not columns:
        return {}
    row = df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in columns]).collect()[0]
    return {c: row[c] if row[c] is not None else 1.0 for c in columns}


def drop_sparse(df: DataFrame, columns: list[str], most_null: float = 0.5) -> DataFrame:
    return df.drop(*[c for c, share in null_shares(df, columns).items() if share > most_null])


def jointly_present(df: DataFrame, columns: list[str]) -> dict[tuple[str, str], int]:
    """Rows in which both columns of a pair have values, for each pair and (c, c), in one pass."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    row = df.agg(*[F.count_if(F.col(a).isNotNull() & F.col(b).isNotNull()).alias(f"c{k}") for k, (a, b) in enumerate(pairs)]).collect()[0]
    return {p: row[f"c{k}"] for k, p in enumerate(pairs)}


def drop_sparse_pairs(df: DataFrame, columns: list[str], least: int = 1000, protected: tuple[str, ...] = ("target",)) -> DataFrame:
    """Drops the sparser column of every pair with fewer than least joint rows (the first of equals), unless protected."""
    n = jointly_present(df, columns)
    bad = {a if n[a, a] <= n[b, b] else b for a, b in n if a != b and n[a, b] < least}
    return df.drop(*[c for c in bad if c not in protected])


def numeric_features(df: DataFrame, excluded_prefixes: tuple[str, ...] = ()) -> DataFrame:
    """The numeric columns whose names begin with none of the prefixes; infinities, NaN and null become 0."""
    kept = [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and not f.name.startswith(excluded_prefixes or ("\0",))]
    infinite = (float("inf"), float("-inf"))
    return df.select(*[F.when(F.isnan(c) | F.col(c).isNull() | F.col(c).cast("double").isin(*infinite), F.lit(0.0)).otherwise(F.col(c).cast("double")).alias(c) for c in kept])


def coalesced(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per keys; each other column has its first non-null value in the given order. Rows with null keys go."""
    rest = [c for c in df.columns if c not in keys]
    rank = F.struct(*order)
    firsts = [F.min_by(F.col(c), F.when(F.col(c).isNotNull(), rank)).alias(c) for c in rest]
    return df.na.drop(subset=keys).dropDuplicates().groupBy(*keys).agg(*firsts)


def first_per_key(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The first row of each key in an order that should have no ties."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_r = 1").drop("_r")


def once(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row of each set of rows that are equal in columns; nulls equal nulls.

    Equal rows lie side by side in one sort by columns, so a task holds that sort's rows, not two hash tables of them
    (before and after a shuffle, or one on the other where no shuffle is needed). A sort spills in order, too.
    """
    w = Window.partitionBy(*columns).orderBy(columns[-1]).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # A rank would be cut before the shuffle too, by one more sort.
    return df.withColumn("_nth", F.count(F.lit(1)).over(w)).where("_nth = 1").drop("_nth")


def binary_columns(df: DataFrame) -> list[str]:
    """Numeric columns that hold 0 and 1 only (and some value), found in one pass."""
    columns = [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]
    if not columns:
        return []
    row = df.agg(*[F.bool_and(F.col(c).isin(0, 1)).alias(c) for c in columns]).collect()[0]
    return [c for c in columns if row[c]]
