"""Measurement series: lags, leads, running statistics, regressions. All share one window, so one sort."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.times import days, years


def _w(key: str, ts: str, tie: str | None):
    return Window.partitionBy(key).orderBy(ts, *([tie] if tie else []))


def _running(key: str, ts: str, tie: str | None):
    return _w(key, ts, tie).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def index_by_median(df: DataFrame, key: str, height_cm: str, weight_g: str, lo: float = 100, hi: float = 220) -> DataFrame:
    """df with height_median (of the key) and mass_index; keys with an implausible median height are dropped."""
    out = df.withColumn("height_median", F.percentile(height_cm, 0.5).over(Window.partitionBy(key)))
    out = out.where(F.col("height_median").between(lo, hi))
    return out.withColumn("mass_index", F.col(weight_g) * 0.001 / F.pow(F.col("height_median") * 0.01, F.lit(2)))


def steps(df: DataFrame, key: str, ts: str, value: str, tie: str | None = None, rise: float = 0.05) -> DataFrame:
    """df with the row's number, changes since the previous and to the next row, and whether the next rises by `rise`."""
    w = _w(key, ts, tie)
    v = F.col(value)
    ahead = F.lead(value).over(w)
    return df.withColumns(
        {
            "n_before": (F.row_number().over(w) - 1).cast("long"),
            "days_since": days(F.col(ts), F.lag(ts).over(w)),
            "change_since": v - F.lag(value).over(w),
            "days_to_next": days(F.lead(ts).over(w), F.col(ts)),
            "change_to_next": ahead - v,
            "share_to_next": F.try_divide(ahead - v, v),
            "rises_next": F.coalesce(F.try_divide(ahead - v, v) >= rise, F.lit(False)),
        }
    )


def running_variance(df: DataFrame, key: str, ts: str, value: str, tie: str | None = None) -> DataFrame:
    return df.withColumn("variance_so_far", F.var_samp(value).over(_running(key, ts, tie)))


def from_first(df: DataFrame, key: str, ts: str, value: str, tie: str | None = None) -> DataFrame:
    first = F.first(value).over(_running(key, ts, tie))
    return df.withColumns({"change_from_first": F.col(value) - first, "percent_from_first": F.try_divide((F.col(value) - first) * 100, first)})


def step_extremes(df: DataFrame, key: str, ts: str, value: str, tie: str | None = None) -> DataFrame:
    out = df.withColumn("_step", F.col(value) - F.lag(value).over(_w(key, ts, tie)))
    return out.withColumns({"largest_step": F.max("_step").over(_running(key, ts, tie)), "smallest_step": F.min("_step").over(_running(key, ts, tie))}).drop("_step")


def slope_since(df: DataFrame, key: str, ts: str, value: str, tie: str | None = None) -> DataFrame:
    """Slope per year since the previous row, null without time between, and whether it rises."""
    w = _w(key, ts, tie)
    gap = years(F.col(ts), F.lag(ts).over(w))
    slope = F.when(gap > 0, (F.col(value) - F.lag(value).over(w)) / gap)
    return df.withColumn("slope", slope).withColumn("slope_up", F.coalesce(F.col("slope") > 0, F.lit(False)))


def direction(df: DataFrame, key: str, ts: str, value: str, tie: str | None = None) -> DataFrame:
    """1 for a rise since the previous row, 0 else, null for the first; and the rate per day with its class."""
    w = _w(key, ts, tie)
    change = F.col(value) - F.lag(value).over(w)
    out = df.withColumn("direction", F.when(change.isNotNull(), (change > 0).cast("int"))).withColumn("rate", F.try_divide(change, days(F.col(ts), F.lag(ts).over(w))))
    return out.withColumn("rate_class", F.when(F.col("rate").isNotNull(), (F.col("rate") > 0).cast("int")))


def running_regression(df: DataFrame, key: str, ts: str, value: str, tie: str | None = None) -> DataFrame:
    """Least squares of value on years since the key's first row, over the rows so far: slope_year, intercept, r_squared.

    Null below two rows or without spread in time; r_squared also without spread in value.
    """
    run = _running(key, ts, tie)
    out = df.withColumn("_x", years(F.col(ts), F.first(ts).over(run))).withColumn("_y", F.col(value).cast("double"))
    out = out.withColumns({f"_{k}": f.over(run) for k, f in {"n": F.count("_y"), "sx": F.sum("_x"), "sy": F.sum("_y"), "xx": F.sum(F.col("_x") * F.col("_x")), "xy": F.sum(F.col("_x") * F.col("_y")), "yy": F.sum(F.col("_y") * F.col("_y"))}.items()})
    n = F.col("_n")
    out = out.withColumns({"_cxx": F.col("_xx") - F.col("_sx") * F.col("_sx") / n, "_cxy": F.col("_xy") - F.col("_sx") * F.col("_sy") / n, "_cyy": F.col("_yy") - F.col("_sy") * F.col("_sy") / n})
    ok = (n >= 2) & (F.col("_cxx") > 1e-12)
    out = out.withColumn("slope_year", F.when(ok, F.col("_cxy") / F.col("_cxx")))
    out = out.withColumn("intercept", F.when(ok, (F.col("_sy") - F.col("slope_year") * F.col("_sx")) / n))
    out = out.withColumn("r_squared", F.when(ok & (F.col("_cyy") > 1e-9), F.col("_cxy") * F.col("_cxy") / (F.col("_cxx") * F.col("_cyy"))))
    return out.drop(*[c for c in out.columns if c.startswith("_")])


def filled_forward(df: DataFrame, key: str, ts: str, columns: list[str]) -> DataFrame:
    run = _running(key, ts, None)
    return df.withColumns({c: F.last(c, ignorenulls=True).over(run) for c in columns})


def rolling_mean(df: DataFrame, x: str, value: str, width: int = 6) -> DataFrame:
    """Means of value by x, and their mean over the last width values of x. x should have few values, such as ages."""
    per = df.groupBy(x).agg(F.avg(value).alias("mean"))
    return per.withColumn("rolling", F.avg("mean").over(Window.orderBy(x).rowsBetween(1 - width, 0)))
