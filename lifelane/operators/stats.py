"""Group comparisons, correlations, trajectories. Ranks and moments come from Spark; only scalars reach the driver."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ranks, student
from ..functions.times import DAY, floor_days, micros
from ..sources.io import written


def mann_whitney(df: DataFrame, value: str, first: Column, group: tuple[str, ...] = ()) -> DataFrame:
    """One row, or one for each group: n1, n2, u (of the rows where first holds), z with tie correction, p (normal), rank_biserial."""
    rows = df.where(F.col(value).isNotNull()).withColumn("_f", F.coalesce(first, F.lit(False)).cast("long"))
    r = ranks.value_counts(rows, value, group, {"f": F.sum("_f")})
    mid = F.col("below") + (F.col("n") + 1) / 2
    sums = r.groupBy(*group).agg(F.sum(F.col("f") * mid).alias("r1"), F.sum("f").alias("n1"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n") * F.col("n") - F.col("n")).cast("double").alias("t"))
    sums = sums.withColumn("n2", F.col("n") - F.col("n1")).withColumn("u", F.col("r1") - F.col("n1") * (F.col("n1") + 1) / 2)
    product = F.col("n1").cast("double") * F.col("n2")
    spread = F.sqrt(product / 12 * (F.col("n") + 1 - F.col("t") / (F.col("n") * (F.col("n") - 1).cast("double"))))
    out = sums.withColumn("z", F.try_divide(F.col("u") - product / 2, spread))
    return out.select(*group, "n1", "n2", "u", "z", normal_p("z").alias("p"), (1 - F.try_divide(2 * F.col("u"), product)).alias("rank_biserial"))


def normal_p(z: str) -> Column:
    """Two-sided normal tail by the rational approximation of erfc (absolute error below 1.2e-7)."""
    x = F.abs(F.col(z)) / math.sqrt(2)
    t = 1 / (1 + 0.5 * x)
    # Coefficients of the approximation.
    poly = F.lit(0.17087277)
    for c in (-0.82215223, 1.48851587, -1.13520398, 0.27886807, -0.18628806, 0.09678418, 0.37409196, 1.00002368, -1.26551223):
        poly = F.lit(c) + t * poly
    return t * F.exp(-x * x + poly)


def welch(df: DataFrame, value: str, first: Column, pooled: bool = False) -> DataFrame:
    """One row: sizes, means, their difference with standard error and 95 % interval (lo, hi), t, degrees of freedom and p."""
    one, two = F.when(first, F.col(value)), F.when(~first, F.col(value))
    m = df.agg(F.count(one).alias("n1"), F.count(two).alias("n2"), F.avg(one).alias("mean1"), F.avg(two).alias("mean2"), F.var_samp(one).alias("v1"), F.var_samp(two).alias("v2"))
    a, b = F.col("v1") / F.col("n1"), F.col("v2") / F.col("n2")
    if pooled:
        v = ((F.col("n1") - 1) * F.col("v1") + (F.col("n2") - 1) * F.col("v2")) / (F.col("n1") + F.col("n2") - 2)
        se, df_ = F.sqrt(v * (1 / F.col("n1") + 1 / F.col("n2"))), (F.col("n1") + F.col("n2") - 2).cast("double")
    else:
        se, df_ = F.sqrt(a + b), (a + b) * (a + b) / (a * a / (F.col("n1") - 1) + b * b / (F.col("n2") - 1))
    out = m.select("n1", "n2", "mean1", "mean2", (F.col("mean1") - F.col("mean2")).alias("difference"), se.alias("standard_error"), F.try_divide(F.col("mean1") - F.col("mean2"), se).alias("t"), df_.alias("df"))
    reach = student.critical(0.05, F.col("df")) * F.col("standard_error")
    return out.withColumns({"p": student.p_value(F.col("t"), F.col("df")), "lo": F.col("difference") - reach, "hi": F.col("difference") + reach})


def compare_groups(df: DataFrame, value: str, first: Column, alpha_limit: float = 5.99) -> DataFrame:
    """Descriptives of both groups and the test that fits: Welch's where both look normal by their moments, else ranks.

    A group looks normal if its Jarque-Bera statistic is below alpha_limit (chi-square, 5 %).
    """
    rows = df.withColumn("_g", F.when(first, "first").otherwise("second"))
    g = rows.groupBy("_g").agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.skewness(value).alias("s"), F.kurtosis(value).alias("k"))
    g = g.join(ranks.quantiles(rows, value, {"median": 0.5}, ("_g",)), "_g", "left")
    g = g.withColumn("jb", F.col("n") / 6 * (F.col("s") * F.col("s") + F.col("k") * F.col("k") / 4))
    normal = g.agg((F.max("jb") < alpha_limit).alias("normal"))
    t = welch(df, value, first).select(F.col("t").alias("welch_t"), "df", F.col("p").alias("welch_p"), "lo", "hi")
    u = mann_whitney(df, value, first).select("u", "z", F.col("p").alias("rank_p"))
    out = g.drop("s", "k").crossJoin(normal).crossJoin(t).crossJoin(u)  # one-row tables
    return out.withColumns({"test": F.when(F.col("normal"), "welch").otherwise("mann_whitney"), "p": F.when(F.col("normal"), F.col("welch_p")).otherwise(F.col("rank_p"))}).drop("welch_p", "rank_p").withColumnRenamed("_g", "grp")


def wilcoxon(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row of the signed-rank test of a - b: n (zeros and nulls left out), w_plus, w_minus, z with ties."""
    rows = df.select((F.col(a) - F.col(b)).alias("d")).where("d <> 0").select(F.abs("d").alias("m"), (F.col("d") > 0).cast("long").alias("up"))
    r = ranks.value_counts(rows, "m", sums={"up": F.sum("up")})
    mid = F.col("below") + (F.col("n") + 1) / 2
    s = r.agg(F.sum("n").alias("n"), F.sum(F.col("up") * mid).alias("w_plus"), F.sum((F.col("n") - F.col("up")) * mid).alias("w_minus"), F.sum(F.col("n") * F.col("n") * F.col("n") - F.col("n")).cast("double").alias("t"))
    n = F.col("n").cast("double")
    spread = F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("t") / 48)
    return s.select("n", "w_plus", "w_minus", F.try_divide(F.col("w_plus") - n * (n + 1) / 4, spread).alias("z"))


def standard_differences(df: DataFrame, value: str, binary: str, first: Column) -> DataFrame:
    """Standardised mean differences of a number and of a 0/1 column between the two groups."""
    m = df.agg(*[f(F.when(c, F.col(x))).alias(f"{n}{k}") for k, c in (("1", first), ("2", ~first)) for n, x, f in (("m", value, F.avg), ("v", value, F.var_samp), ("p", binary, F.avg))])
    p1, p2 = F.col("p1"), F.col("p2")
    return m.select(((F.col("m1") - F.col("m2")) / F.sqrt((F.col("v1") + F.col("v2")) / 2)).alias("continuous"), F.try_divide(p1 - p2, F.sqrt((p1 * (1 - p1) + p2 * (1 - p2)) / 2)).alias("binary"))


def loess(df: DataFrame, x: str, y: str, share: float = 0.3, most: int = 2000) -> DataFrame:
    """x, fit: locally linear fit at each x over the means per x, by tricube weights of the nearest share of points.

    x has few values (ages): its means are one small table, joined with itself. More than most values raise.
    """
    means = df.groupBy(x).agg(F.avg(y).alias("y")).where("y IS NOT NULL").withColumnRenamed(x, "x")
    if df.where(F.col(y).isNotNull()).select(x).distinct().limit(most + 1).count() > most:
        raise ValueError(f"{x} has more than {most} values")
    pairs = means.select(F.col("x").alias("x0")).crossJoin(means).withColumn("d", F.abs(F.col("x") - F.col("x0")).cast("double"))
    w = Window.partitionBy("x0").orderBy("d", "x")
    pairs = pairs.withColumn("r", F.row_number().over(w)).withColumn("k", F.greatest(F.ceil(F.count("*").over(Window.partitionBy("x0")) * share), F.lit(2)))
    near = pairs.where("r <= k").withColumn("h", F.max("d").over(Window.partitionBy("x0")))
    u = F.least(F.try_divide(F.col("d"), F.col("h") * 1.0000001), F.lit(1.0))
    near = near.withColumn("w", F.pow(1 - F.pow(F.coalesce(u, F.lit(0.0)), F.lit(3)), F.lit(3))).withColumn("c", (F.col("x") - F.col("x0")).cast("double"))
    s = near.groupBy("x0").agg(F.sum("w").alias("s"), F.sum(F.col("w") * F.col("c")).alias("sx"), F.sum(F.col("w") * F.col("y")).alias("sy"), F.sum(F.col("w") * F.col("c") * F.col("c")).alias("xx"), F.sum(F.col("w") * F.col("c") * F.col("y")).alias("xy"))
    fit = F.try_divide(F.col("xx") * F.col("sy") - F.col("sx") * F.col("xy"), F.col("s") * F.col("xx") - F.col("sx") * F.col("sx"))
    return s.select(F.col("x0").alias("x"), F.coalesce(fit, F.col("sy") / F.col("s")).alias("fit"))


def lowess(df: DataFrame, x: str, y: str, group: tuple[str, ...] = (), share: float = 2 / 3, passes: int = 3, most: int = 2000) -> DataFrame:
    """group, x, y (the mean at x), fit: the robust locally weighted line through the means per x, for each group (cohort).

    Each fit takes the share of the points nearest to x, by tricube weights; each of `passes` more fits weighs points by
    the bisquare of their residual over six median residuals as well, so that outliers lose their pull. x has few values
    (ages): a group's means are one small table, joined with itself. A group of more than most values raises. A point
    that no line fits, because its near points lost their weights or all but one did, has a residual above all others;
    after the last pass its fit is their mean, or y. Means and residual weights are written between the passes, so that
    no pass computes an earlier one again.
    """
    point = df.where(F.col(y).isNotNull() & F.col(x).isNotNull()).groupBy(*group, F.col(x).cast("double").alias("x")).agg(F.avg(y).alias("y"))
    means = written(point.withColumn("rw", F.lit(1.0)), "lowess")
    if means.groupBy(*group).agg(F.count("*").alias("n")).where(F.col("n") > most).limit(1).count():
        raise ValueError(f"{x} has more than {most} values")
    for left in range(passes, -1, -1):
        fitted = _local_fit(means, group, share)
        if not left:
            break
        far = F.lit(float("inf"))
        fitted = fitted.withColumn("r", F.when(F.col("lined"), F.abs(F.col("y") - F.col("fit"))).otherwise(far))
        middle = ranks.quantiles(fitted, "r", {"m": 0.5}, group)
        both = fitted.join(middle, [*group]) if group else fitted.crossJoin(middle)  # one row
        u = F.when((F.col("r") == far) | (F.col("m") >= far), (F.col("r") == far).cast("double"))  # NaN lies above all else
        u = u.when(F.col("m") == 0, F.when(F.col("r") > 0, 1.0).otherwise(0.0)).otherwise(F.least(F.try_divide(F.col("r"), 6 * F.col("m")), F.lit(1.0)))
        means = written(both.select(*group, "x", "y", F.pow(1 - u * u, F.lit(2)).alias("rw")), "lowess")
    return fitted.select(*group, "x", "y", "fit")


def _local_fit(means: DataFrame, group: tuple[str, ...], share: float) -> DataFrame:
    """means (group, x, y, rw) with fit, and lined: whether a line fits."""
    own = means.select(*group, F.col("x").alias("x0"), F.col("y").alias("y0"))
    pairs = (own.join(means, [*group]) if group else own.crossJoin(means)).withColumn("d", F.abs(F.col("x") - F.col("x0")))
    at = Window.partitionBy(*group, "x0")
    # Rounding must not lose a point where share of the points is a whole number.
    nearest = F.greatest(F.floor(F.count("*").over(at) * share + 1e-10), F.lit(2))
    near = pairs.withColumns({"i": F.row_number().over(at.orderBy("d", "x")), "k": nearest}).where("i <= k").withColumn("h", F.max("d").over(at))
    u = F.try_divide("d", "h")
    tricube = F.when(u <= 0.001, 1.0).when(u <= 0.999, F.pow(1 - F.pow(u, F.lit(3)), F.lit(3))).when(F.col("h") == 0, 1.0).otherwise(0.0)
    near = near.withColumn("w", tricube * F.col("rw")).withColumn("c", F.col("x") - F.col("x0"))
    w, c, v = F.col("w"), F.col("c"), F.col("y")
    s = near.groupBy(*group, "x0", "y0").agg(F.sum(w).alias("s"), F.sum(w * c).alias("sx"), F.sum(w * v).alias("sy"), F.sum(w * c * c).alias("xx"), F.sum(w * c * v).alias("xy"))
    det = F.col("s") * F.col("xx") - F.col("sx") * F.col("sx")
    lined = (F.col("s") > 1e-12) & (det > 1e-12 * F.col("s") * F.col("xx"))  # what rounding leaves of 0 is no spread
    line = F.when(F.col("lined"), (F.col("xx") * F.col("sy") - F.col("sx") * F.col("xy")) / det).otherwise(F.col("sy") / F.col("s"))
    return s.withColumn("lined", lined).select(*group, F.col("x0").alias("x"), F.col("y0").alias("y"), F.when(F.col("s") > 1e-12, line).otherwise(F.col("y0")).alias("fit"), "lined")


def _relative(df: DataFrame, ts: str, anchor: str, offset_days: int) -> DataFrame:
    return df.withColumn("_rel", floor_days(F.col(ts), F.col(anchor)) if not offset_days else F.floor((micros(ts) - micros(anchor) - offset_days * DAY) / float(DAY)))


def delta_trajectory(df: DataFrame, key: str, ts: str, anchor: str, value: str, *, offset_days: int = 0, max_days: int = 720, least: int = 10) -> DataFrame:
    """bin_center (of 30 days), median, q1, q3, n_keys: changes from each key's last value before the anchor.

    First the median per key and bin, then over keys; bins of fewer than least keys are left out. area: the trapezoid
    area under |median| up to the bin.
    """
    rows = _relative(df.where(F.col(value).isNotNull() & F.col(ts).isNotNull()), ts, anchor, offset_days).where(F.col("_rel").between(-max_days, max_days))
    base = F.max_by(F.when(F.col("_rel") < 0, F.col(value)), F.when(F.col("_rel") < 0, F.struct(ts, value))).over(Window.partitionBy(key))
    rows = rows.withColumn("_d", F.col(value) - base).where("_d IS NOT NULL").withColumn("bin_center", F.floor(F.col("_rel") / 30) + 0.5)
    per = rows.groupBy(key, "bin_center").agg(F.percentile("_d", 0.5).alias("_d"))
    out = ranks.quantiles(per, "_d", {"median": 0.5, "q1": 0.25, "q3": 0.75}, ("bin_center",), size="n_keys").where(F.col("n_keys") >= least)
    w = Window.orderBy("bin_center")  # at most 2 * max_days / 30 rows
    step = (F.col("bin_center") - F.lag("bin_center").over(w)) * (F.abs("median") + F.abs(F.lag("median").over(w))) / 2
    return out.withColumn("_s", F.coalesce(step, F.lit(0.0))).withColumn("area", F.sum("_s").over(w)).drop("_s")


def pre_post_slopes(df: DataFrame, key: str, ts: str, anchor: str, value: str, *, pre_days: int = 365, post_days: int = 365) -> DataFrame:
    """Per key: points, least-squares slopes per year before and after the anchor, their difference, and the baseline."""
    rows = _relative(df.where(F.col(value).isNotNull() & F.col(ts).isNotNull()), ts, anchor, 0).where(F.col("_rel").between(-pre_days, post_days))
    x, before = F.col("_rel") / 365.25, F.col("_rel") < 0

    def slope(side: Column) -> Column:
        xs, ys = F.when(side, x), F.when(side, F.col(value).cast("double"))
        return F.when(F.count_distinct(xs) >= 2, F.regr_slope(ys, xs))

    out = rows.groupBy(key).agg(F.count_if(before).alias("n_pre"), F.count_if(~before).alias("n_post"), slope(before).alias("pre_slope"), slope(~before).alias("post_slope"), F.max_by(F.when(before, F.col(value)), F.when(before, F.struct(ts, value))).alias("baseline"))
    return out.withColumn("slope_change", F.col("post_slope") - F.col("pre_slope"))


def histogram(df: DataFrame, value: str, group: list[str], width: float = 1.0) -> DataFrame:
    return df.where(F.col(value).isNotNull()).groupBy(*group, F.floor(F.col(value) / width).cast("long").alias("bin")).agg(F.count("*").alias("n"))
