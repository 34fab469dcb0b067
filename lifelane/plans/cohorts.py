"""Cohorts: exposures with what was known at their start and what came after."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import coding
from ..functions.times import DAY, days
from ..operators import cleaning, encoding, history, series
from ..operators.asof import Source, asof, asof_many
from ..sources.io import written


def without_columns(df: DataFrame, names=(), prefixes=(), suffixes=()) -> DataFrame:
    gone = [c for c in df.columns if c in names or c.startswith(tuple(prefixes) or ("\0",)) or c.endswith(tuple(suffixes) or ("\0",))]
    return df.drop(*gone)


def known_at(codes: DataFrame | dict[str, DataFrame] | None, labs: DataFrame | None, stays: DataFrame | None, tests: list[str]) -> list[Source]:
    """Sources of what is known at an instant: the last codes, each test's last flag (1 to 3), the tests up to then, the last stay.

    codes: k, s, codes, or several families of them by the name that their column gets. labs: k, h, test, flag, tie. stays: k, s, e, tie.
    """
    out = []
    families = {} if codes is None else codes if isinstance(codes, dict) else {"codes": codes}
    for name, rows in families.items():
        out.append(Source(rows, "s", {name: F.col("codes")}, ties=["codes"]))
    if labs is not None:
        labs = labs.repartition("k")  # also for what groups by key and instant
        flag = coding.recode("flag", coding.FLAG_ORDER)
        out.append(Source(labs, "h", {f"lab_{t}": F.when(F.col("test") == t, flag) for t in tests}, ties=["tie"], each=True))
        past = history.test_history(labs.withColumn("abnormal", flag != 2), "k", "h", "abnormal")
        out.append(Source(past, "h", ["tests_before", "abnormal_before", "days_since_previous", "abnormal_share"]))
    if stays is not None:
        out.append(Source(stays, "s", {"stay_s": F.col("s"), "stay_e": F.col("e")}, ties=["tie"]))
    return out


def initiation(exposures: DataFrame, series_: DataFrame, codes: DataFrame | dict[str, DataFrame], labs: DataFrame, stays: DataFrame, *, tests: list[str], baseline_days: int = 90, target_days: int = 180, wash_out_days: int = 30, rise: float = 1.05) -> DataFrame:
    """First exposure of each key with its baseline, later target, codes, labs, past tests and stay.

    exposures: k, id, s. series_: k, day, amount, tie. For the others see known_at().
    baseline: the last measurement up to baseline_days before the start. target: the first one after it, within
    target_days; if that lies less than wash_out_days away the exposure is dropped, a later one doesn't replace it.
    rose: target >= rise * baseline. inside: whether the last stay had not ended at the start. All tables meet in one
    shuffle by key; see refined() for the columns that models take.
    """
    before = Source(series_, "day", {"baseline_amount": F.col("amount")}, tolerance=baseline_days * DAY, ties=["tie"])
    after = Source(series_, "day", {"target_amount": F.col("amount")}, direction="forward", exact=False, tolerance=target_days * DAY, ties=["tie"], gap="away")
    rows = asof_many(exposures, by="k", left_ts="s", sources=[before, after, *known_at(codes, labs, stays, tests)], keyed=True)
    rows = rows.where(F.col("baseline_amount").isNotNull() & F.col("target_amount").isNotNull() & (F.col("away") >= wash_out_days * DAY))
    rows = rows.withColumn("inside", F.coalesce(F.col("s") <= F.col("stay_e"), F.lit(False)))
    first = cleaning.first_per_key(rows, "k", [F.asc("s"), F.asc("id")])
    return first.withColumn("rose", F.col("target_amount") >= rise * F.col("baseline_amount")).drop("stay_s", "stay_e", "away")


def refined(rows: DataFrame, *, codes: str | dict[str, str] = "codes", width: int = 4, top: int = 200, sparse: tuple[str, ...] = ("lab_",), most_missing: float = 0.5, categories: tuple[str, ...] = (), target: str = "rose", unused: tuple[str, ...] = (), suffixes: tuple[str, ...] = ()) -> DataFrame:
    """A cohort as models take it.

    Columns that begin with a sparse prefix go if more than most_missing of them is null; 'None' becomes null, truth
    values and their words 1 and 0; categories get a 0/1 column for each level; codes, cut to width, get one for each of
    the top commonest of the cohort (codes: their column, or several columns with the prefix that each family's columns
    get, every family with a top of its own); columns of 0 and 1 become bytes. target comes last; unused columns and those with
    the suffixes are dropped. Three bounded queries find the columns, levels and codes; the rows are written first, so
    that none of these makes the cohort again.
    """
    rows = written(rows, "cohort")
    doubtful = [c for c in rows.columns if c.startswith(sparse)]
    rows = encoding.retyped(cleaning.drop_sparse(rows, doubtful, most_missing) if doubtful else rows)
    for c in categories:
        rows = encoding.one_hot(rows, c, encoding.levels(rows, c), f"{c}_").drop(c)
    for column, prefix in (codes if isinstance(codes, dict) else {codes: "code_"}).items():
        rows = rows.withColumn("_short", coding.rolled_up(column, width))
        common = [r.code for r in encoding.top_codes(rows, "_short", top).collect()]
        rows = encoding.multi_hot(rows, "_short", common, prefix).drop("_short", column)
    rows = rows.withColumn("_target", F.col(target).cast("byte"))
    rows = without_columns(rows, names=(target, *unused), suffixes=suffixes).withColumnRenamed("_target", "target")
    two = set(cleaning.binary_columns(rows))
    return rows.select(*[F.col(f"`{c}`").cast("byte").alias(c) if c in two else F.col(f"`{c}`") for c in rows.columns])


def on_treatment(exposures: DataFrame, series_: DataFrame, *, wash_out_days: int = 30, rise: float = 0.05, censored_as_negative: bool = False, codes: DataFrame | dict[str, DataFrame] | None = None, labs: DataFrame | None = None, stays: DataFrame | None = None, tests: list[str] | None = None, first_only: bool = False) -> DataFrame:
    """Per exposure (k, id, s, e): its first measurement after the start, if at least wash_out_days later and not past the end.

    target: whether the measurement after that one is higher by `rise`; without one it is null and the row dropped, or
    0 if censored_as_negative. codes, labs and stays, if given (see known_at()), are those known at the measurement;
    inside: whether the last stay had not ended by then. first_only keeps each key's earliest measurement.
    """
    steps = series.steps(series_.repartition("k"), "k", "day", "amount", "tie", rise)
    steps = steps.select("k", "day", "amount", "tie", "share_to_next", F.when(F.col("days_to_next").isNotNull(), F.col("rises_next").cast("int")).alias("target"))
    rows = asof(exposures, steps, by="k", left_ts="s", right_ts="day", take=["day", "amount", "tie", "target"], direction="forward", exact=False, ties=["tie"], gap="away", keyed=True)
    rows = rows.where((F.col("away") >= wash_out_days * DAY) & (F.col("e").isNull() | (F.col("day") <= F.col("e")))).drop("away")
    rows = rows.withColumn("target", F.coalesce("target", F.lit(0))) if censored_as_negative else rows.where("target IS NOT NULL")
    sources = known_at(codes, labs, stays, tests or [])
    if sources:
        rows = asof_many(rows, by="k", left_ts="day", sources=sources, keyed=True)
    if stays is not None:
        rows = rows.withColumn("inside", F.coalesce(F.col("day") <= F.col("stay_e"), F.lit(False))).drop("stay_s", "stay_e")
    return cleaning.first_per_key(rows, "k", [F.asc("day"), F.asc("tie"), F.asc("s"), F.asc("id")]) if first_only else rows


def subcohorts(series_: DataFrame, exposures: DataFrame, *, before_days: int = 100, limit: float = 0.6, while_on: bool = False) -> DataFrame:
    """Measurements by group: unexposed first and last, exposed first and last, exposed before.

    series_: k, day, amount, tie. exposures: k, s, e, the first exposure of each key. Only measurements with a next one
    at least a day later, and with a change per day within (-limit, limit), count. Exposed ones lie in the exposure, or
    (unless while_on) up to before_days before it. days_on and days_off tell how the time to the next one splits.
    """
    rows = cleaning.guarded_rate(series.steps(series_, "k", "day", "amount", "tie"), "change_to_next", "days_to_next", limit)
    keep = ["k", "day", "amount", "tie", "days_to_next"]
    free = rows.select(*keep).join(exposures, "k", "left_anti")
    order = [F.asc("day"), F.asc("tie")]
    back = [F.desc("day"), F.desc("tie")]
    none = {"days_on": F.lit(None).cast("double"), "days_off": F.lit(None).cast("double")}
    parts = [
        cleaning.first_per_key(free, "k", order).withColumns(none | {"grp": F.lit("unexposed_first")}),
        cleaning.first_per_key(free, "k", back).withColumns(none | {"grp": F.lit("unexposed_last")}),
    ]
    own = rows.select(*keep).join(exposures.select("k", "s", "e"), "k")
    since, span, left = days("day", "s"), days("e", "s"), days("e", "day")
    on = (since >= 0) & (left >= 0)
    still = F.col("days_to_next") < left
    own = own.withColumns({"on": on, "still": still, "days_on": F.when(still, since + F.col("days_to_next")).otherwise(span), "days_off": F.when(still, F.lit(0.0)).otherwise(since + F.col("days_to_next") - span)})
    own = own.where((F.col("on") if while_on else (since >= -before_days) & (left >= -1)) & (F.col("on") | F.col("still")))
    during = own.where("on").drop("s", "e", "on", "still")
    parts += [
        cleaning.first_per_key(during, "k", order).withColumn("grp", F.lit("exposed_first")),
        cleaning.first_per_key(during, "k", back).withColumn("grp", F.lit("exposed_last")),
        own.where("NOT on").drop("s", "e", "on", "still").withColumn("grp", F.lit("exposed_before")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def with_target(df: DataFrame, mode: str, *, change: str = "change_to_next", gap: str = "days_to_next", value: str = "amount", percent: float = 5.0, limit: float = 0.6) -> DataFrame:
    """target by mode: percent (the change passes percent of value), slope_sign (0/1) or difference (the change itself)."""
    if mode == "percent":
        return df.withColumn("target", (F.try_divide(F.col(change) * 100, F.col(value)) > percent).cast("double"))
    guarded = cleaning.guarded_rate(df, change, gap, limit)
    if mode == "slope_sign":
        return guarded.withColumn("target", (F.col("rate") > 0).cast("double"))
    if mode == "difference":
        return guarded.withColumn("target", F.col(change).cast("double"))
    raise ValueError(f"no such mode: {mode}")
