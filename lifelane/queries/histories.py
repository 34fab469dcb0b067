"""Queries: as-of joins, intervals, histories, series."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.times import DAY
from ..operators import asof, cleaning, history, intervals, series
from . import Registry
from .base import EXPO, LABS, SPEND, STAYS, exposures, flags, measures, r, spending, stays

query = Registry()
HOUR = DAY // 24


def _purchases(spark, d):
    rows = measures(spark, d)
    return rows.where("event_type = 'purchase'").select("event_id", "user_id", "ts", "value"), rows.where("event_type = 'view'").select(F.col("user_id"), F.col("ts").alias("seen"), F.col("value").alias("viewed"), F.col("event_id").alias("view_id"))


def _asof_sql(direction: str, exact: bool, hours: float | None) -> str:
    op, pick = (("<=" if exact else "<"), "DESC") if direction == "backward" else ((">=" if exact else ">"), "ASC")
    cond = "" if hours is None else f"abs(epoch_us(l.ts) - epoch_us(v.ts)) <= {int(hours * HOUR)}"
    keep = f"CASE WHEN {cond} THEN v.value END AS viewed, CASE WHEN {cond} THEN v.event_id END AS view_id" if cond else "v.value AS viewed, v.event_id AS view_id"
    return f"""WITH l AS (SELECT * FROM events WHERE event_type = 'purchase'), v AS (SELECT * FROM events WHERE event_type = 'view'),
m AS (SELECT l.event_id, v.event_id AS vid FROM l JOIN v ON l.user_id = v.user_id AND v.ts {op} l.ts QUALIFY row_number() OVER (PARTITION BY l.event_id ORDER BY v.ts {pick}, v.event_id {pick}) = 1)
SELECT l.event_id, {keep} FROM l LEFT JOIN m USING (event_id) LEFT JOIN v ON v.event_id = m.vid"""


def _asof(direction: str, exact: bool, hours: float | None):
    def run(spark, d):
        left, right = _purchases(spark, d)
        tol = None if hours is None else int(hours * HOUR)
        return asof.asof(left, right, by="user_id", left_ts="ts", right_ts="seen", take=["viewed", "view_id"], direction=direction, exact=exact, tolerance=tol, ties=["view_id"]).select("event_id", "viewed", "view_id")

    return run


for _name, _args in {"asof_backward_tolerance": ("backward", True, 24), "asof_forward_strict": ("forward", False, 48), "asof_forward_open": ("forward", False, None), "asof_backward_open": ("backward", True, None)}.items():
    query(_name, _asof_sql(*_args))(_asof(*_args))


def _hot(sql: str) -> str:
    """The as-of SQL with half of all users as one."""
    return sql.replace("WITH l AS (SELECT * FROM events WHERE", "WITH ev AS (SELECT * REPLACE (CASE WHEN user_id % 2 = 0 THEN 0 ELSE user_id END AS user_id) FROM events), l AS (SELECT * FROM ev WHERE").replace("v AS (SELECT * FROM events", "v AS (SELECT * FROM ev")


@query("asof_hot_key", f"SELECT b.event_id, b.viewed AS before, b.view_id AS before_id, f.viewed AS after, f.view_id AS after_id FROM ({_hot(_asof_sql('backward', True, 24))}) b JOIN ({_hot(_asof_sql('forward', False, None))}) f USING (event_id)")
def asof_hot_key(spark, d):
    """Half of all rows have one key: it is dealt over tasks by time, in both directions at once."""
    left, right = (x.withColumn("user_id", F.when(F.col("user_id") % 2 == 0, 0).otherwise(F.col("user_id"))) for x in _purchases(spark, d))
    back = asof.Source(right, "seen", {"before": F.col("viewed"), "before_id": F.col("view_id")}, tolerance=24 * HOUR, ties=["view_id"])
    ahead = asof.Source(right, "seen", {"after": F.col("viewed"), "after_id": F.col("view_id")}, direction="forward", exact=False, ties=["view_id"])
    rows = asof.asof_many(left, by="user_id", left_ts="ts", sources=[back, ahead], block=500)
    return rows.select("event_id", "before", "before_id", "after", "after_id")


@query("asof_washout", f"""WITH x AS ({_asof_sql("forward", False, None)}) SELECT x.event_id, x.view_id, epoch_us(v.ts) - epoch_us(l.ts) AS away FROM x JOIN events l ON l.event_id = x.event_id JOIN events v ON v.event_id = x.view_id
WHERE epoch_us(v.ts) - epoch_us(l.ts) BETWEEN {6 * HOUR} AND {72 * HOUR}""")
def asof_washout(spark, d):
    """The gap is tested after the nearest row is chosen: a near miss isn't replaced by a later row."""
    left, right = _purchases(spark, d)
    rows = asof.asof(left, right, by="user_id", left_ts="ts", right_ts="seen", take=["view_id"], direction="forward", exact=False, ties=["view_id"], gap="away")
    return rows.where(F.col("away").between(6 * HOUR, 72 * HOUR)).select("event_id", "view_id", "away")


@query("interval_membership", f"""WITH {STAYS}, {EXPO}, m AS (SELECT x.okey, x.ln, x.pk, x.s AS day, t.s, t.e, t.okey AS stay FROM expo x LEFT JOIN stays t ON t.k = x.k AND t.s <= x.s QUALIFY row_number() OVER (PARTITION BY x.okey, x.ln, x.pk, x.s ORDER BY t.s DESC, t.okey DESC) = 1)
SELECT okey, ln, pk, day, coalesce(day <= e, false) AS inside, coalesce(s <= e, false) AS inside_legacy FROM m""")
def interval_membership(spark, d):
    left = exposures(spark, d).select("k", "okey", "ln", "pk", F.col("s").alias("day"))
    left = cleaning.once(left, ["pk", "okey", "ln", "k", "day"])
    right = stays(spark, d).select("k", "s", "e", F.col("okey").alias("stay"))
    rows = asof.asof(left, right, by="k", left_ts="day", right_ts="s", take=["s", "e"], ties=["stay"])
    return rows.select("okey", "ln", "pk", "day", F.coalesce(F.col("day") <= F.col("e"), F.lit(False)).alias("inside"), F.coalesce(F.col("s") <= F.col("e"), F.lit(False)).alias("inside_legacy"))


def _islands_sql(keys: str, end: str, order: str = "s, e") -> str:
    return f"""base AS (SELECT DISTINCT {keys}, brand, s, {end} AS e, dose, rf, okey, ln, pk FROM expo),
marked AS (SELECT *, CASE WHEN epoch_us(s) <= max(epoch_us(e)) OVER (PARTITION BY {keys} ORDER BY s, e NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + {2 * DAY} THEN 0 ELSE 1 END AS fresh FROM base),
isl AS (SELECT *, sum(fresh) OVER (PARTITION BY {keys} ORDER BY s, e NULLS LAST ROWS UNBOUNDED PRECEDING) AS island FROM marked)"""


_DAYS = "(epoch_us(max(e)) - epoch_us(min(s))) / 86400000000.0"


@query("interval_collapse", f"""WITH {EXPO}, {_islands_sql("k, code", "oe")}
SELECT k, code, min(s) AS s, max(e) AS e, CASE WHEN {_DAYS} > 0 AND {_DAYS} < 1 THEN 1.0 ELSE {_DAYS} END::DOUBLE AS days, string_agg(DISTINCT brand, ',' ORDER BY brand) AS brands, count(DISTINCT brand) AS n_brands FROM isl GROUP BY k, code, island""")
def interval_collapse(spark, d):
    rows = exposures(spark, d).drop("e").withColumnRenamed("oe", "e")
    codes = F.collect_set("brand")
    return intervals.collapse(rows, ["k", "code"], "s", "e", aggs={"brands": F.array_join(F.array_sort(codes), ","), "n_brands": F.size(codes).cast("long")}, distinct=False)


@query("interval_collapse_hot_key", f"""WITH {EXPO.replace("o_custkey AS k", "CASE WHEN o_custkey % 2 = 0 THEN 0 ELSE o_custkey END AS k")}, {_islands_sql("k", "e")}
SELECT k, min(s) AS s, max(e) AS e, {_DAYS}::DOUBLE AS days, count(*) AS n FROM isl GROUP BY k, island""")
def interval_collapse_hot_key(spark, d):
    """Half of all intervals have one key, which is dealt over tasks by start."""
    rows = exposures(spark, d).withColumn("k", F.when(F.col("k") % 2 == 0, 0).otherwise(F.col("k"))).drop("oe")
    return intervals.collapse(rows, ["k"], "s", "e", gap=2 * DAY, aggs={"n": F.count("*")}, block=2000)


@query("interval_collapse_dose", f"""WITH {EXPO}, {_islands_sql("k, code", "e")}
SELECT k, code, min(s) AS s, max(e) AS e, {_DAYS}::DOUBLE AS days, round(avg(dose), 6) AS mean_dose, max(CASE WHEN rf = 'A' THEN 1 ELSE 0 END) AS any_administered, sum(CASE WHEN rf = 'A' THEN 1 ELSE 0 END)::BIGINT AS administrations,
CASE WHEN bool_or(rf = 'A') AND bool_or(rf <> 'A') THEN 'both' WHEN bool_or(rf = 'A') THEN 'administration' WHEN bool_or(rf <> 'A') THEN 'prescription' ELSE 'unknown' END AS source FROM isl GROUP BY k, code, island""")
def interval_collapse_dose(spark, d):
    hand = (F.col("rf") == "A").cast("int")
    aggs = {"mean_dose": r(F.avg("dose"), 6), "any_administered": F.max(hand), "administrations": F.sum(hand), "_p": F.max(1 - hand)}
    rows = intervals.collapse(exposures(spark, d).drop("oe"), ["k", "code"], "s", "e", aggs=aggs)
    return rows.withColumn("source", intervals.provenance(F.col("any_administered") == 1, F.col("_p") == 1)).drop("_p")


@query("weighted_dose", f"""WITH {EXPO}, {_islands_sql("k, code", "e")}, x AS (SELECT *, (epoch_us(e) - epoch_us(s)) / 86400000000.0 AS w FROM isl)
SELECT k, code, min(s) AS s, round(sum(dose * w) / sum(w), 6) AS by_duration, round(avg(dose), 6) AS by_rows FROM x GROUP BY k, code, island""")
def weighted_dose(spark, d):
    span = (F.col("_e") - F.col("_s")) / float(DAY)
    aggs = {"by_duration": r(intervals.weighted_mean(F.col("dose"), span), 6), "by_rows": r(F.avg("dose"), 6)}
    return intervals.collapse(exposures(spark, d).drop("oe"), ["k", "code"], "s", "e", aggs=aggs).select("k", "code", "s", "by_duration", "by_rows")


@query("code_distinct_count", f"WITH {EXPO} SELECT k, code, count(DISTINCT brand) AS n FROM expo GROUP BY k, code")
def code_distinct_count(spark, d):
    return exposures(spark, d).groupBy("k", "code").agg(F.count_distinct("brand").alias("n"))


@query("interval_repair", f"""WITH {EXPO}, x AS (SELECT okey, ln, pk, CASE WHEN ln = 7 THEN NULL ELSE s END AS s, CASE WHEN ln % 2 = 0 THEN oe ELSE s - INTERVAL 3 DAY END AS e, CASE WHEN rf = 'A' THEN s + INTERVAL 1 DAY END AS a FROM expo),
y AS (SELECT okey, ln, pk, s, coalesce(e, a, TIMESTAMP '2000-12-31') AS e2, a IS NOT NULL AS has_administration, e IS NULL AND a IS NULL AS possibly_ongoing FROM x WHERE s IS NOT NULL)
SELECT okey, ln, pk, least(s, e2) AS s, e2 AS e, has_administration, possibly_ongoing FROM y WHERE least(s, e2) >= '1996-01-01' AND least(s, e2) < '2001-01-01' AND e2 >= '1996-01-01' AND e2 < '2001-01-01'""")
def interval_repair(spark, d):
    rows = exposures(spark, d).select("okey", "ln", "pk", F.when(F.col("ln") != 7, F.col("s")).alias("s"), F.when(F.col("ln") % 2 == 0, F.col("oe")).otherwise(F.col("s") - F.make_dt_interval(F.lit(3))).alias("e"), F.when(F.col("rf") == "A", F.col("s") + F.make_dt_interval(F.lit(1))).alias("a"))
    out = intervals.repaired(rows, "s", "e", "a", lo="1996-01-01", hi="2001-01-01", ongoing="2000-12-31")
    return out.select("okey", "ln", "pk", "s", "e", "has_administration", "possibly_ongoing")


_SEEN = "x.k = y.k AND y.s <= x.s"


@query("interval_overlap_codes", f"""WITH {EXPO}, y AS (SELECT k, code, s, oe AS e FROM expo)
SELECT x.k, x.okey * 10000000 + x.pk * 10 + x.ln AS ident, coalesce(string_agg(DISTINCT y.code, ',' ORDER BY y.code) FILTER (y.code <> x.code AND (y.e IS NULL OR y.e >= x.s)), '') AS codes FROM (SELECT DISTINCT k, code, s, okey, ln, pk FROM expo) x JOIN y ON {_SEEN} GROUP BY x.k, x.okey, x.pk, x.ln, x.s, x.code""")
def interval_overlap_codes(spark, d):
    rows = exposures(spark, d).drop("e").withColumnRenamed("oe", "e").withColumn("ident", F.col("okey") * 10000000 + F.col("pk") * 10 + F.col("ln"))
    rows = rows.select("k", "code", "s", "e", "ident").dropDuplicates(["k", "code", "s", "ident"])
    return intervals.overlapping_codes(rows, "k", "code", "s", "e", "ident")


def _history_sql(inclusive: bool) -> str:
    alive = "y.e IS NULL OR y.e >= x.s" if inclusive else "y.e IS NULL OR y.e > x.s"
    own = "" if inclusive else " AND y.code <> x.code"
    past = "<=" if inclusive else "<"
    return f"""WITH {EXPO}, y AS (SELECT DISTINCT k, code, s, oe AS e FROM expo), x AS (SELECT * FROM y),
a AS (SELECT x.k, x.code, x.s, x.e, string_agg(DISTINCT y.code, ',' ORDER BY y.code) FILTER ((y.s = x.s OR {alive}){own}) AS act, count(DISTINCT y.code) FILTER ((y.s = x.s OR {alive}){own}) AS na,
 string_agg(DISTINCT y.code, ',' ORDER BY y.code) FILTER (y.s {past} x.s) AS past, count(DISTINCT y.code) FILTER (y.s {past} x.s) AS np, count(*) FILTER (y.code = x.code AND y.s < x.s) AS tb FROM x JOIN y ON {_SEEN} GROUP BY ALL)
SELECT k, code, s, e, tb AS times_before, coalesce(act, '') AS active_codes, na AS n_active, coalesce(past, '') AS past_codes, np AS n_past FROM a"""


def _history(inclusive: bool):
    def run(spark, d):
        rows = exposures(spark, d).select("k", "code", "s", F.col("oe").alias("e")).dropDuplicates()
        return history.code_history(rows, "k", "code", "s", "e", end_inclusive=inclusive, past_inclusive=inclusive, exclude_own=not inclusive)

    return run


query("history_active_inclusive", _history_sql(True))(_history(True))
query("history_active_exclusive", _history_sql(False))(_history(False))


_PREFIXES = {"active_s": ("S",), "active_pe": ("PROMO", "ECO"), "active_none": ("X",)}


@query("history_prefix_flags", "SELECT k, code, s, e, " + ", ".join(f"({' OR '.join(f'len(list_filter(l, lambda x: starts_with(x, {chr(39)}{x}{chr(39)}))) > 0' for x in v)}) AS {n}" for n, v in _PREFIXES.items()) + f" FROM (SELECT *, string_split(active_codes, ',') AS l FROM ({_history_sql(True)}))")
def history_prefix_flags(spark, d):
    rows = exposures(spark, d).select("k", "code", "s", F.col("oe").alias("e")).dropDuplicates()
    return history.code_history(rows, "k", "code", "s", "e", end_inclusive=True, past_inclusive=True, exclude_own=False, prefixes=_PREFIXES, texts=False).select("k", "code", "s", "e", *_PREFIXES)


@query("history_set_counts", f"""WITH {EXPO}, x AS (SELECT DISTINCT k, code, s FROM expo) SELECT x.k, x.code, x.s, count(y.k) FILTER (y.code LIKE 'S%') AS s_before, count(y.k) FILTER (y.code IN ('PROMO', 'LARGE')) AS pl_before FROM x LEFT JOIN x y ON y.k = x.k AND y.s < x.s GROUP BY ALL""")
def history_set_counts(spark, d):
    rows = exposures(spark, d).select("k", "code", "s").dropDuplicates()
    return history.count_before(rows, "k", "s", {"s_before": F.col("code").startswith("S"), "pl_before": F.col("code").isin("PROMO", "LARGE")})


@query("history_lab", f"""WITH {LABS}, p AS (SELECT user_id, date_trunc('hour', ts) AS h, count(*) AS n, sum(abnormal) AS a FROM labs GROUP BY ALL),
q AS (SELECT user_id, h, coalesce(sum(n) OVER b, 0)::BIGINT AS tests_before, coalesce(sum(a) OVER b, 0)::BIGINT AS abnormal_before, floor((epoch_us(h) - epoch_us(lag(h) OVER (PARTITION BY user_id ORDER BY h))) / 86400000000.0)::BIGINT AS days_since_previous FROM p
 WINDOW b AS (PARTITION BY user_id ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT *, round(abnormal_before / nullif(tests_before, 0), 6) AS abnormal_share FROM q""")
def history_lab(spark, d):
    rows = history.test_history(flags(spark, d).withColumn("h", F.date_trunc("hour", "ts").cast("timestamp_ntz")), "user_id", "h", "abnormal")
    return rows.withColumn("abnormal_share", r("abnormal_share", 6))


@query("history_stays", f"""WITH {STAYS}, x AS (SELECT *, floor((epoch_us(e) - epoch_us(s)) / 86400000000.0)::BIGINT AS stay_days FROM stays)
SELECT okey, stay_days, row_number() OVER w - 1 AS stays_before, coalesce(sum(stay_days) OVER (PARTITION BY k ORDER BY s, okey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS stay_days_before FROM x WINDOW w AS (PARTITION BY k ORDER BY s, okey)""")
def history_stays(spark, d):
    return history.stay_history(stays(spark, d), "k", "s", "e", "okey").select("okey", "stay_days", "stays_before", "stay_days_before")


@query("history_event_count", "SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS event_number FROM events")
def history_event_count(spark, d):
    return history.event_number(measures(spark, d), "user_id", "ts", "event_id").select("event_id", "event_number")


@query("median_normalised_index", """WITH h AS (SELECT event_id, user_id, value, 90 + (event_id % 17) * 2 + user_id % 140 AS cm FROM events), m AS (SELECT user_id, quantile_cont(cm::DOUBLE, 0.5) AS hm FROM h GROUP BY 1)
SELECT event_id, hm AS height_median, round(value * 1000 * 0.001 / pow(hm * 0.01, 2), 6) AS mass_index FROM h JOIN m USING (user_id) WHERE hm BETWEEN 100 AND 220""")
def median_normalised_index(spark, d):
    rows = measures(spark, d).withColumn("cm", (90 + (F.col("event_id") % 17) * 2 + F.col("user_id") % 140).cast("double")).withColumn("g", F.col("value") * 1000)
    return series.index_by_median(rows, "user_id", "cm", "g").select("event_id", "height_median", r("mass_index", 6).alias("mass_index"))


_W = "WINDOW w AS (PARTITION BY user_id ORDER BY ts)"
_RUN = "WINDOW w AS (PARTITION BY user_id ORDER BY ts), u AS (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


@query("seq_features", f"""SELECT event_id, row_number() OVER w - 1 AS n_before, round((epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 86400000000.0, 6) AS days_since, round(value - lag(value) OVER w, 4) AS change_since,
round((epoch_us(lead(ts) OVER w) - epoch_us(ts)) / 86400000000.0, 6) AS days_to_next, round(lead(value) OVER w - value, 4) AS change_to_next, round((lead(value) OVER w - value) / nullif(value, 0), 6) AS share_to_next, coalesce((lead(value) OVER w - value) / nullif(value, 0) >= 0.05, false) AS rises_next FROM events {_W}""")
def seq_features(spark, d):
    rows = series.steps(measures(spark, d), "user_id", "ts", "value")
    return rows.select("event_id", "n_before", r("days_since", 6).alias("days_since"), r("change_since").alias("change_since"), r("days_to_next", 6).alias("days_to_next"), r("change_to_next").alias("change_to_next"), r("share_to_next", 6).alias("share_to_next"), "rises_next")


@query("expanding_variance", f"SELECT event_id, round(var_samp(value) OVER u, 7) AS variance_so_far FROM events {_RUN}")
def expanding_variance(spark, d):
    return series.running_variance(measures(spark, d), "user_id", "ts", "value").select("event_id", r("variance_so_far", 7).alias("variance_so_far"))


@query("diff_from_first", f"SELECT event_id, round(value - first_value(value) OVER u, 4) AS change_from_first, round((value - first_value(value) OVER u) * 100 / nullif(first_value(value) OVER u, 0), 4) AS percent_from_first FROM events {_RUN}")
def diff_from_first(spark, d):
    rows = series.from_first(measures(spark, d), "user_id", "ts", "value")
    return rows.select("event_id", r("change_from_first").alias("change_from_first"), r("percent_from_first").alias("percent_from_first"))


@query("expanding_step_extremes", """WITH x AS (SELECT event_id, user_id, ts, value - lag(value) OVER (PARTITION BY user_id ORDER BY ts) AS st FROM events)
SELECT event_id, round(max(st) OVER u, 4) AS largest_step, round(min(st) OVER u, 4) AS smallest_step FROM x WINDOW u AS (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def expanding_step_extremes(spark, d):
    rows = series.step_extremes(measures(spark, d), "user_id", "ts", "value")
    return rows.select("event_id", r("largest_step").alias("largest_step"), r("smallest_step").alias("smallest_step"))


_SW = "WINDOW w AS (PARTITION BY k ORDER BY day, o_orderkey)"
_GAP = "(epoch_us(day) - epoch_us(lag(day) OVER w)) / 86400000000.0"


@query("seq_slope", f"WITH {SPEND}, x AS (SELECT o_orderkey, {_GAP} / 365.25 AS g, amount - lag(amount) OVER w AS c FROM spend {_SW}) SELECT o_orderkey, round(CASE WHEN g > 0 THEN c / g END, 5) AS slope, coalesce(CASE WHEN g > 0 THEN c / g END > 0, false) AS slope_up FROM x")
def seq_slope(spark, d):
    return series.slope_since(spending(spark, d), "k", "day", "amount", "o_orderkey").select("o_orderkey", r("slope", 5).alias("slope"), "slope_up")


@query("seq_direction", f"WITH {SPEND}, x AS (SELECT o_orderkey, {_GAP} AS g, amount - lag(amount) OVER w AS c FROM spend {_SW}) SELECT o_orderkey, CASE WHEN c IS NOT NULL THEN (c > 0)::INT END AS direction, round(c / nullif(g, 0), 6) AS rate, CASE WHEN c / nullif(g, 0) IS NOT NULL THEN (c / nullif(g, 0) > 0)::INT END AS rate_class FROM x")
def seq_direction(spark, d):
    return series.direction(spending(spark, d), "k", "day", "amount", "o_orderkey").select("o_orderkey", "direction", r("rate", 6).alias("rate"), "rate_class")


@query("expanding_ols", f"""WITH {SPEND}, x AS (SELECT o_orderkey, k, day, amount AS y, (epoch_us(day) - epoch_us(first_value(day) OVER (PARTITION BY k ORDER BY day, o_orderkey))) / 86400000000.0 / 365.25 AS x FROM spend),
s AS (SELECT o_orderkey, count(*) OVER u AS n, sum(x) OVER u AS sx, sum(y) OVER u AS sy, sum(x * x) OVER u AS xx, sum(x * y) OVER u AS xy, sum(y * y) OVER u AS yy FROM x WINDOW u AS (PARTITION BY k ORDER BY day, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
c AS (SELECT *, xx - sx * sx / n AS cxx, xy - sx * sy / n AS cxy, yy - sy * sy / n AS cyy FROM s)
SELECT o_orderkey, round(CASE WHEN n >= 2 AND cxx > 1e-12 THEN cxy / cxx END, 4) AS slope_year, round(CASE WHEN n >= 2 AND cxx > 1e-12 THEN (sy - cxy / cxx * sx) / n END, 4) AS intercept, round(CASE WHEN n >= 2 AND cxx > 1e-12 AND cyy > 1e-9 THEN cxy * cxy / (cxx * cyy) END, 4) AS r_squared FROM c""")
def expanding_ols(spark, d):
    rows = series.running_regression(spending(spark, d), "k", "day", "amount", "o_orderkey")
    return rows.select("o_orderkey", r("slope_year", 4).alias("slope_year"), r("intercept", 4).alias("intercept"), r("r_squared").alias("r_squared"))


@query("rolling_mean_trend", "SELECT x, round(m, 6) AS mean, round(avg(m) OVER (ORDER BY x ROWS BETWEEN 5 PRECEDING AND CURRENT ROW), 6) AS rolling FROM (SELECT l_quantity::INT AS x, avg(l_extendedprice) AS m FROM lineitem GROUP BY 1)")
def rolling_mean_trend(spark, d):
    from ..sources.io import table

    rows = series.rolling_mean(table(spark, d, "lineitem").select(F.col("l_quantity").cast("int").alias("x"), "l_extendedprice"), "x", "l_extendedprice")
    return rows.select("x", r("mean", 6).alias("mean"), r("rolling", 6).alias("rolling"))
