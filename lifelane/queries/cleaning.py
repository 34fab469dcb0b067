"""Queries: scans, typing, filters, duplicates, plain joins."""

from __future__ import annotations

import statistics
import zlib

from pyspark.sql import functions as F

from ..functions import coding
from ..operators import cleaning as ops
from ..sources import io
from . import Registry
from .base import EXPO, SPEND, exposures, measures, r, spending

query = Registry()

_DIRTY = "CASE event_id % 7 WHEN 0 THEN 'NA' WHEN 1 THEN '' WHEN 2 THEN 'null' ELSE event_type END"


def _dirty(spark, d):
    k = F.col("event_id") % 7
    text = F.when(k == 0, "NA").when(k == 1, "").when(k == 2, "null").otherwise(F.col("event_type"))
    number = F.when(k == 3, F.lit("n/a?")).otherwise(F.col("value").cast("string"))
    flag = F.when(k == 4, "Yes").when(k == 5, "no").when(k == 6, "maybe")
    return io.table(spark, d, "events").select("event_id", text.alias("kind"), number.alias("amount"), flag.alias("flag"), F.when(k == 2, "no date").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("seen"))


@query("clean_table", f"""SELECT event_id, CASE WHEN {_DIRTY} NOT IN ('', 'NA', 'null') THEN {_DIRTY} END AS kind, CASE WHEN event_id % 7 <> 3 THEN value END AS amount,
CASE event_id % 7 WHEN 4 THEN true WHEN 5 THEN false END AS flag, CASE WHEN event_id % 7 <> 2 THEN date_trunc('second', ts) END AS seen FROM events""")
def clean_table(spark, d):
    return ops.typed(_dirty(spark, d), ops.Roles(numeric=("amount", "absent"), instant=("seen",), category=("kind",), boolean=("flag",)))


@query("clean_missing_markers", f"SELECT kind, count(*) AS n FROM (SELECT CASE WHEN {_DIRTY} NOT IN ('', 'NA', 'null') THEN {_DIRTY} END AS kind FROM events) GROUP BY kind")
def clean_missing_markers(spark, d):
    return _dirty(spark, d).select(coding.unmark("kind").alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))


@query("sink_roundtrip", "SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS amount FROM orders GROUP BY o_custkey")
def sink_roundtrip(spark, d):
    """Writes a dealt-out parquet table and reads it back, beside the warehouse where all executors reach it."""
    path = f"{spark.conf.get('spark.sql.warehouse.dir')}/lifelane_sink_{zlib.crc32(d.encode())}"
    back = io.write_table(io.table(spark, d, "orders").select("o_custkey", "o_totalprice"), path, 8, "o_custkey")
    return back.groupBy("o_custkey").agg(F.count("*").alias("n"), r(F.sum("o_totalprice"), 2).alias("amount"))


@query("sink_bucketed", "SELECT c_custkey AS k, c_mktsegment AS segment, count(*) AS n, round(sum(o_totalprice), 2) AS amount FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY ALL")
def sink_bucketed(spark, d):
    """Two tables in buckets of one key; the join and the group need no exchange."""
    name = lambda kind: f"lifelane_{kind}_{zlib.crc32(d.encode())}"
    orders = io.write_bucketed(io.table(spark, d, "orders").select(F.col("o_custkey").alias("k"), "o_totalprice"), name("orders"), "k", 8)
    who = io.write_bucketed(io.table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("segment")), name("customers"), "k", 8)
    return orders.join(who.hint("merge"), "k").groupBy("k", "segment").agg(F.count("*").alias("n"), r(F.sum("o_totalprice"), 2).alias("amount"))


@query("sink_results", "SELECT o_orderpriority AS priority, count(*) AS n, round(avg(o_totalprice), 2) AS mean, CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE 'a;b, \"c\"' END AS note FROM orders GROUP BY 1")
def sink_results(spark, d):
    """A small result table as CSV, read back as it was written: quotes, separators and nulls."""
    path = f"{spark.conf.get('spark.sql.warehouse.dir')}/lifelane_results_{zlib.crc32(d.encode())}"
    rows = io.table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("priority")).agg(F.count("*").alias("n"), r(F.avg("o_totalprice"), 2).alias("mean"))
    io.write_results(rows.withColumn("note", F.when(F.col("priority") != "5-LOW", 'a;b, "c"')), path)
    return spark.read.schema("priority string, n long, mean double, note string").option("header", True).option("escape", '"').csv(path)


@query("scan_reference_csv", "WITH g AS (SELECT p_type, string_agg(DISTINCT p_brand, ', ' ORDER BY p_brand) AS codes FROM part GROUP BY 1) SELECT p_type, unnest(string_split(codes, ', ')) AS code FROM g")
def scan_reference_csv(spark, d):
    """Writes brand groups as semicolon CSV and reads them back as a code reference."""
    path = f"{spark.conf.get('spark.sql.warehouse.dir')}/lifelane_codes_{zlib.crc32(d.encode())}"
    groups = io.table(spark, d, "part").groupBy("p_type").agg(F.array_join(F.array_sort(F.collect_set("p_brand")), ", ").alias("codes"))
    groups.write.mode("overwrite").option("sep", ";").option("header", True).csv(path)
    return io.grouped_codes(io.code_reference(spark, path, "p_type string, codes string"), "codes")


@query("filter_time_window", "SELECT event_id, user_id, ts, event_type, value FROM events WHERE ts >= '2024-01-05' AND ts < '2024-01-12'")
def filter_time_window(spark, d):
    return ops.within(measures(spark, d), "ts", "2024-01-05", "2024-01-12")


_BORN = "TIMESTAMP '1940-01-01' + to_days((o_custkey % 25000)::INT)"


@query("filter_age_range", f"SELECT o_orderkey FROM orders WHERE (epoch_us(o_orderdate) - epoch_us({_BORN})) / 86400000000.0 / 365.25 BETWEEN 18 AND 60")
def filter_age_range(spark, d):
    born = F.lit("1940-01-01").cast("timestamp_ntz") + F.make_dt_interval((F.col("o_custkey") % 25000).cast("int"))
    return ops.of_age(io.table(spark, d, "orders").withColumn("born", born), "o_orderdate", "born", 18, 60).select("o_orderkey")


_RANGES = [("ECONOMY", 1000.0, 40000.0), ("PROMO", 20000.0, 60000.0), ("SMALL", 0.0, 30000.0)]


@query("code_range_filter", f"""WITH {EXPO}, lim(code, lo, hi) AS (VALUES {", ".join(f"('{c}', {a}, {b})" for c, a, b in _RANGES)})
SELECT expo.code, count(*) AS n, round(sum(dose), 2) AS total FROM expo LEFT JOIN lim USING (code) WHERE lo IS NULL OR coalesce(dose BETWEEN lo AND hi, false) GROUP BY expo.code""")
def code_range_filter(spark, d):
    limits = spark.createDataFrame(_RANGES, "code string, lo double, hi double")
    return ops.in_code_range(exposures(spark, d), "code", "dose", limits).groupBy("code").agg(F.count("*").alias("n"), r(F.sum("dose"), 2).alias("total"))


@query("outlier_quantile_filter", """WITH q AS (SELECT quantile_cont(value, 0.001) AS lo, quantile_cont(value, 0.999) AS hi FROM events)
SELECT event_id, value FROM events, q WHERE value > lo AND value < hi""")
def outlier_quantile_filter(spark, d):
    return ops.without_tails(measures(spark, d), "value").select("event_id", "value")


@query("outlier_iqr_filter", """WITH q AS (SELECT event_type, quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM events GROUP BY 1)
SELECT event_id, value FROM events JOIN q USING (event_type) WHERE value BETWEEN a - 1.5 * (b - a) AND b + 1.5 * (b - a)""")
def outlier_iqr_filter(spark, d):
    return ops.without_iqr_outliers(measures(spark, d), "value", "event_type").select("event_id", "value")


@query("min_measurements_filter", "SELECT o_orderkey, o_custkey FROM orders QUALIFY count(o_totalprice) OVER (PARTITION BY o_custkey) >= 12")
def min_measurements_filter(spark, d):
    return ops.with_enough(io.table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), "o_custkey", "o_totalprice", 12).select("o_orderkey", "o_custkey")


_STEP = "SELECT o_orderkey, lead(amount) OVER w - amount AS change, (epoch_us(lead(day) OVER w) - epoch_us(day)) / 86400000000.0 AS gap FROM spend WINDOW w AS (PARTITION BY k ORDER BY day, o_orderkey)"


@query("rate_guard_filter", f"WITH {SPEND}, st AS ({_STEP}) SELECT o_orderkey, round(change / gap, 6) AS rate FROM st WHERE gap >= 1 AND change / gap > -900 AND change / gap < 900")
def rate_guard_filter(spark, d):
    from ..operators import series

    rows = series.steps(spending(spark, d), "k", "day", "amount", "o_orderkey")
    return ops.guarded_rate(rows, "change_to_next", "days_to_next", 900).select("o_orderkey", r("rate", 6).alias("rate"))


def _wide(spark, d):
    kinds = ["view", "signup", "error", "purchase", "click"]
    hour = F.date_trunc("hour", "ts")
    return measures(spark, d).groupBy("user_id", hour.alias("h")).agg(*[F.max(F.when(F.col("event_type") == k, F.col("value"))).alias(k) for k in kinds])


_WIDE = "wide AS (SELECT user_id, date_trunc('hour', ts) AS h, " + ", ".join(f"max(CASE WHEN event_type = '{k}' THEN value END) AS {k}" for k in ("view", "signup", "error", "purchase", "click")) + " FROM events GROUP BY ALL)"


@query("drop_sparse_columns", f"WITH {_WIDE} SELECT c, s > 0.5 AS dropped, round(s, 6) AS share FROM (SELECT unnest(['view', 'signup', 'error', 'purchase', 'click']) AS c, unnest([avg((view IS NULL)::INT), avg((signup IS NULL)::INT), avg((error IS NULL)::INT), avg((purchase IS NULL)::INT), avg((click IS NULL)::INT)]) AS s FROM wide)")
def drop_sparse_columns(spark, d):
    """Which columns go, and why; the driver-side decision as a table."""
    wide = _wide(spark, d)
    columns = ["view", "signup", "error", "purchase", "click"]
    left = ops.drop_sparse(wide, columns).columns
    shares = wide.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in columns])
    return shares.unpivot([], columns, "c", "share").select("c", r("share", 6).alias("share"), (~F.col("c").isin(left)).alias("dropped"))


@query("pairwise_sparsity", f"""WITH {_WIDE}, long AS (SELECT user_id, h, c, v FROM wide UNPIVOT (v FOR c IN (view, signup, error, purchase, click)))
SELECT a.c AS a, b.c AS b, count(*) AS n FROM long a JOIN long b USING (user_id, h) GROUP BY ALL""")
def pairwise_sparsity(spark, d):
    columns = ["view", "signup", "error", "purchase", "click"]
    wide = _wide(spark, d)
    pairs = [(a, b) for a in columns for b in columns]
    counts = wide.agg(*[F.count_if(F.col(a).isNotNull() & F.col(b).isNotNull()).alias(f"{a}|{b}") for a, b in pairs])
    long = counts.unpivot([], [f"{a}|{b}" for a, b in pairs], "pair", "n").where("n > 0")
    return long.select(F.split_part("pair", F.lit("|"), F.lit(1)).alias("a"), F.split_part("pair", F.lit("|"), F.lit(2)).alias("b"), "n")


_KINDS = ["view", "signup", "error", "purchase", "click"]
_JOINT = " UNION ALL ".join(f"SELECT {i} AS i, {j} AS j, count(*) FILTER ({a} IS NOT NULL AND {b} IS NOT NULL) AS n FROM wide" for i, a in enumerate(_KINDS) for j, b in enumerate(_KINDS) if i <= j)
_LEAST = "(SELECT median(n) FROM joint WHERE i < j)"


@query("pairwise_sparse_drop", f"""WITH {_WIDE}, joint AS ({_JOINT}), own AS (SELECT i, n FROM joint WHERE i = j), pair AS (SELECT a.i AS i, b.i AS j, a.n AS ni, b.n AS nj, joint.n FROM joint JOIN own a ON a.i = joint.i JOIN own b ON b.i = joint.j WHERE joint.i < joint.j),
bad AS (SELECT DISTINCT CASE WHEN ni <= nj THEN i ELSE j END AS i FROM pair WHERE n < {_LEAST}) SELECT list_extract({_KINDS}, i + 1) AS c, n, (i IN (SELECT i FROM bad) AND i <> 0) AS dropped FROM own""")
def pairwise_sparse_drop(spark, d):
    """The columns that go because they share too few rows with another; the first one is protected. The bound is the pairs' median."""
    wide = _wide(spark, d)
    n = ops.jointly_present(wide, _KINDS)
    least = statistics.median(v for (a, b), v in n.items() if a != b)
    left = ops.drop_sparse_pairs(wide, _KINDS, least, ("view",)).columns
    return spark.createDataFrame([(c, n[c, c], c not in left) for c in _KINDS], "c string, n long, dropped boolean")


@query("numeric_feature_select", f"WITH {_WIDE} SELECT coalesce(view, 0) AS view, coalesce(signup, 0) AS signup, coalesce(purchase, 0) AS purchase, coalesce(click, 0) AS click FROM wide")
def numeric_feature_select(spark, d):
    return ops.numeric_features(_wide(spark, d), ("err", "user_"))


@query("dedup_coalesce", """WITH x AS (SELECT DISTINCT o_custkey AS k, o_orderdate AS day, o_orderkey AS id, CASE WHEN o_orderkey % 3 > 0 THEN o_totalprice END AS amount, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority END AS pri FROM orders)
SELECT k, day, min(id) AS id, arg_min(amount, id) FILTER (amount IS NOT NULL) AS amount, arg_min(pri, id) FILTER (pri IS NOT NULL) AS pri FROM x GROUP BY k, day""")
def dedup_coalesce(spark, d):
    rows = io.table(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderdate").alias("day"), F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 3 > 0, F.col("o_totalprice")).alias("amount"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderpriority")).alias("pri"))
    return ops.coalesced(rows, ["k", "day"], ["id"])


@query("first_last_per_key", f"""WITH {SPEND}, x AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY day, o_orderkey) AS a, row_number() OVER (PARTITION BY k ORDER BY day DESC, o_orderkey DESC) AS b FROM spend)
SELECT 'first' AS which, k, o_orderkey, amount FROM x WHERE a = 1 UNION ALL SELECT 'last', k, o_orderkey, amount FROM x WHERE b = 1""")
def first_last_per_key(spark, d):
    rows = spending(spark, d)
    first = ops.first_per_key(rows, "k", [F.asc("day"), F.asc("o_orderkey")]).withColumn("which", F.lit("first"))
    last = ops.first_per_key(rows, "k", [F.desc("day"), F.desc("o_orderkey")]).withColumn("which", F.lit("last"))
    return first.unionByName(last).select("which", "k", "o_orderkey", "amount")


@query("join_subject_left", "SELECT o_orderkey, c_mktsegment, n_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey")
def join_subject_left(spark, d):
    nation = io.table(spark, d, "nation").select("n_nationkey", "n_name")  # a fixed list
    subjects = io.table(spark, d, "customer").join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return io.table(spark, d, "orders").select("o_orderkey", "o_custkey").join(subjects, F.col("o_custkey") == F.col("c_custkey"), "left").select("o_orderkey", "c_mktsegment", "n_name")


@query("code_group_join", f"""WITH {EXPO}, g AS (SELECT DISTINCT p_brand AS brand, p_type AS grp FROM part WHERE p_size <= 3)
SELECT grp, count(*) AS n, count(DISTINCT k) AS keys FROM expo JOIN g USING (brand) GROUP BY grp""")
def code_group_join(spark, d):
    groups = io.table(spark, d, "part").where("p_size <= 3").groupBy(F.col("p_type").alias("grp")).agg(F.array_join(F.collect_set("p_brand"), ", ").alias("codes"))
    groups = io.grouped_codes(groups, "codes").withColumnRenamed("code", "brand")
    return exposures(spark, d).join(groups, "brand").groupBy("grp").agg(F.count("*").alias("n"), F.count_distinct("k").alias("keys"))


_EXPOSED = "SELECT DISTINCT k FROM expo WHERE code = 'PROMO' AND dose > 90000"


@query("semi_join_exposed", f"WITH {EXPO}, {SPEND} SELECT o_orderkey, k FROM spend WHERE k IN ({_EXPOSED})")
def semi_join_exposed(spark, d):
    return spending(spark, d).join(exposures(spark, d).where("code = 'PROMO' AND dose > 90000"), "k", "left_semi").select("o_orderkey", "k")


@query("anti_join_unexposed", f"WITH {EXPO}, {SPEND} SELECT o_orderkey, k FROM spend WHERE k NOT IN ({_EXPOSED})")
def anti_join_unexposed(spark, d):
    return spending(spark, d).join(exposures(spark, d).where("code = 'PROMO' AND dose > 90000"), "k", "left_anti").select("o_orderkey", "k")


@query("detect_binary_columns", "SELECT 'is_open' AS c UNION ALL SELECT 'is_big'")
def detect_binary_columns(spark, d):
    rows = io.table(spark, d, "orders").select((F.col("o_orderstatus") == "O").cast("int").alias("is_open"), (F.col("o_totalprice") > 1e5).cast("double").alias("is_big"), "o_custkey", "o_totalprice")
    return spark.createDataFrame([(c,) for c in ops.binary_columns(rows)], "c string")


@query("sort_nulls_last", "SELECT event_id, v, row_number() OVER (PARTITION BY user_id ORDER BY v NULLS LAST, event_id) AS pos FROM (SELECT event_id, user_id, CASE WHEN event_id % 4 > 0 THEN value END AS v FROM events)")
def sort_nulls_last(spark, d):
    from pyspark.sql import Window

    rows = measures(spark, d).select("event_id", "user_id", F.when(F.col("event_id") % 4 > 0, F.col("value")).alias("v"))
    return rows.select("event_id", "v", F.row_number().over(Window.partitionBy("user_id").orderBy(F.asc_nulls_last("v"), "event_id")).cast("long").alias("pos"))


@query("topk_rows", "(SELECT 'top' AS which, event_id, value FROM events ORDER BY value DESC, event_id LIMIT 25) UNION ALL (SELECT 'bottom', event_id, value FROM events ORDER BY value, event_id LIMIT 25)")
def topk_rows(spark, d):
    rows = measures(spark, d).select("event_id", "value")
    top, bottom = rows.orderBy(F.desc("value"), "event_id").limit(25), rows.orderBy("value", "event_id").limit(25)
    return top.select(F.lit("top").alias("which"), "*").unionByName(bottom.select(F.lit("bottom").alias("which"), "*"))


@query("union_cohorts", "SELECT cohort, count(*) AS n, round(avg(value), 6) AS mean FROM (SELECT 'on' AS cohort, value FROM events WHERE event_type = 'view' UNION ALL SELECT 'off', value FROM events WHERE event_type <> 'view') GROUP BY cohort")
def union_cohorts(spark, d):
    rows = measures(spark, d)
    both = rows.where("event_type = 'view'").withColumn("cohort", F.lit("on")).unionByName(rows.where("event_type <> 'view'").withColumn("cohort", F.lit("off")))
    return both.groupBy("cohort").agg(F.count("*").alias("n"), r(F.avg("value"), 6).alias("mean"))


@query("windowed_summary", "SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL")
def windowed_summary(spark, d):
    from ..streaming import windowed_summary as summary

    return summary(measures(spark, d), "ts", "event_type", "value").withColumn("total", r("total", 2))
