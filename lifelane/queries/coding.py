"""Queries: recoding, pivots, one-hot columns, texts."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from ..functions import coding, schedule
from ..operators import encoding, matching, modelling, series
from ..sources.io import table
from . import Registry
from .base import EXPO, LABS, exposures, flags, measures, r

query = Registry()

_SMOKE = list(coding.SMOKING)


@query("recode_map", f"""WITH s AS (SELECT event_id, list_extract([{", ".join(f"'{x}'" for x in [*_SMOKE, "ukendt"])}], (event_id % {len(_SMOKE) + 1} + 1)::INT) AS raw, CASE event_id % 3 WHEN 0 THEN 'Mand' WHEN 1 THEN 'Kvinde' ELSE 'X' END AS sex FROM events)
SELECT event_id, CASE raw {" ".join(f"WHEN '{a}' THEN '{b}'" for a, b in coding.SMOKING.items())} END AS smoking, CASE sex WHEN 'Mand' THEN 0 WHEN 'Kvinde' THEN 1 END AS sex FROM s""")
def recode_map(spark, d):
    raw = F.element_at(F.array(*[F.lit(x) for x in [*_SMOKE, "ukendt"]]), (F.col("event_id") % (len(_SMOKE) + 1) + 1).cast("int"))
    sex = F.when(F.col("event_id") % 3 == 0, "Mand").when(F.col("event_id") % 3 == 1, "Kvinde").otherwise("X")
    return measures(spark, d).select("event_id", coding.recode(raw, coding.SMOKING).alias("smoking"), coding.recode(sex, coding.SEX).alias("sex"))


@query("normalize_codes", "SELECT CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE upper(trim(p_brand)) END AS code, count(*) AS n FROM part GROUP BY 1")
def normalize_codes(spark, d):
    messy = F.when(F.col("p_partkey") % 5 == 0, F.lit(" nan ")).otherwise(F.concat(F.lit("  "), F.lower("p_brand"), F.lit(" ")))
    return table(spark, d, "part").select(coding.normal_code(messy).alias("code")).groupBy("code").agg(F.count("*").alias("n"))


@query("normalize_labs", f"""WITH {LABS}, x AS (SELECT event_id, user_id, ts, regexp_replace('P-' || test || ';(1)', '[^a-zA-Z0-9]', '', 'g') AS test, flag, CASE WHEN event_id % 9 = 0 THEN NULL WHEN event_id % 9 = 1 THEN 'hemolyse' ELSE 'x1' END AS v, abnormal FROM labs)
SELECT event_id, test, flag, abnormal FROM x WHERE v IS NOT NULL AND NOT (v = 'hemolyse' AND flag = 'Normal')""")
def normalize_labs(spark, d):
    from ..operators import labs

    k = F.col("event_id") % 9
    rows = flags(spark, d).drop("abnormal").withColumn("test", F.concat(F.lit("P-"), "test", F.lit(";(1)"))).withColumn("v", F.when(k == 1, "hemolyse").when(k > 1, "x1"))
    rows = rows.withColumn("flag", F.when(F.col("flag") == "Normal", F.lit("ok?")).otherwise(F.col("flag")))
    return labs.normalized(rows, "ts", "test", "flag", "v").select("event_id", "test", "flag", "abnormal")


_TESTS = ["click", "error", "purchase", "signup", "view"]


@query("pivot_last", f"WITH {LABS} SELECT user_id, date_trunc('hour', ts) AS h, " + ", ".join(f"arg_max(flag, (ts, event_id)) FILTER (test = '{t}') AS lab_{t}" for t in _TESTS) + " FROM labs GROUP BY ALL")
def pivot_last(spark, d):
    rows = flags(spark, d).withColumn("h", F.date_trunc("hour", "ts").cast("timestamp_ntz"))
    return encoding.pivot_last(rows, ["user_id", "h"], "test", "flag", F.struct("ts", "event_id"), _TESTS, "lab_")


@query("pivot_ffill", f"WITH {LABS}, p AS (SELECT user_id, date_trunc('hour', ts) AS h, " + ", ".join(f"arg_max(flag, (ts, event_id)) FILTER (test = '{t}') AS lab_{t}" for t in _TESTS) + " FROM labs GROUP BY ALL) SELECT user_id, h, " + ", ".join(f"last_value(lab_{t} IGNORE NULLS) OVER w AS lab_{t}" for t in _TESTS) + " FROM p WINDOW w AS (PARTITION BY user_id ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
def pivot_ffill(spark, d):
    return series.filled_forward(pivot_last(spark, d), "user_id", "h", [f"lab_{t}" for t in _TESTS])


_LISTS = "lists AS (SELECT k, string_agg(DISTINCT brand, ',' ORDER BY brand) AS codes FROM expo GROUP BY k)"


def _code_lists(spark, d):
    return exposures(spark, d).groupBy("k").agg(F.array_join(F.array_sort(F.collect_set("brand")), ",").alias("codes"))


@query("code_rollup", f"WITH {EXPO}, {_LISTS}, t AS (SELECT k, unnest(string_split(codes, ',')) AS c FROM lists) SELECT k, string_agg(DISTINCT substr(c, 1, 7), ',' ORDER BY substr(c, 1, 7)) AS codes FROM t GROUP BY k")
def code_rollup(spark, d):
    return _code_lists(spark, d).select("k", coding.rolled_up("codes", 7).alias("codes"))


@query("topk_codes", f"WITH {EXPO}, {_LISTS}, t AS (SELECT unnest(string_split(codes, ',')) AS code FROM lists) SELECT code, count(*) AS n FROM t GROUP BY code ORDER BY n DESC, code LIMIT 10")
def topk_codes(spark, d):
    return encoding.top_codes(_code_lists(spark, d), "codes", 10)


@query("multihot_codes", f"WITH {EXPO}, {_LISTS} SELECT k, " + ", ".join(f"list_contains(string_split(codes, ','), 'Brand#{i}')::INT AS has_{i}" for i in range(1, 11)) + " FROM lists")
def multihot_codes(spark, d):
    rows = encoding.multi_hot(_code_lists(spark, d), "codes", [f"Brand#{i}" for i in range(1, 11)])
    return rows.select("k", *[F.col(f"`Brand#{i}`").alias(f"has_{i}") for i in range(1, 11)])


@query("multihot_vector", f"WITH {EXPO}, {_LISTS}, t AS (SELECT k, unnest(string_split(codes, ',')) AS code FROM lists), n AS (SELECT code FROM t GROUP BY code ORDER BY count(*) DESC, code LIMIT 10) SELECT t.k, t.code FROM t SEMI JOIN n USING (code)")
def multihot_vector(spark, d):
    """The ten commonest codes as one sparse vector a row, read back by the names in its metadata."""
    rows = _code_lists(spark, d)
    top = [r.code for r in encoding.top_codes(rows, "codes", 10).collect()]
    out = encoding.multi_hot_vector(rows, "codes", top, "hot")
    names = F.array(*[F.lit(n) for n in modelling.feature_names(out, "hot")])
    at = out.select("k", F.posexplode(vector_to_array("hot")).alias("i", "x")).where("x = 1")
    return at.select("k", F.element_at(names, F.col("i") + 1).alias("code"))


_SEG = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@query("onehot_levels", "SELECT c_custkey, " + ", ".join(f"(c_mktsegment = '{s}')::INT AS seg_{s}" for s in _SEG) + " FROM customer")
def onehot_levels(spark, d):
    rows = table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    return encoding.one_hot(rows, "c_mktsegment", _SEG, "seg_").drop("c_mktsegment")


@query("unpivot_windows", "SELECT o_custkey, name, round(value, 2) AS value FROM (SELECT o_custkey, min(o_totalprice) AS pre, max(o_totalprice) AS post FROM orders GROUP BY 1) UNPIVOT (value FOR name IN (pre, post))")
def unpivot_windows(spark, d):
    rows = table(spark, d, "orders").groupBy("o_custkey").agg(F.min("o_totalprice").alias("pre"), F.max("o_totalprice").alias("post"))
    return encoding.melt(rows, ["o_custkey"], ["pre", "post"]).withColumn("value", r("value", 2))


@query("bin_labels", "SELECT event_id, CASE WHEN value > 0 AND value <= 10 THEN 'low' WHEN value > 10 AND value <= 30 THEN 'mid' WHEN value > 30 AND value <= 100 THEN 'high' END AS closed_right, CASE WHEN value >= 0 AND value < 10 THEN 'low' WHEN value >= 10 AND value < 30 THEN 'mid' WHEN value >= 30 AND value < 100 THEN 'high' END AS closed_left FROM events")
def bin_labels(spark, d):
    cuts, names = [0, 10, 30, 100], ["low", "mid", "high"]
    return measures(spark, d).select("event_id", coding.binned("value", cuts, names).alias("closed_right"), coding.binned("value", cuts, names, right=False).alias("closed_left"))


#: Texts and the categories they must get; also the oracle of schedule_normalize.
SCHEDULES = {
    "1 gang dagligt": "daily 1",
    "2 gange dagligt": "daily 2",
    "to gange om dagen": "daily 2",
    "Morgen, middag og aften": "daily 3",
    "efter behov højst 2 gange dagligt": "as needed",
    "højst 4 gange om ugen": "weekly 4",
    "højst 3 gange": "unspecified 3",
    "tre gange ugentligt": "weekly 3",
    "1 gang om måneden": "monthly 1",
    "2 gange årligt": "yearly 2",
    "hver 8. time": "every 8 hour(s)",
    "hver 2. uge": "every 2 week(s)",
    "hver 3 måneder": "every 3 month(s)",
    "to og fredag": "weekly 2",
    "mandag, onsdag og fredag": "weekly 3",
    "kun 1 gang": "once only",
    "kontinuerligt": "continuous",
    "dagligt": "daily 1",
    "ti gange dagligt": "daily 10",
    "efter aftale": "unspecified",
    "  ": "unspecified",
}


def _texts(spark, d):
    texts = F.array(*[F.lit(t) for t in SCHEDULES])
    return measures(spark, d).select("event_id", F.element_at(texts, (F.col("event_id") % len(SCHEDULES) + 1).cast("int")).alias("text"))


def _categorised(spark, d):
    """Each distinct text is read once and joined back."""
    rows = _texts(spark, d)
    read = rows.select("text").distinct().withColumn("category", schedule.category("text"))
    return rows.join(read, "text").select("event_id", "text", "category")


_VALUES = ", ".join(f"({i}, '{c}')" for i, c in enumerate(SCHEDULES.values()))


@query("schedule_normalize", f"WITH c(i, category) AS (VALUES {_VALUES}) SELECT event_id, category FROM events JOIN c ON event_id % {len(SCHEDULES)} = i")
def schedule_normalize(spark, d):
    return _categorised(spark, d).select("event_id", "category")


_RATE = """CASE WHEN category LIKE 'daily %' THEN n WHEN category LIKE 'weekly %' THEN n / 7 WHEN category LIKE 'monthly %' THEN n / 30 WHEN category LIKE 'yearly %' THEN n / 365.25
WHEN category LIKE '%hour%' THEN 24 / n WHEN category LIKE '%day(s)' THEN 1 / n WHEN category LIKE '%week%' THEN 1 / (n * 7) WHEN category LIKE '%month(s)' THEN 1 / (n * 30) END"""


@query("schedule_to_daily", f"""WITH c(i, category) AS (VALUES {_VALUES}), x AS (SELECT event_id, value, category, TRY_CAST(regexp_extract(category, '[0-9]+') AS DOUBLE) AS n FROM events JOIN c ON event_id % {len(SCHEDULES)} = i)
SELECT event_id, round({_RATE}, 6) AS per_day, round(coalesce({_RATE} * value, value), 6) AS amount FROM x""")
def schedule_to_daily(spark, d):
    rows = _categorised(spark, d).withColumn("per_day", schedule.times_per_day("category")).join(measures(spark, d).select("event_id", "value"), "event_id")
    return rows.select("event_id", r("per_day", 6).alias("per_day"), r(F.coalesce(F.col("per_day") * F.col("value"), "value"), 6).alias("amount"))


@query("code_extract", "SELECT p_partkey, 'DF' || (p_partkey % 900 + 100) AS code, 'DF' || substr((p_partkey % 900 + 100)::VARCHAR, 1, 2) AS short FROM part WHERE p_partkey % 3 > 0 UNION ALL SELECT p_partkey, NULL, NULL FROM part WHERE p_partkey % 3 = 0")
def code_extract(spark, d):
    number = (F.col("p_partkey") % 900 + 100).cast("string")
    text = F.when(F.col("p_partkey") % 3 == 1, F.concat("p_name", F.lit(" (DF"), number, F.lit(")"))).when(F.col("p_partkey") % 3 == 2, F.concat(F.lit("[DF"), number, F.lit("]-"), "p_name")).otherwise(F.col("p_name"))
    return table(spark, d, "part").select("p_partkey", coding.embedded_code(text).alias("code")).withColumn("short", coding.short_code("code"))


_REF = "ref AS (SELECT min(p_partkey) AS ref_id, p_name AS ref_text FROM part GROUP BY p_name)"


@query("fuzzy_lookup_join", f"""WITH {_REF}, t AS (SELECT DISTINCT substr(p_name, 1, 3) || substr(p_name, 5) AS text FROM part),
s AS (SELECT text, ref_id, (1 - levenshtein(text, ref_text)::DOUBLE / greatest(length(text), length(ref_text))) * 100 AS score FROM t, ref)
SELECT text, ref_id, round(score, 6) AS score FROM s WHERE score >= 85 QUALIFY row_number() OVER (PARTITION BY text ORDER BY score DESC, ref_id) = 1""")
def fuzzy_lookup_join(spark, d):
    part = table(spark, d, "part")
    ref = part.groupBy(F.col("p_name").alias("ref_text")).agg(F.min("p_partkey").alias("ref_id"))
    texts = part.select(F.concat(F.substring("p_name", 1, 3), F.substring("p_name", 5, 100)).alias("text"))
    return matching.best_reference(texts, "text", ref, "ref_text", "ref_id", 85.0).withColumn("score", r("score", 6))


@query("code_completion", f"""WITH {_REF}, x AS (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_name || ' (DF200)' ELSE substr(p_name, 1, 3) || substr(p_name, 5) END AS text FROM part),
t AS (SELECT DISTINCT text FROM x WHERE text NOT LIKE '%(DF200)'), s AS (SELECT text, ref_id, (1 - levenshtein(text, ref_text)::DOUBLE / greatest(length(text), length(ref_text))) * 100 AS score FROM t, ref),
best AS (SELECT text, ref_id FROM s WHERE score >= 85 QUALIFY row_number() OVER (PARTITION BY text ORDER BY score DESC, ref_id) = 1)
SELECT p_partkey, CASE WHEN x.text LIKE '%(DF200)' THEN 'DF200' ELSE 'R' || ref_id END AS code FROM x LEFT JOIN best USING (text)""")
def code_completion(spark, d):
    """The code of a description: one embedded in it, else that of the best-matching reference text."""
    part = table(spark, d, "part")
    ref = part.groupBy(F.col("p_name").alias("ref_text")).agg(F.min("p_partkey").alias("ref_id"))
    rows = part.select("p_partkey", F.when(F.col("p_partkey") % 2 == 0, F.concat("p_name", F.lit(" (DF200)"))).otherwise(F.concat(F.substring("p_name", 1, 3), F.substring("p_name", 5, 100))).alias("text"))
    rows = rows.withColumn("code", coding.embedded_code("text"))
    best = matching.best_reference(rows.where("code IS NULL"), "text", ref, "ref_text", "ref_id", 85.0)
    return rows.join(best, "text", "left").select("p_partkey", F.coalesce("code", F.concat(F.lit("R"), "ref_id")).alias("code"))


@query("any_of_flag", "SELECT o_orderkey, (o_orderpriority IN ('1-URGENT', '2-HIGH'))::INT AS pressing FROM orders")
def any_of_flag(spark, d):
    rows = encoding.one_hot(table(spark, d, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", ["1-URGENT", "2-HIGH", "5-LOW"], "p_")
    return encoding.any_of(rows, ["p_1-URGENT", "p_2-HIGH"], "pressing").select("o_orderkey", "pressing")


@query("retyped_columns", "SELECT event_id, nullif(event_type, 'view') AS kind, CASE WHEN event_id % 3 = 0 THEN NULL WHEN value > 20 THEN 1 ELSE 0 END AS big, (user_id % 2 = 0)::INT AS even FROM events")
def retyped_columns(spark, d):
    rows = table(spark, d, "events").select("event_id", F.replace("event_type", F.lit("view"), F.lit("None")).alias("kind"), F.when(F.col("event_id") % 3 == 0, "None").when(F.col("value") > 20, "True").otherwise("False").alias("big"), (F.col("user_id") % 2 == 0).alias("even"))
    return encoding.retyped(rows)


_SHOWN = {"p": "Priority", "p_5": "Fifth", "status": "Status"}


@query("shown_names", """WITH n AS (SELECT DISTINCT 'p_' || o_orderpriority AS name FROM orders UNION SELECT DISTINCT 'status_' || o_orderstatus FROM orders UNION SELECT unnest(['status', 'p', 'p_5', 'other_x']))
SELECT name, CASE WHEN name = 'status' THEN 'Status' WHEN name = 'p' THEN 'Priority' WHEN name = 'p_5' THEN 'Fifth' WHEN starts_with(name, 'p_') THEN 'Priority: ' || substr(name, 3) WHEN starts_with(name, 'status_') THEN 'Status: ' || substr(name, 8) ELSE name END AS shown FROM n""")
def shown_names(spark, d):
    orders = table(spark, d, "orders")
    more = orders.select(F.explode(F.array(*map(F.lit, ("status", "p", "p_5", "other_x")))).alias("name"))
    names = orders.select(F.concat(F.lit("p_"), "o_orderpriority").alias("name")).union(orders.select(F.concat(F.lit("status_"), "o_orderstatus"))).union(more).distinct()
    return encoding.with_shown_names(names, "name", _SHOWN)


@query("group_basic", f"WITH {EXPO} SELECT code, count(*) AS n, round(avg(dose), 4) AS mean, min(dose) AS lo, max(dose) AS hi, round(sum(dose), 2) AS total, bool_or(rf = 'A') AS any_a FROM expo GROUP BY code")
def group_basic(spark, d):
    return exposures(spark, d).groupBy("code").agg(F.count("*").alias("n"), r(F.avg("dose")).alias("mean"), F.min("dose").alias("lo"), F.max("dose").alias("hi"), r(F.sum("dose"), 2).alias("total"), F.bool_or(F.col("rf") == "A").alias("any_a"))


@query("distinct_counts", f"WITH {EXPO} SELECT code, count(DISTINCT k) AS keys, count(DISTINCT brand) AS brands, count(*) AS n FROM expo GROUP BY code")
def distinct_counts(spark, d):
    return exposures(spark, d).groupBy("code").agg(F.count_distinct("k").alias("keys"), F.count_distinct("brand").alias("brands"), F.count("*").alias("n"))


@query("cohort_finalize", "SELECT o_orderkey, o_totalprice FROM orders")
def cohort_finalize(spark, d):
    """Columns go by list, prefix and suffix."""
    from ..plans import cohorts

    return cohorts.without_columns(table(spark, d, "orders"), names=("o_custkey",), prefixes=("o_order_", "o_orderp"), suffixes=("status", "date"))


