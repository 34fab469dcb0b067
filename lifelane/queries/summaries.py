"""Queries: disclosure-safe summaries, tests, correlations, trajectories."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import ranks
from ..operators import correlations, disclosure, evaluation, stats
from ..sources.io import table
from . import Registry
from .base import EXPO, exposures, measures, r

query = Registry()


@query("group_quantiles", "SELECT event_type, round(quantile_cont(value, 0.25), 6) AS q1, round(quantile_cont(value, 0.5), 6) AS q2, round(quantile_cont(value, 0.75), 6) AS q3 FROM events GROUP BY 1")
def group_quantiles(spark, d):
    rows = ranks.quantiles(measures(spark, d), "value", {"q1": 0.25, "q2": 0.5, "q3": 0.75}, ("event_type",))
    return rows.select("event_type", *[r(c, 6).alias(c) for c in ("q1", "q2", "q3")])


#: A person's days of the week are groups of very different sizes, some below five.
_SORTED = "x AS (SELECT user_id, dayofweek(ts) AS day, list_sort(list(value)) AS v FROM events GROUP BY ALL)"


@query("pseudo_minmedmax", f"""WITH {_SORTED}, y AS (SELECT user_id, day, v, len(v) AS n, greatest(len(v) // 2 - 2, 0) AS m FROM x)
SELECT user_id, day, CASE WHEN n >= 5 THEN round(list_avg(v[1:5]), 6) END AS pseudo_min, CASE WHEN n >= 5 THEN round(list_avg(v[m + 1:m + 5]), 6) END AS pseudo_median, CASE WHEN n >= 5 THEN round(list_avg(v[n - 4:n]), 6) END AS pseudo_max FROM y""")
def pseudo_minmedmax(spark, d):
    rows = measures(spark, d).withColumn("day", (F.dayofweek("ts") - 1).cast("long"))
    rows = disclosure.pseudo_extremes(rows, "value", ("user_id", "day"))
    return rows.select("user_id", "day", *[r(c, 6).alias(c) for c in ("pseudo_min", "pseudo_median", "pseudo_max")])


@query("pseudo_quantile", """WITH q AS (SELECT event_type, quantile_cont(value, 0.25) AS q FROM events GROUP BY 1),
k AS (SELECT event_type, value FROM events JOIN q USING (event_type) QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY abs(value - q), value) <= 5) SELECT event_type, round(avg(value), 6) AS pseudo_quantile FROM k GROUP BY 1""")
def pseudo_quantile(spark, d):
    rows = disclosure.pseudo_quantile(measures(spark, d), "value", 0.25, ("event_type",))
    return rows.select("event_type", r("pseudo_quantile", 6).alias("pseudo_quantile"))


@query("rounded_counts", f"WITH {EXPO}, c AS (SELECT code, brand, count(*) AS n FROM expo GROUP BY ALL) SELECT code, brand, (CASE WHEN n % 5 IN (1, 2) THEN n // 5 WHEN n % 5 = 0 THEN n // 5 ELSE n // 5 + 1 END * 5)::BIGINT AS n FROM c")
def rounded_counts(spark, d):
    return exposures(spark, d).groupBy("code", "brand").agg(F.count("*").alias("c")).select("code", "brand", disclosure.rounded_count(F.col("c")).alias("n"))


@query("kgroup_medians", """WITH x AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events)
SELECT user_id, least(i // 5, n // 5 - 1) AS part, round(median(value), 6) AS median FROM x WHERE n >= 5 GROUP BY ALL""")
def kgroup_medians(spark, d):
    return disclosure.group_medians(measures(spark, d), "value", ("user_id",)).withColumn("median", r("median", 6))


_PROFILE = "prof AS (SELECT unnest(['amount', 'is_open', 'holes']) AS name, unnest([o_totalprice, (o_orderstatus = 'O')::INT::DOUBLE, CASE WHEN o_orderkey % 3 > 0 THEN o_totalprice END]) AS v FROM orders)"


@query("column_profile", f"""WITH {_PROFILE}, s AS (SELECT name, list_sort(list(v) FILTER (v IS NOT NULL)) AS l, count(*) AS n, avg((v IS NULL)::INT) * 100 AS miss, avg(v) AS mean, bool_and(v IN (0, 1)) AS b, count(*) FILTER (v = 1) AS t, count(*) FILTER (v = 0) AS f FROM prof GROUP BY name), z AS (SELECT *, len(l) AS k FROM s)
SELECT name, n, round(miss, 4) AS missing_percent, CASE WHEN b THEN t END AS true_count, CASE WHEN b THEN f END AS false_count, CASE WHEN NOT b THEN round(mean, 4) END AS mean, CASE WHEN NOT b THEN round(list_avg(l[1:5]), 4) END AS pseudo_min,
CASE WHEN NOT b THEN round(list_avg(l[k // 2 - 1:k // 2 + 3]), 4) END AS pseudo_median, CASE WHEN NOT b THEN round(list_avg(l[k - 4:k]), 4) END AS pseudo_max FROM z""")
def column_profile(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_totalprice").alias("amount"), (F.col("o_orderstatus") == "O").cast("double").alias("is_open"), F.when(F.col("o_orderkey") % 3 > 0, F.col("o_totalprice")).alias("holes"))
    out = disclosure.column_profile(rows, ["amount", "is_open", "holes"])
    return out.select(F.col("column").alias("name"), "n", r("missing_percent").alias("missing_percent"), "true_count", "false_count", *[r(c).alias(c) for c in ("mean", "pseudo_min", "pseudo_median", "pseudo_max")])


_MIXED = """mix AS (SELECT o_orderkey, o_totalprice, (o_orderstatus = 'O') AS is_open, (o_orderstatus = 'F')::INT AS is_final, CASE WHEN o_orderkey % 3 > 0 THEN o_orderdate END AS seen, o_orderdate::DATE AS day, o_totalprice::DECIMAL(12,2) AS exact, o_orderpriority AS pri,
  CASE WHEN o_orderkey % 4 = 0 THEN o_custkey::VARCHAR WHEN o_orderkey % 4 = 1 THEN 'none' END AS said FROM orders)"""
_NUMBERS = {"o_orderkey": ("number", "o_orderkey::DOUBLE"), "o_totalprice": ("number", "o_totalprice"), "exact": ("exact", "exact::DOUBLE"), "pri": ("text", "NULL::DOUBLE"), "said": ("text", "TRY_CAST(said AS DOUBLE)")}
_NONE = "NULL::BIGINT AS true_count, NULL::BIGINT AS false_count, NULL::DOUBLE AS true_percent, NULL::DOUBLE AS false_percent"
_NO_AT = ", ".join(f"NULL::TIMESTAMP AS {c}" for c in ("mean_at", "first_at", "middle_at", "last_at"))
_ends = lambda l: f"round(list_avg({l}[1:5]), 4) AS pseudo_min, round(list_avg({l}[len({l}) // 2 - 1:len({l}) // 2 + 3]), 4) AS pseudo_median, round(list_avg({l}[-5:]), 4) AS pseudo_max"  # noqa: E731, E741
_at = lambda l: f"make_timestamp((list_sum({l}) // len({l}))::BIGINT)"  # noqa: E731, E741
_PROFILES = [
    *[f"SELECT '{c}' AS name, '{k}' AS kind, count(*) AS n, round(avg(({c} IS NULL)::INT) * 100, 4) AS missing_percent, {_NONE}, round(avg({v}), 4) AS mean, {_ends(f'(list({v} ORDER BY {v}) FILTER ({v} IS NOT NULL))')}, {_NO_AT} FROM mix" for c, (k, v) in _NUMBERS.items()],
    *[f"SELECT '{c}', '{k}', count(*), 0, count(*) FILTER ({c}::INT = 1), count(*) FILTER ({c}::INT = 0), round(avg({c}::INT) * 100, 4), round(avg(1 - {c}::INT) * 100, 4), NULL, NULL, NULL, NULL, {_NO_AT} FROM mix" for c, k in (("is_open", "truth"), ("is_final", "number"))],
    *[f"SELECT '{c}', 'instant', any_value(n), any_value(m), {_NONE}, NULL, NULL, NULL, NULL, {_at('l')}, {_at('l[1:5]')}, {_at('l[len(l) // 2 - 1:len(l) // 2 + 3]')}, {_at('l[-5:]')} FROM (SELECT count(*) AS n, round(avg(({c} IS NULL)::INT) * 100, 4) AS m, list(epoch_us({c}) ORDER BY {c}) FILTER ({c} IS NOT NULL) AS l FROM mix) GROUP BY l" for c in ("seen", "day")],
]


@query("column_profile_mixed", f"WITH {_MIXED} " + " UNION ALL ".join(_PROFILES))
def column_profile_mixed(spark, d):
    """Numbers, decimals, truth values, instants, dates and texts in one profile."""
    o = table(spark, d, "orders")
    said = F.when(F.col("o_orderkey") % 4 == 0, F.col("o_custkey").cast("string")).when(F.col("o_orderkey") % 4 == 1, "none")
    rows = o.select("o_orderkey", "o_totalprice", (F.col("o_orderstatus") == "O").alias("is_open"), (F.col("o_orderstatus") == "F").cast("int").alias("is_final"), F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderdate")).alias("seen"), F.col("o_orderdate").cast("date").alias("day"), F.col("o_totalprice").cast("decimal(12,2)").alias("exact"), F.col("o_orderpriority").alias("pri"), said.alias("said"))
    out = disclosure.column_profile(rows)
    digits = ["missing_percent", "true_percent", "false_percent", "mean", "pseudo_min", "pseudo_median", "pseudo_max"]
    return out.withColumnRenamed("column", "name").withColumns({c: r(c) for c in digits})


_PUB = {"Amount": "o_totalprice", "Customer": "CASE WHEN o_orderkey % 7 > 0 THEN o_custkey::DOUBLE END"}
_CO = "co AS (SELECT (o_orderpriority < '3') AS f, " + ", ".join(f"{c} AS v{i}" for i, c in enumerate(_PUB.values())) + " FROM orders)"


def _near(i: int, share: float) -> str:
    return f"(SELECT f, avg(v) AS q FROM (SELECT co.f, v{i} AS v, row_number() OVER (PARTITION BY co.f ORDER BY abs(v{i} - q), v{i}) AS o FROM co JOIN (SELECT f, quantile_cont(v{i}, {share}) AS q FROM co GROUP BY f) t ON t.f = co.f WHERE v{i} IS NOT NULL) WHERE o <= 5 GROUP BY f)"


def _published(i: int, label: str) -> str:
    desc = f"""b{i} AS (SELECT f, count(*) AS n, count(v{i}) AS c, avg(v{i}) AS m, stddev_samp(v{i}) AS sd, list_sort(list(v{i}) FILTER (v{i} IS NOT NULL)) AS l FROM co GROUP BY f),
t{i} AS (SELECT b{i}.f, n, [printf('%.2f (%.2f)', m, sd), printf('%.2f [%.2f, %.2f]', q2.q, q1.q, q3.q), printf('%.2f–%.2f', list_avg(l[1:5]), list_avg(l[-5:])), printf('~%d (%.1f%%)', (round_even((n - c) / 5.0, 0) * 5)::BIGINT, (n - c) * 100.0 / n)] AS txt
  FROM b{i} JOIN {_near(i, 0.25)} q1 ON q1.f = b{i}.f JOIN {_near(i, 0.5)} q2 ON q2.f = b{i}.f JOIN {_near(i, 0.75)} q3 ON q3.f = b{i}.f),
k{i} AS (SELECT f, rank() OVER (ORDER BY v{i}) + (count(*) OVER (PARTITION BY v{i}) - 1) / 2.0 AS rk FROM co WHERE v{i} IS NOT NULL), u{i} AS (SELECT count(*) FILTER (f) AS n1, count(*) FILTER (NOT f) AS n2, sum(rk) FILTER (f) AS s FROM k{i})"""
    rows = f"""SELECT {i} * 4 + j AS place, '{label}' AS label, ['Mean (SD)', 'Median [IQR]', 'Range', 'Missing n (%)'][j + 1] AS statistic, a.txt[j + 1] AS first, b.txt[j + 1] AS second, CASE WHEN j = 0 THEN printf('%.3f', abs(1 - 2 * (s - n1 * (n1 + 1) / 2) / (n1 * n2))) ELSE '' END AS effect,
 (round_even(a.n / 5.0, 0) * 5)::BIGINT AS n_first, (round_even(b.n / 5.0, 0) * 5)::BIGINT AS n_second FROM t{i} a JOIN t{i} b ON a.f AND NOT b.f, u{i}, range(4) r(j)"""
    return desc + "\x00" + rows


_BOTH = [_published(i, label).split("\x00") for i, label in enumerate(_PUB)]


@query("publication_table_columns", f"WITH {_CO}, {', '.join(a for a, _ in _BOTH)} " + " UNION ALL ".join(b for _, b in _BOTH))
def publication_table_columns(spark, d):
    """Several columns of two cohorts: mean, safe median and range, missing share, effect and rounded sizes; p has its own query."""
    o = table(spark, d, "orders")
    rows = o.select("o_orderpriority", F.col("o_totalprice").alias("amount"), F.when(F.col("o_orderkey") % 7 > 0, F.col("o_custkey").cast("double")).alias("customer"))
    out = disclosure.publication_table(rows, F.col("o_orderpriority") < "3", {"Amount": "amount", "Customer": "customer"})
    return out.drop("p").withColumn("place", F.col("place").cast("long"))


#: The tail of the normal distribution by Simpson's rule from 0 to |z|.
_NORMAL = "(SELECT 1 - 2 * sum(CASE WHEN i IN (0, 4000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * exp(-pow(i * abs({z}) / 4000, 2) / 2)) / sqrt(2 * pi()) * abs({z}) / 12000 FROM range(0, 4001) r(i))"


@query("rank_test_p", f"""WITH g AS (SELECT o_orderpriority AS grp, o_orderstatus = 'O' AS f, o_totalprice AS v FROM orders), m AS (SELECT grp, f, rank() OVER (PARTITION BY grp ORDER BY v) + (count(*) OVER (PARTITION BY grp, v) - 1) / 2.0 AS rk, count(*) OVER (PARTITION BY grp, v) AS ties FROM g),
s AS (SELECT grp, sum(rk) FILTER (f) AS r1, count(*) FILTER (f) AS n1, count(*) AS n, sum(ties * ties - 1)::DOUBLE AS t FROM m GROUP BY grp), u AS (SELECT grp, n1, n - n1 AS n2, n, t, r1 - n1 * (n1 + 1) / 2 AS u FROM s),
z AS (SELECT grp, n1, n2, u, (u - n1 * n2 / 2) / sqrt(n1 * n2 / 12.0 * (n + 1 - t / (n * (n - 1)))) AS z FROM u) SELECT grp, n1, n2, round(u, 2) AS u, round({_NORMAL.format(z='z')}, 5) AS p FROM z""")
def rank_test_p(spark, d):
    """The rank test with its p in several groups at once; the SQL integrates the density."""
    rows = table(spark, d, "orders").select(F.col("o_orderpriority").alias("grp"), (F.col("o_orderstatus") == "O").alias("f"), F.col("o_totalprice").alias("v"))
    return stats.mann_whitney(rows, "v", F.col("f"), ("grp",)).select("grp", "n1", "n2", r("u", 2).alias("u"), r("p", 5).alias("p"))


@query("publication_table", f"""WITH c AS (SELECT CASE WHEN event_type = 'view' THEN 'on' ELSE 'off' END AS cohort, value FROM events), b AS (SELECT cohort, avg(value) AS m, stddev_samp(value) AS sd, avg((value IS NULL)::INT) AS missing FROM c GROUP BY 1),
q AS (SELECT b.*, k1.v AS q1, k2.v AS q2, k3.v AS q3 FROM b {" ".join(f"JOIN (SELECT cohort, avg(value) AS v FROM (SELECT c.*, row_number() OVER (PARTITION BY cohort ORDER BY abs(value - q), value) AS i FROM c JOIN (SELECT cohort, quantile_cont(value, {share}) AS q FROM c GROUP BY 1) USING (cohort)) WHERE i <= 5 GROUP BY 1) k{i} USING (cohort)" for i, share in ((1, 0.25), (2, 0.5), (3, 0.75)))}),
rk AS (SELECT *, rank() OVER (ORDER BY value) + (count(*) OVER (PARTITION BY value) - 1) / 2.0 AS rk FROM c), u AS (SELECT count(*) FILTER (WHERE cohort = 'on') AS n1, count(*) AS n, sum(rk) FILTER (WHERE cohort = 'on') AS s FROM rk)
SELECT cohort, printf('%.2f (%.2f)', m, sd) AS mean_sd, printf('%.2f [%.2f; %.2f]', q2, q1, q3) AS median_iqr, printf('%.1f %%', missing * 100) AS missing, round(abs(1 - 2 * (s - n1 * (n1 + 1) / 2) / (n1 * (n - n1))), 6) AS effect FROM q, u""")
def publication_table(spark, d):
    """Two cohorts side by side: mean (SD), safe median [quartiles], missing share, size of the effect."""
    rows = measures(spark, d).withColumn("cohort", F.when(F.col("event_type") == "view", "on").otherwise("off"))
    base = rows.groupBy("cohort").agg(F.avg("value").alias("m"), F.stddev_samp("value").alias("sd"), F.avg(F.col("value").isNull().cast("double")).alias("missing"))
    parts = [disclosure.pseudo_quantile(rows, "value", q, ("cohort",)).withColumnRenamed("pseudo_quantile", n) for n, q in (("q1", 0.25), ("q2", 0.5), ("q3", 0.75))]
    for p in parts:
        base = base.join(p, "cohort")
    test = stats.mann_whitney(rows, "value", F.col("cohort") == "on").select(r(F.abs("rank_biserial"), 6).alias("effect"))
    text = base.select("cohort", F.format_string("%.2f (%.2f)", "m", "sd").alias("mean_sd"), F.format_string("%.2f [%.2f; %.2f]", "q2", "q1", "q3").alias("median_iqr"), F.format_string("%.1f %%", F.col("missing") * 100).alias("missing"))
    return text.crossJoin(test)


_GRP = "(event_type = 'view')"
_MID = "SELECT *, rank() OVER (ORDER BY value) + (count(*) OVER (PARTITION BY value) - 1) / 2.0 AS rk, count(*) OVER (PARTITION BY value) AS ties FROM events"


@query("mann_whitney", f"""WITH m AS ({_MID}), s AS (SELECT sum(rk) FILTER {_GRP.replace("(", "(WHERE ", 1)} AS r1, count(*) FILTER (WHERE event_type = 'view') AS n1, count(*) AS n, sum(ties * ties - 1)::DOUBLE AS t FROM m),
u AS (SELECT n1, n - n1 AS n2, n, t, r1 - n1 * (n1 + 1) / 2 AS u FROM s)
SELECT n1, n2, round(u, 4) AS u, round((u - n1 * n2 / 2) / sqrt(n1 * n2 / 12.0 * (n + 1 - t / (n * (n - 1)))), 6) AS z, round(1 - 2 * u / (n1 * n2), 6) AS rank_biserial FROM u""")
def mann_whitney(spark, d):
    out = stats.mann_whitney(measures(spark, d), "value", F.col("event_type") == "view")
    return out.select("n1", "n2", r("u").alias("u"), r("z", 6).alias("z"), r("rank_biserial", 6).alias("rank_biserial"))


_M = "m AS (SELECT count(*) FILTER (WHERE event_type = 'view') AS n1, count(*) FILTER (WHERE event_type <> 'view') AS n2, avg(value) FILTER (WHERE event_type = 'view') AS a, avg(value) FILTER (WHERE event_type <> 'view') AS b, var_samp(value) FILTER (WHERE event_type = 'view') AS v, var_samp(value) FILTER (WHERE event_type <> 'view') AS w, avg((value > 20)::INT) FILTER (WHERE event_type = 'view') AS p, avg((value > 20)::INT) FILTER (WHERE event_type <> 'view') AS q FROM events)"


@query("welch_t", f"WITH {_M} SELECT n1, n2, round(a - b, 6) AS difference, round((a - b) / sqrt(v / n1 + w / n2), 6) AS t, round(pow(v / n1 + w / n2, 2) / (pow(v / n1, 2) / (n1 - 1) + pow(w / n2, 2) / (n2 - 1)), 4) AS df FROM m")
def welch_t(spark, d):
    out = stats.welch(measures(spark, d), "value", F.col("event_type") == "view")
    return out.select("n1", "n2", r("difference", 6).alias("difference"), r("t", 6).alias("t"), r("df").alias("df"))


#: Simpson's rule over the density of Student's t from 0 to |t|.
_TAIL = """(SELECT 1 - 2 * sum(CASE WHEN i IN (0, 4000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * exp(lgamma(({df} + 1) / 2) - lgamma({df} / 2)) / sqrt({df} * pi()) * pow(1 + pow(i * abs({t}) / 4000, 2) / {df}, -({df} + 1) / 2)) * abs({t}) / 12000 FROM range(0, 4001) r(i))"""
_T = "t AS (SELECT n1, n2, a - b AS d, sqrt(v / n1 + w / n2) AS se, (a - b) / sqrt(v / n1 + w / n2) AS t, pow(v / n1 + w / n2, 2) / (pow(v / n1, 2) / (n1 - 1) + pow(w / n2, 2) / (n2 - 1)) AS df FROM m)"


@query("welch_p", f"WITH {_M}, {_T}, z AS (SELECT *, 1.959963984540054 AS z FROM t), q AS (SELECT *, z + (pow(z, 3) + z) / (4 * df) + (5 * pow(z, 5) + 16 * pow(z, 3) + 3 * z) / (96 * df * df) AS c FROM z) SELECT round({_TAIL.format(t='t', df='df')}, 6) AS p, round(d - c * se, 4) AS lo, round(d + c * se, 4) AS hi FROM q")
def welch_p(spark, d):
    """p and the 95 % interval of the difference; the SQL integrates the density and expands the quantile."""
    return stats.welch(measures(spark, d), "value", F.col("event_type") == "view").select(r("p", 6).alias("p"), r("lo").alias("lo"), r("hi").alias("hi"))


_RANKED = "rk AS (SELECT *, rank() OVER (ORDER BY value) + (count(*) OVER (PARTITION BY value) - 1) / 2.0 AS rk FROM events)"


@query("two_group_compare", f"""WITH {_M}, {_T}, {_RANKED}, g AS (SELECT CASE WHEN event_type = 'view' THEN 'first' ELSE 'second' END AS grp, value FROM events), mm AS (SELECT grp, avg(value) AS mu FROM g GROUP BY 1),
s AS (SELECT grp, count(*) AS n, avg(value) AS mean, stddev_samp(value) AS sd, median(value) AS median, avg(pow(value - mu, 3)) / pow(avg(pow(value - mu, 2)), 1.5) AS sk, avg(pow(value - mu, 4)) / pow(avg(pow(value - mu, 2)), 2) - 3 AS ku FROM g JOIN mm USING (grp) GROUP BY 1),
j AS (SELECT *, n / 6 * (sk * sk + ku * ku / 4) AS jb FROM s), u AS (SELECT sum(rk) - count(*) * (count(*) + 1) / 2 AS u FROM rk WHERE event_type = 'view')
SELECT grp, n, round(mean, 4) AS mean, round(sd, 4) AS sd, round(median, 4) AS median, round(jb, 3) AS jb, (SELECT max(jb) < 5.99 FROM j) AS normal, CASE WHEN (SELECT max(jb) < 5.99 FROM j) THEN 'welch' ELSE 'mann_whitney' END AS test, round(t, 4) AS welch_t, round(df, 3) AS df, round(u, 2) AS u FROM j, t, u""")
def two_group_compare(spark, d):
    out = stats.compare_groups(measures(spark, d), "value", F.col("event_type") == "view")
    return out.select("grp", "n", r("mean").alias("mean"), r("sd").alias("sd"), r("median").alias("median"), r("jb", 3).alias("jb"), "normal", "test", r("welch_t").alias("welch_t"), r("df", 3).alias("df"), r("u", 2).alias("u"))


@query("wilcoxon_paired", """WITH p AS (SELECT user_id, round(avg(value) FILTER (WHERE event_type = 'view'), 2) - round(avg(value) FILTER (WHERE event_type = 'click'), 2) AS d FROM events GROUP BY 1), q AS (SELECT round(abs(d), 2) AS m, d > 0 AS up FROM p WHERE d <> 0),
k AS (SELECT *, rank() OVER (ORDER BY m) + (count(*) OVER (PARTITION BY m) - 1) / 2.0 AS rk FROM q) SELECT count(*) AS n, coalesce(sum(rk) FILTER (WHERE up), 0)::DOUBLE AS w_plus, coalesce(sum(rk) FILTER (WHERE NOT up), 0)::DOUBLE AS w_minus FROM k""")
def wilcoxon_paired(spark, d):
    per = measures(spark, d).groupBy("user_id").agg(*[r(F.avg(F.when(F.col("event_type") == k, F.col("value"))), 2).alias(k) for k in ("view", "click")])
    per = per.select(r(F.col("view") - F.col("click"), 2).alias("a"), F.lit(0.0).alias("b"))
    return stats.wilcoxon(per, "a", "b").select("n", "w_plus", "w_minus")


@query("smd", f"WITH {_M} SELECT round((a - b) / sqrt((v + w) / 2), 6) AS continuous, round((p - q) / sqrt((p * (1 - p) + q * (1 - q)) / 2), 6) AS binary FROM m")
def smd(spark, d):
    rows = measures(spark, d).withColumn("big", (F.col("value") > 20).cast("int"))
    return stats.standard_differences(rows, "value", "big", F.col("event_type") == "view").select(r("continuous", 6).alias("continuous"), r("binary", 6).alias("binary"))


_LI = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _ranked(pairs: list[tuple[str, str]], where: str = "true") -> str:
    parts = []
    for a, b in pairs:
        mid = lambda c: f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0"
        parts.append(f"SELECT '{a}' AS a, '{b}' AS b, round(corr(x, y), 6) AS rho, count(*) AS n FROM (SELECT {mid(a)} AS x, {mid(b)} AS y FROM li WHERE {a} IS NOT NULL AND {b} IS NOT NULL)")
    return f"WITH li AS (SELECT l_quantity, l_extendedprice, CASE WHEN l_linenumber <> 3 THEN l_discount END AS l_discount, l_tax FROM lineitem WHERE {where}) " + " UNION ALL ".join(parts)


def _numbers(spark, d):
    return table(spark, d, "lineitem").select("l_quantity", "l_extendedprice", F.when(F.col("l_linenumber") != 3, F.col("l_discount")).alias("l_discount"), "l_tax")


@query("spearman_top", "SELECT a AS feature, rho, n FROM (" + _ranked([(c, "l_extendedprice") for c in _LI if c != "l_extendedprice"]) + ")")
def spearman_top(spark, d):
    out = correlations.spearman(_numbers(spark, d), [c for c in _LI if c != "l_extendedprice"], "l_extendedprice").orderBy(F.desc("rho"), "feature").limit(25)
    return out.select("feature", r("rho", 6).alias("rho"), "n")


@query("spearman_pairwise", _ranked([(a, b) for i, a in enumerate(_LI) for b in _LI[i + 1 :]]))
def spearman_pairwise(spark, d):
    return correlations.spearman_pairs(_numbers(spark, d), _LI).withColumn("rho", r("rho", 6)).drop("p")


@query("spearman_p", f"SELECT a, b, round({_TAIL.format(t='(rho * sqrt((n - 2) / (1 - rho * rho)))', df='(n - 2)::DOUBLE')}, 6) AS p FROM ({_ranked([(a, b) for i, a in enumerate(_LI) for b in _LI[i + 1 :]]).replace('round(corr(x, y), 6)', 'corr(x, y)')})")
def spearman_p(spark, d):
    return correlations.spearman_pairs(_numbers(spark, d), _LI).select("a", "b", r("p", 6).alias("p"))


@query("spearman_matrix", _ranked([(a, b) for i, a in enumerate(_LI) for b in _LI[i + 1 :]]).replace("CASE WHEN l_linenumber <> 3 THEN l_discount END", "CASE WHEN l_linenumber <> 3 THEN l_discount ELSE 0 END"))
def spearman_matrix(spark, d):
    """Nulls count as 0 in the full matrix."""
    return correlations.spearman_pairs(_numbers(spark, d).na.fill(0.0), _LI).withColumn("rho", r("rho", 6)).drop("p")


@query("loess_trend", """WITH m AS (SELECT l_quantity::INT AS x, avg(l_extendedprice) AS y FROM lineitem GROUP BY 1), p AS (SELECT a.x AS x0, b.x, b.y, abs(b.x - a.x)::DOUBLE AS d, row_number() OVER (PARTITION BY a.x ORDER BY abs(b.x - a.x), b.x) AS r, greatest(ceil(count(*) OVER (PARTITION BY a.x) * 0.3), 2) AS k FROM m a, m b),
n AS (SELECT *, max(d) OVER (PARTITION BY x0) AS h FROM p WHERE r <= k), w AS (SELECT x0, (x - x0)::DOUBLE AS c, y, pow(1 - pow(least(d / (h * 1.0000001), 1.0), 3), 3) AS w FROM n),
s AS (SELECT x0, sum(w) AS s, sum(w * c) AS sx, sum(w * y) AS sy, sum(w * c * c) AS xx, sum(w * c * y) AS xy FROM w GROUP BY x0) SELECT x0 AS x, round((xx * sy - sx * xy) / (s * xx - sx * sx), 4) AS fit FROM s""")
def loess_trend(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_quantity").cast("int").alias("age"), "l_extendedprice")
    return stats.loess(rows, "age", "l_extendedprice").withColumn("fit", r("fit"))


def _lowess_sql(share: float, passes: int) -> str:
    """The loop as common tables: m0 the means, f<i> the i-th fit, m<i> the points with the weights of the fit before."""
    parts = ["m0 AS (SELECT l_linestatus AS grp, CASE WHEN l_linestatus = 'F' THEN l_quantity ELSE l_quantity * 2 END::DOUBLE AS x, avg(l_extendedprice * CASE WHEN l_quantity = 7 THEN 9 ELSE 1 END) AS y, 1.0::DOUBLE AS rw FROM lineitem GROUP BY ALL)"]
    for i in range(passes + 1):
        parts.append(f"""p{i} AS (SELECT a.grp, a.x AS x0, a.y AS y0, b.x - a.x AS c, b.y, b.rw, abs(b.x - a.x) AS d, row_number() OVER (PARTITION BY a.grp, a.x ORDER BY abs(b.x - a.x), b.x) AS i, greatest(floor(count(*) OVER (PARTITION BY a.grp, a.x) * {share} + 1e-10), 2) AS k FROM m{i} a JOIN m{i} b ON a.grp = b.grp),
w{i} AS (SELECT *, d / max(d) OVER (PARTITION BY grp, x0) AS u FROM p{i} WHERE i <= k), v{i} AS (SELECT *, rw * CASE WHEN u <= 0.001 THEN 1 WHEN u <= 0.999 THEN pow(1 - pow(u, 3), 3) ELSE 0 END AS w FROM w{i}),
s{i} AS (SELECT grp, x0, y0, sum(w) AS s, sum(w * c) AS sx, sum(w * y) AS sy, sum(w * c * c) AS xx, sum(w * c * y) AS xy FROM v{i} GROUP BY ALL), f{i} AS (SELECT grp, x0 AS x, y0 AS y, (xx * sy - sx * xy) / (s * xx - sx * sx) AS fit FROM s{i})""")
        parts.append(f"m{i + 1} AS (SELECT grp, x, y, pow(1 - pow(least(abs(y - fit) / (6 * median(abs(y - fit)) OVER (PARTITION BY grp)), 1), 2), 2) AS rw FROM f{i})")
    return f"WITH {', '.join(parts)} SELECT grp, x, round(fit, 4) AS fit FROM f{passes}"


@query("lowess_robust", _lowess_sql(0.3, 3))
def lowess_robust(spark, d):
    """The robust curve of two cohorts, one point of each an outlier."""
    l = table(spark, d, "lineitem")  # noqa: E741
    x = F.when(F.col("l_linestatus") == "F", F.col("l_quantity")).otherwise(F.col("l_quantity") * 2).cast("double")
    y = F.col("l_extendedprice") * F.when(F.col("l_quantity") == 7, 9).otherwise(1)
    rows = l.select(F.col("l_linestatus").alias("grp"), x.alias("x"), y.alias("y"))
    return stats.lowess(rows, "x", "y", ("grp",), 0.3).select("grp", "x", r("fit").alias("fit"))


def _anchored(spark, d):
    first = exposures(spark, d).where("code = 'PROMO'").groupBy("k").agg(F.min("s").alias("s"))
    money = table(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderdate").alias("day"), F.col("o_totalprice").alias("amount"))
    return money.join(first, "k")


_REL = "rel AS (SELECT o_custkey AS k, o_orderdate AS day, o_totalprice AS amount, floor((epoch_us(o_orderdate) - epoch_us(f.s)) / 86400000000.0)::BIGINT AS rel FROM orders JOIN (SELECT k, min(s) AS s FROM expo WHERE code = 'PROMO' GROUP BY k) f ON f.k = o_custkey)"


@query("delta_trajectory", f"""WITH {EXPO}, {_REL}, w AS (SELECT * FROM rel WHERE rel BETWEEN -720 AND 720), b AS (SELECT k, arg_max(amount, (day, amount)) AS base FROM w WHERE rel < 0 GROUP BY k),
p AS (SELECT k, floor(rel / 30.0) + 0.5 AS bin_center, median(amount - base) AS d FROM w JOIN b USING (k) GROUP BY ALL),
t AS (SELECT bin_center, median(d) AS median, quantile_cont(d, 0.25) AS q1, quantile_cont(d, 0.75) AS q3, count(*) AS n_keys FROM p GROUP BY 1 HAVING count(*) >= 10),
a AS (SELECT *, coalesce((bin_center - lag(bin_center) OVER o) * (abs(median) + abs(lag(median) OVER o)) / 2, 0) AS st FROM t WINDOW o AS (ORDER BY bin_center))
SELECT bin_center, round(median, 5) AS median, round(q1, 5) AS q1, round(q3, 5) AS q3, n_keys, round(sum(st) OVER (ORDER BY bin_center), 3) AS area FROM a""")
def delta_trajectory(spark, d):
    out = stats.delta_trajectory(_anchored(spark, d), "k", "day", "s", "amount")
    # Quarters of half cents have five digits.
    return out.select("bin_center", r("median", 5).alias("median"), r("q1", 5).alias("q1"), r("q3", 5).alias("q3"), "n_keys", r("area", 3).alias("area"))


@query("pre_post_slopes", f"""WITH {EXPO}, {_REL}, w AS (SELECT *, rel / 365.25 AS x FROM rel WHERE rel BETWEEN -365 AND 365)
SELECT k, count(*) FILTER (WHERE rel < 0) AS n_pre, count(*) FILTER (WHERE rel >= 0) AS n_post, round(CASE WHEN count(DISTINCT rel) FILTER (WHERE rel < 0) >= 2 THEN regr_slope(amount, x) FILTER (WHERE rel < 0) END, 0) AS pre_slope,
round(CASE WHEN count(DISTINCT rel) FILTER (WHERE rel >= 0) >= 2 THEN regr_slope(amount, x) FILTER (WHERE rel >= 0) END, 0) AS post_slope, arg_max(amount, (day, amount)) FILTER (WHERE rel < 0) AS baseline FROM w GROUP BY k""")
def pre_post_slopes(spark, d):
    out = stats.pre_post_slopes(_anchored(spark, d), "k", "day", "s", "amount")
    return out.select("k", "n_pre", "n_post", r("pre_slope", 0).alias("pre_slope"), r("post_slope", 0).alias("post_slope"), "baseline")


@query("histogram_bins", "SELECT event_type, user_id % 2 AS sex, floor(value / 5)::BIGINT AS bin, count(*) AS n FROM events GROUP BY ALL")
def histogram_bins(spark, d):
    return stats.histogram(measures(spark, d).withColumn("sex", F.col("user_id") % 2), "value", ["event_type", "sex"], 5.0)


@query("boxplot_stats", "SELECT event_type, round(quantile_cont(value, 0.25), 6) AS q1, round(median(value), 6) AS median, round(quantile_cont(value, 0.75), 6) AS q3, min(value) AS lo, max(value) AS hi FROM events GROUP BY 1")
def boxplot_stats(spark, d):
    out = ranks.quantiles(measures(spark, d), "value", {"lo": 0.0, "q1": 0.25, "median": 0.5, "q3": 0.75, "hi": 1.0}, ("event_type",))
    return out.select("event_type", r("q1", 6).alias("q1"), r("median", 6).alias("median"), r("q3", 6).alias("q3"), "lo", "hi")


@query("metric_ci_summary", "SELECT event_type AS model, round(avg(m), 6) AS mean, round(quantile_cont(m, 0.025), 6) AS lo, round(quantile_cont(m, 0.975), 6) AS hi FROM (SELECT event_type, event_id % 5 AS split, avg(value) AS m FROM events GROUP BY ALL) GROUP BY 1")
def metric_ci_summary(spark, d):
    per = measures(spark, d).groupBy(F.col("event_type").alias("model"), (F.col("event_id") % 5).alias("split")).agg(F.avg("value").alias("m"))
    out = per.groupBy("model").agg(F.avg("m").alias("mean"), F.percentile("m", 0.025).alias("lo"), F.percentile("m", 0.975).alias("hi"))
    return out.select("model", r("mean", 6).alias("mean"), r("lo", 6).alias("lo"), r("hi", 6).alias("hi"))


@query("metric_ci_compact", "SELECT event_type AS model, concat(round(avg(m), 3), ' (', round(quantile_cont(m, 0.025), 3), '–', round(quantile_cont(m, 0.975), 3), ')') AS \"Mean value\" FROM (SELECT event_type, event_id % 5 AS split, avg(value) AS m FROM events GROUP BY ALL) GROUP BY 1")
def metric_ci_compact(spark, d):
    """The same as one text for each metric, under the metric's shown name."""
    per = measures(spark, d).groupBy(F.col("event_type").alias("model"), (F.col("event_id") % 5).alias("split")).agg(F.avg("value").alias("m"))
    return evaluation.compact(evaluation.over_splits(evaluation.chosen(per, {"m": "Mean value"}, ["model"]), "model", ["Mean value"]), "model", ["Mean value"])
