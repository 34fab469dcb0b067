"""Queries: cohorts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import series
from ..plans import cohorts
from ..sources.io import table
from . import Registry
from .base import EXPO, SPEND, STAYS, exposures, r, spending, stays

query = Registry()
_TESTS = ["A", "N", "R"]
_DAYS = lambda a, b: f"(epoch_us({a}) - epoch_us({b})) / 86400000000.0"


def _parts(spark, d):
    rows = exposures(spark, d).repartition("k")  # what is grouped by key and instant is dealt by the key alone
    index = rows.where("code = 'PROMO'").groupBy("k", F.col("okey").alias("id")).agg(F.min("s").alias("s"), F.max("e").alias("e"))
    money = spending(spark, d).select("k", "day", "amount", F.col("o_orderkey").alias("tie"))
    codes = rows.groupBy("k", "s").agg(F.array_join(F.array_sort(F.collect_set("brand")), ",").alias("codes"))
    labs = rows.select("k", F.col("s").alias("h"), F.col("rf").alias("test"), F.when(F.col("dose") > 50000, "Høj").otherwise("Normal").alias("flag"), (F.col("okey") * 10000000 + F.col("pk") * 10 + F.col("ln")).alias("tie"))
    return index, money, codes, labs, stays(spark, d).select("k", "s", "e", F.col("okey").alias("tie"))


_INDEX = "idx AS (SELECT k, okey AS id, min(s) AS s, max(e) AS e FROM expo WHERE code = 'PROMO' GROUP BY ALL)"
_FLAG = "CASE WHEN dose > 50000 THEN 3 ELSE 2 END"
_TIE = "okey * 10000000 + pk * 10 + ln"
_PAST = """per AS (SELECT k, s AS h, count(*) AS n, sum((dose > 50000)::INT) AS a FROM expo GROUP BY ALL),
past AS (SELECT *, abnormal_before / nullif(tests_before, 0) AS abnormal_share FROM (SELECT k, h, coalesce(sum(n) OVER b, 0)::BIGINT AS tests_before, coalesce(sum(a) OVER b, 0)::BIGINT AS abnormal_before,
 floor((epoch_us(h) - epoch_us(lag(h) OVER (PARTITION BY k ORDER BY h))) / 86400000000.0)::BIGINT AS days_since_previous FROM per WINDOW b AS (PARTITION BY k ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)))"""

_INITIATION = f"""WITH {EXPO}, {SPEND}, {STAYS}, {_INDEX},
b AS (SELECT i.*, m.amount AS baseline_amount FROM idx i JOIN spend m ON m.k = i.k AND m.day <= i.s QUALIFY row_number() OVER (PARTITION BY i.k, i.id ORDER BY m.day DESC, m.o_orderkey DESC) = 1 AND {_DAYS("i.s", "m.day")} <= 90),
t AS (SELECT b.*, m.amount AS target_amount, m.day AS td FROM b JOIN spend m ON m.k = b.k AND m.day > b.s QUALIFY row_number() OVER (PARTITION BY b.k, b.id ORDER BY m.day, m.o_orderkey) = 1 AND {_DAYS("m.day", "b.s")} BETWEEN 30 AND 180),
f AS (SELECT k, id, s, e, baseline_amount, target_amount FROM t QUALIFY row_number() OVER (PARTITION BY k ORDER BY s, id) = 1),
cl AS (SELECT k, s AS cs, string_agg(DISTINCT brand, ',' ORDER BY brand) AS codes FROM expo GROUP BY ALL),
c AS (SELECT f.*, cl.codes FROM f LEFT JOIN cl ON cl.k = f.k AND cl.cs <= f.s QUALIFY row_number() OVER (PARTITION BY f.k ORDER BY cl.cs DESC) = 1),
l AS (SELECT c.k, {", ".join(f"arg_max({_FLAG.replace('dose', 'x.dose')}, (x.s, {_TIE})) FILTER (x.rf = '{t}') AS lab_{t}" for t in _TESTS)} FROM c LEFT JOIN expo x ON x.k = c.k AND x.s <= c.s GROUP BY c.k),
{_PAST},
h AS (SELECT c.k, p.* EXCLUDE (k, h) FROM c LEFT JOIN past p ON p.k = c.k AND p.h <= c.s QUALIFY row_number() OVER (PARTITION BY c.k ORDER BY p.h DESC) = 1),
st AS (SELECT c.k, z.s AS zs, z.e AS ze FROM c LEFT JOIN stays z ON z.k = c.k AND z.s <= c.s QUALIFY row_number() OVER (PARTITION BY c.k ORDER BY z.s DESC, z.okey DESC) = 1),
whole AS (SELECT c.k, c.id, c.s, c.e, baseline_amount, target_amount, codes, {", ".join(f"lab_{t}" for t in _TESTS)}, tests_before, abnormal_before, days_since_previous, round(abnormal_share, 6) AS abnormal_share, coalesce(c.s <= st.ze, false) AS inside, target_amount >= 1.05 * baseline_amount AS rose
 FROM c JOIN l USING (k) JOIN h USING (k) JOIN st USING (k))"""


@query("cohort_initiation", _INITIATION + " SELECT * FROM whole")
def cohort_initiation(spark, d):
    return cohorts.initiation(*_parts(spark, d), tests=_TESTS).withColumn("abnormal_share", r("abnormal_share", 6))


_SHORT = "short AS (SELECT DISTINCT k, substr(trim(x), 1, 8) AS code FROM (SELECT k, unnest(string_split(codes, ',')) AS x FROM whole)), tops AS (SELECT code FROM short GROUP BY code ORDER BY count(*) DESC, code LIMIT {top})"


@query("cohort_initiation_codes", _INITIATION + f""", {_SHORT.format(top=5)} SELECT code, count(*) AS n, (SELECT count(*) FROM whole) AS cohort FROM short JOIN tops USING (code) GROUP BY code""")
def cohort_initiation_codes(spark, d):
    """The commonest codes of the cohort, counted over the cohort's own rows, with how many of it have them."""
    rows = cohorts.initiation(*_parts(spark, d), tests=_TESTS)
    out = cohorts.refined(rows, width=8, top=5)
    hot = [c for c in out.columns if c.startswith("code_")]
    sums = out.agg(F.count("*").alias("cohort"), *[F.sum(f"`{c}`").alias(c) for c in hot])
    return sums.unpivot(["cohort"], hot, "code", "n").select(F.substr("code", F.lit(6)).alias("code"), "n", "cohort")


_PLAIN = ["baseline_amount", "tests_before", "abnormal_before", "days_since_previous", "abnormal_share"]
_LONG = " UNION ALL ".join(f"SELECT k, '{c}' AS name, {c}::DOUBLE AS value FROM whole" for c in _PLAIN)
_LONG += "".join(f" UNION ALL SELECT k, 'lab_{t}', lab_{t}::DOUBLE FROM whole WHERE (SELECT avg((lab_{t} IS NULL)::INT) FROM whole) <= 0.5" for t in _TESTS)
_LONG += " UNION ALL SELECT k, 'inside', inside::INT::DOUBLE FROM whole UNION ALL SELECT k, 'target', rose::INT::DOUBLE FROM whole"
_LONG += " UNION ALL SELECT k, 'segment_' || lower(c_mktsegment), (c_mktsegment = own)::INT::DOUBLE FROM (SELECT k, c.c_mktsegment AS own, z.c_mktsegment FROM whole JOIN customer c ON c_custkey = k, (SELECT DISTINCT c_mktsegment FROM customer JOIN whole ON k = c_custkey) z)"
_LONG += " UNION ALL SELECT w.k, 'code_' || t.code, (s.code IS NOT NULL)::INT::DOUBLE FROM whole w CROSS JOIN tops t LEFT JOIN short s ON s.k = w.k AND s.code = t.code"


@query("cohort_initiation_final", _INITIATION + f", {_SHORT.format(top=200)} SELECT * FROM ({_LONG}) WHERE value IS NOT NULL")
def cohort_initiation_final(spark, d):
    """The cohort as models take it, one row for each key and column: sparse tests gone, values retyped, categories and codes as 0/1."""
    who = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.lower("c_mktsegment").alias("segment"))
    rows = cohorts.initiation(*_parts(spark, d), tests=_TESTS).withColumn("abnormal_share", r("abnormal_share", 6)).join(who, "k")
    out = cohorts.refined(rows, width=8, categories=("segment",), unused=("id", "s", "e"), suffixes=("_amount_next", "target_amount"))
    names = [c for c in out.columns if c != "k"]
    return out.select("k", *[F.col(f"`{c}`").cast("double").alias(c) for c in names]).unpivot(["k"], [f"`{c}`" for c in names], "name", "value").where("value IS NOT NULL").withColumn("name", F.replace("name", F.lit("`"), F.lit("")))


_STEPPED = f"stepped AS (SELECT *, lead(amount) OVER w - amount AS ch, {_DAYS('lead(day) OVER w', 'day')} AS gap FROM spend WINDOW w AS (PARTITION BY k ORDER BY day, o_orderkey))"
_ON = f"""WITH {EXPO}, {SPEND}, {STAYS}, {_INDEX}, {_STEPPED}, {_PAST},
m AS (SELECT i.*, n.day, n.amount, n.o_orderkey AS tie, CASE WHEN n.gap IS NOT NULL THEN coalesce(n.ch / nullif(n.amount, 0) >= 0.05, false)::INT END AS target FROM idx i JOIN stepped n ON n.k = i.k AND n.day > i.s QUALIFY row_number() OVER (PARTITION BY i.k, i.id ORDER BY n.day, n.o_orderkey) = 1)"""


@query("cohort_on_treatment", f"{_ON} SELECT k, id, s, e, day, amount, tie, target FROM m WHERE {_DAYS('day', 's')} >= 10 AND day <= e AND target IS NOT NULL")
def cohort_on_treatment(spark, d):
    index, money, *_ = _parts(spark, d)
    return cohorts.on_treatment(index, money, wash_out_days=10)


@query("cohort_on_treatment_censored", f"{_ON} SELECT k, id, s, e, day, amount, tie, coalesce(target, 0) AS target FROM m WHERE {_DAYS('day', 's')} >= 10 AND day <= e")
def cohort_on_treatment_censored(spark, d):
    index, money, *_ = _parts(spark, d)
    return cohorts.on_treatment(index, money, wash_out_days=10, censored_as_negative=True)


@query("cohort_on_treatment_known", f"""{_ON}, c0 AS (SELECT * FROM m WHERE {_DAYS('day', 's')} >= 10 AND day <= e AND target IS NOT NULL QUALIFY row_number() OVER (PARTITION BY k ORDER BY day, tie, s, id) = 1),
cl AS (SELECT k, s AS cs, string_agg(DISTINCT brand, ',' ORDER BY brand) AS codes FROM expo GROUP BY ALL),
c AS (SELECT c0.*, cl.codes FROM c0 LEFT JOIN cl ON cl.k = c0.k AND cl.cs <= c0.day QUALIFY row_number() OVER (PARTITION BY c0.k ORDER BY cl.cs DESC) = 1),
l AS (SELECT c.k, {", ".join(f"arg_max({_FLAG.replace('dose', 'x.dose')}, (x.s, {_TIE})) FILTER (x.rf = '{t}') AS lab_{t}" for t in _TESTS)} FROM c LEFT JOIN expo x ON x.k = c.k AND x.s <= c.day GROUP BY c.k),
h AS (SELECT c.k, p.* EXCLUDE (k, h) FROM c LEFT JOIN past p ON p.k = c.k AND p.h <= c.day QUALIFY row_number() OVER (PARTITION BY c.k ORDER BY p.h DESC) = 1),
st AS (SELECT c.k, z.e AS ze FROM c LEFT JOIN stays z ON z.k = c.k AND z.s <= c.day QUALIFY row_number() OVER (PARTITION BY c.k ORDER BY z.s DESC, z.okey DESC) = 1)
SELECT c.*, {", ".join(f"lab_{t}" for t in _TESTS)}, tests_before, abnormal_before, days_since_previous, round(abnormal_share, 6) AS abnormal_share, coalesce(c.day <= st.ze, false) AS inside FROM c JOIN l USING (k) JOIN h USING (k) JOIN st USING (k)""")
def cohort_on_treatment_known(spark, d):
    """Each key's first measurement on treatment, with the codes, tests and stay known at it."""
    index, money, codes, labs, stays_ = _parts(spark, d)
    rows = cohorts.on_treatment(index, money, wash_out_days=10, codes=codes, labs=labs, stays=stays_, tests=_TESTS, first_only=True)
    return rows.withColumn("abnormal_share", r("abnormal_share", 6))


_TYPES = "ct AS (SELECT k, s AS cs, string_agg(DISTINCT code, ',' ORDER BY code) AS types FROM expo GROUP BY ALL)"


def _families(spark, d):
    """Two families of codes, each known by its own as-of: brands and types."""
    rows, codes = exposures(spark, d).repartition("k"), _parts(spark, d)[2]
    return {"codes": codes, "types": rows.groupBy("k", "s").agg(F.array_join(F.array_sort(F.collect_set("code")), ",").alias("codes"))}


def _tops(column: str, family: str, top: int) -> str:
    return f"""{family}_short AS (SELECT DISTINCT k, substr(trim(x), 1, 8) AS code FROM (SELECT k, unnest(string_split({column}, ',')) AS x FROM whole)), {family}_tops AS (SELECT code FROM {family}_short GROUP BY code ORDER BY count(*) DESC, code LIMIT {top})"""


def _hot(family: str, prefix: str) -> str:
    return f"SELECT w.k, '{prefix}' || t.code AS name, (s.code IS NOT NULL)::INT::DOUBLE AS value FROM whole w CROSS JOIN {family}_tops t LEFT JOIN {family}_short s ON s.k = w.k AND s.code = t.code"


def _long(out):
    names = [c for c in out.columns if c != "k"]
    long = out.select("k", *[F.col(f"`{c}`").cast("double").alias(c) for c in names]).unpivot(["k"], [f"`{c}`" for c in names], "name", "value")
    return long.where("value IS NOT NULL").withColumn("name", F.replace("name", F.lit("`"), F.lit("")))


_ON_WHOLE = f"""{_ON}, c0 AS (SELECT * FROM m WHERE {_DAYS('day', 's')} >= 10 AND day <= e AND target IS NOT NULL QUALIFY row_number() OVER (PARTITION BY k ORDER BY day, tie, s, id) = 1),
cl AS (SELECT k, s AS cs, string_agg(DISTINCT brand, ',' ORDER BY brand) AS codes FROM expo GROUP BY ALL), {_TYPES},
c1 AS (SELECT c0.*, cl.codes FROM c0 LEFT JOIN cl ON cl.k = c0.k AND cl.cs <= c0.day QUALIFY row_number() OVER (PARTITION BY c0.k ORDER BY cl.cs DESC) = 1),
c AS (SELECT c1.*, ct.types FROM c1 LEFT JOIN ct ON ct.k = c1.k AND ct.cs <= c1.day QUALIFY row_number() OVER (PARTITION BY c1.k ORDER BY ct.cs DESC) = 1),
l AS (SELECT c.k, {", ".join(f"arg_max({_FLAG.replace('dose', 'x.dose')}, (x.s, {_TIE})) FILTER (x.rf = '{t}') AS lab_{t}" for t in _TESTS)} FROM c LEFT JOIN expo x ON x.k = c.k AND x.s <= c.day GROUP BY c.k),
h AS (SELECT c.k, p.* EXCLUDE (k, h) FROM c LEFT JOIN past p ON p.k = c.k AND p.h <= c.day QUALIFY row_number() OVER (PARTITION BY c.k ORDER BY p.h DESC) = 1),
st AS (SELECT c.k, z.e AS ze FROM c LEFT JOIN stays z ON z.k = c.k AND z.s <= c.day QUALIFY row_number() OVER (PARTITION BY c.k ORDER BY z.s DESC, z.okey DESC) = 1),
whole AS (SELECT c.*, {", ".join(f"lab_{t}" for t in _TESTS)}, tests_before, abnormal_before, days_since_previous, round(abnormal_share, 6) AS abnormal_share, coalesce(c.day <= st.ze, false) AS inside FROM c JOIN l USING (k) JOIN h USING (k) JOIN st USING (k))"""
_ON_LONG = " UNION ALL ".join(f"SELECT k, '{c}' AS name, {c}::DOUBLE AS value FROM whole" for c in ["amount", *_PLAIN[1:], "target"])
_ON_LONG += "".join(f" UNION ALL SELECT k, 'lab_{t}', lab_{t}::DOUBLE FROM whole WHERE (SELECT avg((lab_{t} IS NULL)::INT) FROM whole) <= 0.5" for t in _TESTS)
_ON_LONG += " UNION ALL SELECT k, 'inside', inside::INT::DOUBLE FROM whole UNION ALL " + _hot("b", "code_") + " UNION ALL " + _hot("t", "type_")


@query("cohort_on_treatment_final", f"{_ON_WHOLE}, {_tops('codes', 'b', 4)}, {_tops('types', 't', 4)} SELECT * FROM ({_ON_LONG}) WHERE value IS NOT NULL")
def cohort_on_treatment_final(spark, d):
    """The on-treatment cohort as models take it, one row for each key and column, with the commonest codes of both families."""
    index, money, _, labs, stays_ = _parts(spark, d)
    rows = cohorts.on_treatment(index, money, wash_out_days=10, codes=_families(spark, d), labs=labs, stays=stays_, tests=_TESTS, first_only=True)
    rows = rows.withColumn("abnormal_share", r("abnormal_share", 6))
    return _long(cohorts.refined(rows, codes={"codes": "code_", "types": "type_"}, width=8, top=4, target="target", unused=("id", "s", "e", "day", "tie")))


_IN_WHOLE = _INITIATION.replace("whole AS (SELECT", "whole0 AS (SELECT") + f", {_TYPES}, whole AS (SELECT w.*, ct.types FROM whole0 w LEFT JOIN ct ON ct.k = w.k AND ct.cs <= w.s QUALIFY row_number() OVER (PARTITION BY w.k ORDER BY ct.cs DESC) = 1)"


@query("cohort_initiation_families", f"{_IN_WHOLE}, {_tops('codes', 'b', 4)}, {_tops('types', 't', 4)} {_hot('b', 'code_')} UNION ALL {_hot('t', 'type_')}")
def cohort_initiation_families(spark, d):
    """The codes of both families at the first exposure: each known by its own as-of, each with its own commonest ones."""
    index, money, _, labs, stays_ = _parts(spark, d)
    rows = cohorts.initiation(index, money, _families(spark, d), labs, stays_, tests=_TESTS)
    out = cohorts.refined(rows, codes={"codes": "code_", "types": "type_"}, width=8, top=4)
    return _long(out.select("k", *[c for c in out.columns if c.startswith(("code_", "type_"))]))


def _first_exposures(spark, d):
    return exposures(spark, d).where("code = 'PROMO' AND dose > 60000").groupBy("k").agg(F.min("s").alias("s"), F.max("e").alias("e"))


@query("subcohorts", f"""WITH {EXPO}, {SPEND}, {_STEPPED}, g AS (SELECT k, day, amount, o_orderkey AS tie, gap FROM stepped WHERE gap >= 1 AND ch / gap > -5000 AND ch / gap < 5000),
x AS (SELECT k, min(s) AS s, max(e) AS e FROM expo WHERE code = 'PROMO' AND dose > 60000 GROUP BY k),
free AS (SELECT *, NULL::DOUBLE AS days_on, NULL::DOUBLE AS days_off FROM g WHERE k NOT IN (SELECT k FROM x)),
o AS (SELECT g.*, {_DAYS("day", "s")} AS since, {_DAYS("e", "s")} AS span, {_DAYS("e", "day")} AS rest FROM g JOIN x USING (k)),
p AS (SELECT *, since >= 0 AND rest >= 0 AS ison, gap < rest AS still FROM o),
q AS (SELECT k, day, amount, tie, gap, CASE WHEN still THEN since + gap ELSE span END AS days_on, CASE WHEN still THEN 0 ELSE since + gap - span END AS days_off, ison FROM p WHERE since >= -100 AND rest >= -1 AND (ison OR still)),
u AS (SELECT * FROM free QUALIFY row_number() OVER (PARTITION BY k ORDER BY day, tie) = 1), v AS (SELECT * FROM free QUALIFY row_number() OVER (PARTITION BY k ORDER BY day DESC, tie DESC) = 1),
a AS (SELECT * EXCLUDE ison FROM q WHERE ison QUALIFY row_number() OVER (PARTITION BY k ORDER BY day, tie) = 1), b AS (SELECT * EXCLUDE ison FROM q WHERE ison QUALIFY row_number() OVER (PARTITION BY k ORDER BY day DESC, tie DESC) = 1),
z AS (SELECT *, 'unexposed_first' AS grp FROM u UNION ALL SELECT *, 'unexposed_last' FROM v UNION ALL SELECT *, 'exposed_first' FROM a UNION ALL SELECT *, 'exposed_last' FROM b UNION ALL SELECT * EXCLUDE ison, 'exposed_before' FROM q WHERE NOT ison)
SELECT k, tie, grp, round(days_on, 4) AS days_on, round(days_off, 4) AS days_off FROM z""")
def subcohorts(spark, d):
    money = spending(spark, d).select("k", "day", "amount", F.col("o_orderkey").alias("tie"))
    rows = cohorts.subcohorts(money, _first_exposures(spark, d), limit=5000)
    return rows.select("k", "tie", "grp", r("days_on").alias("days_on"), r("days_off").alias("days_off"))


@query("cohort_target_modes", f"""WITH {SPEND}, {_STEPPED}, y AS (SELECT * FROM stepped WHERE ch IS NOT NULL)
SELECT 'percent' AS mode, count(*) AS n, round(sum((ch * 100 / amount > 5)::INT), 2)::DOUBLE AS target FROM y UNION ALL
SELECT 'slope_sign', count(*), sum((ch / gap > 0)::INT)::DOUBLE FROM y WHERE gap >= 1 AND abs(ch / gap) < 900 UNION ALL SELECT 'difference', count(*), round(sum(ch), 2) FROM y WHERE gap >= 1 AND abs(ch / gap) < 900""")
def cohort_target_modes(spark, d):
    rows = series.steps(spending(spark, d), "k", "day", "amount", "o_orderkey").where("change_to_next IS NOT NULL")
    out = None
    for mode in ("percent", "slope_sign", "difference"):
        one = cohorts.with_target(rows, mode, limit=900).agg(F.lit(mode).alias("mode"), F.count("*").alias("n"), r(F.sum("target"), 2).alias("target"))
        out = one if out is None else out.unionByName(one)
    return out


