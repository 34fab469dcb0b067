"""Hand-made rows for the corner cases of the operators."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from lifelane.functions import coding, ranks, schedule, times
from lifelane.operators import asof, cleaning, disclosure, evaluation, history, intervals, matching, series, stats
from lifelane.queries.coding import SCHEDULES

T0 = datetime(2020, 1, 1)


def at(days=0.0, micros=0):
    return T0 + timedelta(days=days, microseconds=micros)


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_floor_days_counts_whole_days(spark):
    df = frame(spark, [(at(1, -1), at(0)), (at(0), at(1 / 24)), (at(2), at(0))], "a timestamp_ntz, b timestamp_ntz")
    assert [r[0] for r in df.select(times.floor_days("a", "b")).collect()] == [0, -1, 2]


def test_collapse_gap_and_open_ends(spark):
    rows = [
        (1, "a", at(0), at(1)), (1, "a", at(3), at(4)),  # exactly 48 h: one island
        (2, "a", at(0), at(1)), (2, "a", at(3, 1), at(4)),  # a microsecond more: two
        (3, "a", at(0), at(10)), (3, "a", at(1), at(2)), (3, "a", at(11), at(12)),  # reached from the outer one only
        (4, "a", at(0), None), (4, "a", at(1), at(2)),  # an open end reaches nobody
        (5, "a", at(0), at(0)), (5, "a", at(0), at(0)),  # duplicates, zero length
        (6, "a", at(0), at(0.5)),
    ]
    out = intervals.collapse(frame(spark, rows, "k int, c string, s timestamp_ntz, e timestamp_ntz"), ["k", "c"], "s", "e")
    n = {r.k: r["count"] for r in out.groupBy("k").count().collect()}
    assert n == {1: 1, 2: 2, 3: 1, 4: 2, 5: 1, 6: 1}
    days = {r.k: r.days for r in out.where("k IN (3, 5, 6)").collect()}
    assert days == {3: 12.0, 5: 0.0, 6: 1.0}
    again = intervals.collapse(out.select("k", "c", "s", "e"), ["k", "c"], "s", "e")
    assert again.count() == out.count()


def test_repair(spark):
    rows = [(1, at(5), at(3), None), (2, at(5), None, at(6)), (3, None, at(1), at(1)), (4, at(5), None, None)]
    out = intervals.repaired(frame(spark, rows, "i int, s timestamp_ntz, e timestamp_ntz, a timestamp_ntz"), "s", "e", "a", lo="2019-01-01", hi="2021-01-01", ongoing="2020-12-31")
    got = {r.i: (r.s, r.e, r.possibly_ongoing) for r in out.collect()}
    assert got == {1: (at(3), at(3), False), 2: (at(5), at(6), False), 4: (at(5), datetime(2020, 12, 31), True)}


def test_asof_rules(spark):
    left = frame(spark, [(1, at(10), "x"), (2, at(10), "x"), (None, at(10), "x"), (3, None, "x")], "k int, t timestamp_ntz, v string")
    right = frame(spark, [(1, at(10), 1), (1, at(10), 2), (1, at(5), 0), (1, at(20), 3), (2, at(0), 9), (None, at(9), 7), (3, at(1), 5)], "k int, t timestamp_ntz, w int")

    def run(**kw):
        return {r.k: r.w for r in asof.asof(left, right, by="k", left_ts="t", right_ts="t", take=["w"], ties=["w"], **kw).collect()}

    assert run() == {1: 2, 2: 9, None: None, 3: None}
    assert run(exact=False)[1] == 0
    assert run(tolerance=10 * times.DAY)[2] == 9
    assert run(tolerance=10 * times.DAY - 1)[2] is None
    assert run(direction="forward")[1] == 1
    assert run(direction="forward", exact=False)[1] == 3


def test_histories(spark):
    rows = [(1, "a", at(0), at(2)), (1, "b", at(0), None), (1, "c", at(2), at(2)), (1, "a", at(5), at(6)), (1, None, at(5), None)]
    df = frame(spark, rows, "k int, c string, s timestamp_ntz, e timestamp_ntz")
    inc = {(r.c, r.s): r for r in history.code_history(df, "k", "c", "s", "e", end_inclusive=True, past_inclusive=True, exclude_own=False).collect()}
    exc = {(r.c, r.s): r for r in history.code_history(df, "k", "c", "s", "e", end_inclusive=False, past_inclusive=False, exclude_own=True).collect()}
    assert inc["c", at(2)].active_codes == "a,b,c" and exc["c", at(2)].active_codes == "b"
    assert inc["a", at(0)].past_codes == "a,b" and exc["a", at(0)].past_codes == ""
    assert inc["a", at(5)].times_before == 1 and exc["a", at(5)].past_codes == "a,b,c"


def test_series_need_time_and_spread(spark):
    df = frame(spark, [(1, at(0), 1.0, 0), (1, at(0), 3.0, 1), (1, at(365.25), 3.0, 2), (2, at(0), 5.0, 0)], "k int, t timestamp_ntz, v double, i int")
    slope = {(r.k, r.i): r.slope for r in series.slope_since(df, "k", "t", "v", "i").collect()}
    assert slope == {(1, 0): None, (1, 1): None, (1, 2): 0.0, (2, 0): None}
    fit = {(r.k, r.i): (r.slope_year, r.r_squared) for r in series.running_regression(df, "k", "t", "v", "i").collect()}
    assert fit[1, 1] == (None, None) and abs(fit[1, 2][0] - 1.0) < 1e-9 and fit[2, 0] == (None, None)


def test_schedules(spark):
    df = frame(spark, [(t, c) for t, c in SCHEDULES.items()] + [(None, "unspecified")], "text string, want string")
    wrong = df.withColumn("got", schedule.category("text")).where("got <> want").collect()
    assert not wrong
    rates = df.select("want", schedule.times_per_day("want").alias("r")).collect()
    assert {r.want: r.r for r in rates}["every 8 hour(s)"] == 3.0


def test_codes(spark):
    df = frame(spark, [("Paranoid skizofreni (DF200)",), ("uden kode",), (None,)], "t string").withColumn("c", coding.embedded_code("t"))
    assert [tuple(r) for r in df.select("c", coding.short_code("c")).collect()] == [("DF200", "DF20"), (None, None), (None, None)]
    assert frame(spark, [("aa11,aa1122,, b",)], "t string").select(coding.rolled_up("t", 4)).first()[0] == "aa11,b"


def test_boolean_tokens(spark):
    df = cleaning.typed(frame(spark, [("yes",), ("0",), ("x",), (None,)], "b string"), cleaning.Roles(boolean=("b",)))
    assert [r.b for r in df.collect()] == [True, False, None, None]


def test_ranks_and_quantiles_match_plain_sorting(spark):
    values = [float(i * 37 % 50) for i in range(200)]
    df = frame(spark, [(v, i % 3) for i, v in enumerate(values)] + [(None, 0)], "v double, g int")
    got = ranks.quantiles(df, "v", {"a": 0.1, "b": 0.5}).first()
    import numpy as np

    assert abs(got.a - np.quantile(values, 0.1)) < 1e-9 and abs(got.b - np.quantile(values, 0.5)) < 1e-9
    r = ranks.value_counts(df, "v").orderBy("v").collect()
    assert sum(x.n for x in r) == 200 and r[-1].below + r[-1].n == 200


def test_disclosure_small_groups(spark):
    df = frame(spark, [(g, float(i)) for g, n in ((1, 4), (2, 5), (3, 12)) for i in range(n)], "g int, v double")
    got = {r.g: (r.pseudo_min, r.pseudo_median, r.pseudo_max) for r in disclosure.pseudo_extremes(df, "v", ("g",)).collect()}
    assert got == {1: (None, None, None), 2: (2.0, 2.0, 2.0), 3: (2.0, 6.0, 9.0)}
    med = sorted((r.g, r.part, r.median) for r in disclosure.group_medians(df, "v", ("g",)).collect())
    assert med == [(2, 0, 2.0), (3, 0, 2.0), (3, 1, 8.0)]


def test_tests_with_ties_and_zeros(spark):
    df = frame(spark, [(1.0, True), (1.0, False), (2.0, True), (None, True), (3.0, False)], "v double, f boolean")
    u = stats.mann_whitney(df, "v", F.col("f")).first()
    assert (u.n1, u.n2, u.u) == (2, 2, 1.5)
    w = stats.wilcoxon(frame(spark, [(1.0, 1.0), (3.0, 1.0), (1.0, 3.0), (5.0, 1.0), (None, 1.0)], "a double, b double"), "a", "b").first()
    assert (w.n, w.w_plus, w.w_minus) == (3, 4.5, 1.5)
    equal = stats.mann_whitney(frame(spark, [(1.0, True), (1.0, False)], "v double, f boolean"), "v", F.col("f")).first()
    assert equal.z is None or equal.z != equal.z or equal.u == 0.5


def test_curves_with_one_class_and_ties(spark):
    df = frame(spark, [(1, 0.5), (0, 0.5), (1, 0.9)], "y int, p double")
    assert evaluation.roc_auc(df).first().auc == 0.75
    assert evaluation.best_f1(df).first().threshold == 0.5
    assert evaluation.roc_auc(frame(spark, [(1, 0.5)], "y int, p double")).first().auc is None


def test_split_keeps_keys_apart(spark):
    df = spark.range(500).select((F.col("id") % 100).alias("k"), F.col("id").alias("r"), (F.col("id") % 100 % 4 == 0).cast("int").alias("y"))
    parts = evaluation.stratified_keys(df, "k", "r", "y", 0.2, 1)
    assert parts.count() == 100 and parts.where("test").count() == 20


def test_fuzzy_takes_the_best(spark):
    refs = frame(spark, [(1, "red widget"), (2, "red gadget")], "i int, r string")
    got = matching.best_reference(frame(spark, [("red widgt",), ("blue",), (None,)], "t string"), "t", refs, "r", "i", 85.0).collect()
    assert [(r.t, r.i) for r in got] == [("red widgt", 1)]


def test_stream_equals_batch(spark, tmp_path):
    from lifelane.streaming import windowed_summary

    rows = frame(spark, [(at(i / 10), "a" if i % 2 else "b", float(i)) for i in range(40)], "t timestamp_ntz, g string, v double")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = windowed_summary(stream, "t", "g", "v").writeStream.outputMode("complete").format("memory").queryName("w").start()
    q.processAllAvailable()
    q.stop()
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(spark.table("w")) == key(windowed_summary(rows, "t", "g", "v"))


def test_students_t():
    from lifelane.functions import student

    for t, df, p in ((2.228138852, 10, 0.05), (12.7062047362, 1, 0.05), (1.9599639845, 1e9, 0.05), (0.0, 5, 1.0), (3.169272667, 10, 0.01)):
        assert abs(student.two_sided(t, df) - p) < 1e-7 and abs(student.two_sided(-t, df) - p) < 1e-7
    assert abs(student.upper(0.05, 10) - 2.228138852) < 1e-7
    assert student.two_sided(None, 3) is None and student.two_sided(1.0, 0) is None and student.two_sided(float("inf"), 3) == 0.0


def test_tables_that_are_missing(spark, tmp_path):
    from lifelane.sources import io

    assert io.table_or_none(spark, f"{tmp_path}/nothing") is None
    spark.range(2).write.parquet(f"{tmp_path}/some")
    assert io.table_or_none(spark, f"{tmp_path}/some").count() == 2


def test_levels_and_labels(spark):
    import pytest

    from lifelane.operators import encoding, evaluation, modelling

    rows = spark.createDataFrame([("b", "Yes", True), ("a", "No", False), (None, None, None)], "c string, y string, z boolean")
    assert encoding.levels(rows, "c") == ["a", "b"]
    with pytest.raises(ValueError):
        encoding.levels(rows, "c", most=1)
    assert [r.y for r in modelling.binary_label(rows, "y").collect()] == [1, 0, None]
    assert [r.z for r in modelling.binary_label(rows, "z").collect()] == [1, 0, None]
    with pytest.raises(ValueError):
        modelling.binary_label(rows, "c")
    with pytest.raises(ValueError):
        evaluation.chosen(rows, {"nothing": "Shown"})
    assert encoding.prettified("p_x", {"p": "P"}) == "P: x" and encoding.prettified("q", {"p": "P"}) == "q"
    flagged = encoding.any_of(spark.createDataFrame([(1, 0), (0, None), (None, None)], "a int, b int"), ["a", "b"], "any")
    assert [r["any"] for r in flagged.collect()] == [1, 0, 0]


def test_sources_meet_in_one_join(spark):
    from pyspark.sql import functions as F

    from lifelane.operators.asof import Source, asof_many

    left = spark.createDataFrame([("k", 10), ("k", 20), (None, 10), ("z", 5), ("k", None)], "k string, n int").withColumn("t", F.timestamp_seconds("n"))
    a = spark.createDataFrame([("k", 10, 1), ("k", 10, 2), ("k", 15, None), (None, 1, 9)], "k string, n int, v int").select("k", F.timestamp_seconds("n").alias("at"), "v")
    b = a.withColumn("at", F.timestamp_seconds(F.unix_micros("at") / 1_000_000 + 10))
    sources = [Source(a, "at", ["v"], ties=["v"]), Source(a, "at", {"w": F.col("v")}, exact=False, each=True, ties=["v"]), Source(b, "at", ["v"], direction="forward", exact=False, prefix="next_", gap="away", ties=["v"])]
    got = {(r.k, r.n): (r.v, r.w, r.next_v, r.away) for r in asof_many(left, by="k", left_ts="t", sources=sources).collect()}
    assert got == {("k", 10): (2, None, 1, 10_000_000), ("k", 20): (None, 2, None, 5_000_000), (None, 10): (None,) * 4, ("z", 5): (None,) * 4, ("k", None): (None,) * 4}
    assert asof_many(left, by="k", left_ts="t", sources=sources, keyed=True).count() == 3
