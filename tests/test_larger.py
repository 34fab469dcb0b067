"""What only larger or odder tables than the smallest ones show."""

import re

import duckdb
import pytest
from pyspark.sql import functions as F

from lifelane import catalog

LARGER = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def larger():
    con = duckdb.connect()
    for t in ("customer", "orders", "lineitem", "part", "events"):
        con.execute(f"create view {t} as select * from '{LARGER}/{t}.parquet'")
    return con


def test_points_without_a_line_lose_their_weight(spark, larger, same):
    """Here the neighbours of some points have lost all weights but one after the first pass."""
    same(catalog.queries()["lowess_robust"](spark, LARGER), larger.sql(catalog.oracle_sql()["lowess_robust"]))


def test_a_refined_cohort_is_made_once(spark):
    from lifelane.plans import cohorts

    rows = spark.createDataFrame([(1, "a1,b2", None, True), (2, "a1", 2, False)], "k int, codes string, lab_x int, rose boolean")
    out = cohorts.refined(rows, width=2, top=2)
    assert out.inputFiles() and all("lifelane-cohort" in f for f in out.inputFiles())
    assert sorted(map(tuple, out.select("k", "code_a1", "code_b2", "target").collect())) == [(1, 1, 1, 1), (2, 1, 0, 0)]


def test_keyed_tables_are_shuffled_once(spark):
    from pyspark.sql import functions as F

    from lifelane.operators.asof import Source, asof_many

    at = F.timestamp_micros(F.col("id") * 1_000_000).cast("timestamp_ntz").alias("t")
    rows = spark.range(100).select((F.col("id") % 7).alias("k"), at, "id")
    seen = rows.repartition("k").groupBy("k", "t").agg(F.max("id").alias("v"))
    out = asof_many(rows, by="k", left_ts="t", sources=[Source(seen, "t", ["v"]), Source(rows, "t", {"w": F.col("id")})], keyed=True)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan.split("Union")[0] and plan.count("Exchange hashpartitioning") == 3
    assert out.where("v = id AND w = id").count() == 100


def test_a_row_looks_at_few_cuts(spark):
    """Blocks of long keys, dense in some places, against counts of the cuts; no row meets all cuts of its key."""
    from pyspark.sql import functions as F

    from lifelane.operators import blocks

    at = F.when(F.col("id") % 3 == 0, F.col("id") * 1000).otherwise(F.col("id")).alias("at")
    rows = spark.range(6000).select(F.when(F.col("id") % 2 == 0, 1).when(F.col("id") % 10 < 9, None).otherwise(2).alias("k"), at)
    out, n = blocks.in_blocks(rows, ["k"], "at", 100)
    got = out.groupBy("k", "_block").agg(F.min("at").alias("lo"), F.max("at").alias("hi"), F.count("*").alias("n"), F.max("_blocks").alias("last")).orderBy("k", "_block").collect()
    assert n >= 60 and sum(r.n for r in got) == 6000 and max(r.n for r in got) < 250
    for a, b in zip(got, got[1:], strict=False):
        assert a.k != b.k or a.hi < b.lo
    assert all(r._block <= r["last"] for r in got) and {r.k for r in got} == {None, 1, 2}
    cuts = spark.createDataFrame([(1, [10, 20, 30, 1000], 10, 4, 248)], "k int, _cuts array<long>, _lo long, _blocks int, _width long")
    ends = {r._bin: (r._before, sorted(r._ends)) for r in blocks.grid(cuts, ["k"]).collect()}
    assert ends == {0: (0, [10, 20, 30]), 1: (3, []), 2: (3, []), 3: (3, [1000]), 4: (4, [])}


def test_equal_rows_count_once_without_tables_of_rows(spark):
    """Rows are found equal by a sort: no hash aggregate has whole rows as its keys."""
    from lifelane.operators import cleaning

    rows = [(1, None, 0.5), (1, None, 0.5), (1, "a", 0.5), (1, "a", None), (1, "a", None), (None, None, None), (None, None, None), (2, "a", -0.0), (2, "a", 0.0), (2, "a", float("nan")), (2, "a", float("nan"))]
    df = spark.createDataFrame(rows, "k long, c string, v double")
    assert sorted(map(str, cleaning.once(df, df.columns).select("k", "c", F.abs("v")).collect())) == sorted(map(str, df.dropDuplicates().select("k", "c", F.abs("v")).collect()))
    assert cleaning.once(df, ["k"]).count() == 3
    for name in ("weighted_dose", "interval_collapse_dose", "interval_membership"):
        plan = catalog.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        keys = re.findall(r"HashAggregate\(keys=\[([^]]*)\]", plan)
        assert keys and all("l_partkey" not in k and "pk#" not in k for k in keys), name


def test_flags_need_no_texts_and_rows_are_made_once(spark):
    """What makes the rows runs once, though keys are counted before the sweep; without texts, flags and numbers are the same."""
    from lifelane.operators import history

    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    at = F.timestamp_micros(F.col("id") * 3_600_000_000).cast("timestamp_ntz")
    rows = spark.range(400).select((F.col("id") % 7).alias("k"), F.concat(F.lit("AB"), F.col("id") % 5).alias("code"), at.alias("s"), (at + F.expr("make_dt_interval(1)")).alias("e"))
    rows = rows.mapInArrow(counted, rows.schema)
    ask = dict(end_inclusive=True, past_inclusive=True, exclude_own=True, prefixes={"zero": ("AB0",), "any": ("A",)})
    plain = history.code_history(rows, "k", "code", "s", "e", texts=False, **ask).collect()
    assert len(plain) == 400 and made.value == 400
    full = history.code_history(rows, "k", "code", "s", "e", **ask).collect()
    own = lambda r: (r.k, r.code, r.s, r.e, r.times_before, r.n_active, r.n_past, r.zero, r.any)
    assert sorted(map(own, plain)) == sorted(map(own, full))
    assert not any(r.active_codes or r.past_codes for r in plain) and any(r.active_codes for r in full)
