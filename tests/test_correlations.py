"""Rank correlations of many columns against pandas, pair by pair."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from lifelane.operators import correlations

COLUMNS = ["whole", "other", "holes", "same holes", "few", "constant", "empty"]


@pytest.fixture(scope="module")
def frame():
    rng = random.Random(5)
    rows = []
    for i in range(700):
        x = rng.choice([0.0, 0.0, rng.random(), -rng.random() * 1e6])
        gap = rng.random() < 0.3
        rows.append((x, x * rng.random(), None if gap else rng.randrange(9) + x, None if gap else x * x, None if rng.random() < 0.6 else float(i % 4), 3.0, None))
    return pd.DataFrame(rows, columns=COLUMNS, dtype=float)


def _table(spark, frame):
    rows = [tuple(None if pd.isna(v) else float(v) for v in r) for r in frame.itertuples(index=False)]
    return spark.createDataFrame(rows, ", ".join(f"`{c}` double" for c in frame.columns)).repartition(3)


def test_every_pair_has_the_ranks_of_its_rows(spark, frame):
    got = {(r.a, r.b): r for r in correlations.spearman_pairs(_table(spark, frame), COLUMNS).collect()}
    assert set(got) == {(a, b) for i, a in enumerate(COLUMNS) for b in COLUMNS[i + 1 :]}
    for (a, b), r in got.items():
        both = frame[[a, b]].dropna().rank()
        assert r.n == len(both)
        rho = both[a].corr(both[b]) if len(both) >= 3 else None
        assert (r.rho is None and r.p is None) if rho is None or pd.isna(rho) else abs(r.rho - rho) < 1e-12 and 0 <= r.p <= 1


def test_one_target(spark, frame):
    rows = _table(spark, frame)
    got = {r.feature: (r.rho, r.n) for r in correlations.spearman(rows, COLUMNS[1:], "whole").collect()}
    want = {r.b: (r.rho, r.n) for r in correlations.correlations(rows, ["whole"], COLUMNS).collect()}
    assert got.keys() == want.keys() == set(COLUMNS[1:])
    for c, (rho, n) in got.items():
        assert n == want[c][1] and (rho is None) == (want[c][0] is None) and (rho is None or abs(rho - want[c][0]) < 1e-12)


def test_many_columns_and_their_patterns(spark):
    """More columns than a word has bits, in three patterns, and an empty table."""
    names = [f"x{i}" for i in range(130)]
    rows = spark.range(90).select(*[F.when((F.col("id") % 5 != 0) if i % 3 == 1 else (F.col("id") % 7 != 0) if i % 3 == 2 else F.lit(True), (F.col("id") * (i + 3)) % 137).cast("double").alias(c) for i, c in enumerate(names)])
    assert correlations.null_patterns(rows, names) == [i % 3 for i in range(130)]
    frame = rows.toPandas()
    got = correlations.correlations(rows, names[:2], names).collect()
    assert len(got) == 129 + 128
    for r in got:
        both = frame[[r.a, r.b]].dropna().rank()
        assert r.n == len(both) and abs(r.rho - both[r.a].corr(both[r.b])) < 1e-12
    empty = correlations.spearman_pairs(rows.limit(0), names[:3]).collect()
    assert [(r.rho, r.n, r.p) for r in empty] == [(None, 0, None)] * 3
