"""Experiments that are taken up again, attributions, sweeps, profiles and smoothing against plain versions."""

import datetime
import itertools
import math
import random
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from lifelane.functions import ranks
from lifelane.functions.times import DAY
from lifelane.operators import asof, disclosure, encoding, evaluation, history, intervals, modelling, stats
from lifelane.plans import experiment
from lifelane.sources import io


class Counting:
    """An estimator that counts its fits, and breaks while told to."""

    def __init__(self, inner, broken=None):
        self.inner, self.broken, self.fits = inner, broken, 0

    def fit(self, *args):
        self.fits += 1
        if self.broken:
            raise self.broken
        return self.inner.fit(*args)


def test_an_experiment_goes_on_where_it_stopped(spark, tmp_path):
    rows = spark.range(160).select((F.col("id") % 80).alias("k"), F.col("id").alias("row"), ((F.col("id") * 7) % 31).cast("double").alias("a"), F.when(F.col("id") % 3 > 0, "x").alias("c"))
    rows = rows.withColumn("y", (F.col("a") + F.col("row") % 5 > 17).cast("int")).repartition(2).cache()
    types = {"numeric": ["a"], "binary": [], "category": ["c"]}
    inner, grid = modelling.models(steps=5)["logistic"]
    good, bad = Counting(inner), Counting(inner, RuntimeError("an executor is lost"))

    def unreadable():
        raise OSError("no such store")

    tables = {"good": experiment.Table(rows, "k", "row", types, {"third": F.col("row") % 3}), "one_class": experiment.Table(rows.withColumn("y", F.lit(1)), "k", "row", types), "gone": unreadable}
    run = lambda: experiment.run(spark, tables, {"sound": (good, grid[:1]), "shaky": (bad, grid[:1])}, f"{tmp_path}/x", splits=2, folds=2)
    ledger = run()
    units = {(r.tbl, int(r.split), r.model): (r.state, r.why) for r in ledger.read("units").collect()}
    assert len(units) == 12 and sum(state == "done" for state, _ in units.values()) == 2
    assert "an executor is lost" in units["good", 0, "shaky"][1] and "both classes" in units["one_class", 1, "sound"][1] and "no such store" in units["gone", 0, "sound"][1]
    assert ledger.done() == {experiment.Unit("good", 0, "sound"), experiment.Unit("good", 1, "sound")}
    fits, bad.broken = good.fits, None
    del tables["one_class"], tables["gone"]
    ledger = run()
    assert good.fits == fits and bad.fits > 0 and len(ledger.done()) == 4  # what had ended was not fitted again
    scores, figures = ledger.read("predictions").collect(), ledger.read("metrics").collect()
    assert len(figures) == 4 and {r.third for r in scores} == {0, 1, 2}
    for f in figures:
        own = [r for r in scores if (r.split, r.model) == (f.split, f.model)]
        assert f.tp == sum(r.predicted and r.y for r in own) and f.positives + f.negatives == len(own) and 0.8 < f.auc <= 1
    assert ledger.read("search").count() == 4 and ledger.read("attributions").select("split", "model", "row").distinct().count() == len(scores)
    reports = experiment.reports(ledger, subgroups=("third",))
    assert {(r.model, r.splits) for r in reports["metrics"].collect()} == {("sound", 2), ("shaky", 2)}
    assert reports["roc"].count() == 200 and reports["roc_by_third"].select("third").distinct().count() == 3
    assert {r.feature for r in reports["importance"].collect()} >= {"num__s_0"}
    model = modelling.load(f"{ledger.path('models', experiment.Unit('good', 0, 'shaky'))}/pipeline")
    assert modelling.with_probability(model, rows).where("p BETWEEN 0 AND 1").count() == 160
    table, failed = experiment.repeated(rows, "k", "row", types, {"sound": (good, grid[:1]), "shaky": (Counting(inner, ValueError("no")), grid[:1])}, f"{tmp_path}/y", splits=1, folds=2)
    assert table.count() == 1 and failed == ["split 0, shaky: ValueError: no"]


def test_one_curve_gives_all_figures(spark):
    rows = spark.range(300).select((F.col("id") % 3).alias("g"), (F.col("id") % 7 < 3).cast("int").alias("y"), ((F.col("id") * 37 % 20) / 20).alias("p"))
    got = {r.g: r for r in evaluation.figures(rows, ("g",), 0.4).collect()}
    for other in (evaluation.confusion(rows, ("g",), 0.4), evaluation.roc_auc(rows, ("g",)), evaluation.average_precision(rows, ("g",))):
        for r in other.collect():
            assert all(abs(r[c] - got[r.g][c]) < 1e-9 for c in other.columns)
    for r in evaluation.best_f1(rows, ("g",)).collect():
        assert (r.threshold, r.f1) == (got[r.g].best_threshold, got[r.g].f1_best)


def test_leaf_shares_are_shapley_values():
    rng = np.random.default_rng(6)
    leaves = []
    for _ in range(3):  # trees that split the same features again, by threshold and by category

        def grow(path, depth):
            if depth == 0 or rng.random() < 0.2:
                leaves.append(modelling.Leaf(float(rng.normal()), list(path.items())))
                return
            f = int(rng.integers(4))
            step = (True, (1.0, 3.0)) if f == 3 else (False, (float(rng.integers(5)),))
            for left in (True, False):
                grow(path | {f: [*path.get(f, []), (*step, left)]}, depth - 1)

        grow({}, 4)
    x, z = rng.integers(0, 5, (5, 4)).astype(float), rng.integers(0, 5, (6, 4)).astype(float)

    def score(v):
        return sum(leaf.value for leaf in leaves if all(modelling.follows(v[[f]], steps)[0] for f, steps in leaf.path))

    got = modelling.leaf_shares(leaves, x, z)
    for i, j in itertools.product(range(5), range(6)):
        for f in range(4):
            rest, want = [g for g in range(4) if g != f], 0.0
            for n in range(4):
                for s in itertools.combinations(rest, n):
                    mixed = z[j].copy()
                    mixed[list(s)] = x[i][list(s)]
                    more = mixed.copy()
                    more[f] = x[i][f]
                    want += math.factorial(n) * math.factorial(3 - n) / math.factorial(4) * (score(more) - score(mixed))
            assert abs(got[i, j, f] - want) < 1e-9


def test_null_categories_become_the_mode(spark):
    rows = spark.createDataFrame([("b", 1.0), ("b", 2.0), ("a'\\", 3.0), (None, None), ("a'\\", 1.0)], "c string, v double")
    types = {"numeric": ["v"], "binary": [], "category": ["c"]}
    prep = modelling.fit_preparation(rows, types, {"c": ["a'\\", "b"]})
    got = [[*r.features[1:]] for r in prep.transform(spark.createDataFrame([(None, 1.0), ("b", 1.0), ("new", 1.0)], "c string, v double")).select(modelling.vector_to_array("features").alias("features")).collect()]
    assert got == [[1.0, 0.0], [0.0, 1.0], [0.0, 0.0]]  # of equally common values the smaller; unknown ones have no column
    assert modelling.modes(rows.where("c IS NULL"), ["c"]) == {"c": None}


@pytest.mark.parametrize("block", [1_000_000, 4])
@pytest.mark.parametrize("inclusive", [True, False])
def test_sweeps_equal_counting(spark, block, inclusive):
    rng = random.Random(block)
    at = lambda d: None if d is None else datetime.datetime(2020, 1, 1) + datetime.timedelta(days=d)
    rows = [(k, rng.choice("abcdef"), s, rng.choice([None, s, s + 1, s + 2, s + 9, s - 2]), i) for i, (k, s) in enumerate((rng.choice([1, 1, 1, 2, 3]), rng.randrange(25)) for _ in range(160))]
    df = spark.createDataFrame([(k, c, at(s), at(e), i, None) for k, c, s, e, i in rows] + [(None, "a", at(1), None, -1, "x"), (1, None, at(1), None, -2, "x"), (1, "a", None, None, -3, "x")], "k int, c string, s timestamp_ntz, e timestamp_ntz, i int, note string").repartition(3)
    out = history.swept(df, "k", "c", "s", "e", end_inclusive=inclusive, past_inclusive=not inclusive, exclude_own=inclusive, prefixes={"ab": ("a", "b")}, block=block).collect()
    assert len(out) == len(rows)
    got = {r.i: (r._active, r._n_active, r._past, r._n_past, r._times, r.ab) for r in out}
    for k, c, s, _, i in rows:
        mine = [(d, t, e) for kk, d, t, e, _ in rows if kk == k and t <= s]
        active = sorted({d for d, t, e in mine if t == s or e is None or e > s or (inclusive and e == s)} - ({c} if inclusive else set()))
        past = sorted({d for d, t, _ in mine if t < s or not inclusive})
        assert got[i] == (",".join(active), len(active), ",".join(past), len(past), sum(d == c and t < s for d, t, _ in mine), any(d in "ab" for d in active))


def test_profiles_of_any_type(spark):
    day = datetime.date(2020, 1, 1)
    rows = [(float("nan") if i == 3 else i / 2, Decimal(i) / 10, i % 2 == 0, day + datetime.timedelta(i), datetime.datetime(2020, 1, 1, i % 20), f"{i}" if i % 2 else "x", None, 1 << 60) for i in range(12)]
    df = spark.createDataFrame(rows, "a double, b decimal(9,1), c boolean, d date, e timestamp, f string, g int, h long")
    got = {r.column: r for r in disclosure.column_profile(df).collect()}
    assert {c: r.kind for c, r in got.items()} == {"a": "number", "b": "exact", "c": "truth", "d": "instant", "e": "instant", "f": "text", "g": "number", "h": "number"}
    assert got["a"].pseudo_max == 4.5 and got["a"].missing_percent == 0 and abs(got["a"].mean - (33 - 1.5) / 11) < 1e-9
    assert (got["b"].pseudo_min, got["b"].pseudo_max) == (0.2, 0.9) and (got["c"].true_count, got["c"].false_percent) == (6, 50.0)
    assert got["d"].first_at == datetime.datetime(2020, 1, 3) and got["d"].last_at == datetime.datetime(2020, 1, 10) and got["d"].mean is None
    assert got["d"].middle_at == datetime.datetime(2020, 1, 7) and got["e"].first_at == datetime.datetime(2020, 1, 1, 2)
    assert got["f"].mean == 6 and got["f"].true_count is None and got["g"].missing_percent == 100 and got["g"].mean is None and got["g"].true_count is None
    assert got["h"].pseudo_min == float(1 << 60)
    ends = disclosure.pseudo_extremes(df.withColumn("z", F.lit(1)), "d", ("z",)).first()
    assert ends.pseudo_median == datetime.datetime(2020, 1, 7)
    assert disclosure.column_profile(df.where("false")).count() == 0
    with pytest.raises(ValueError):
        disclosure.column_profile(spark.sql("SELECT array(1) AS a"))


def test_publication_of_small_cohorts(spark):
    df = spark.createDataFrame([(True, 1.0), (True, 2.0), (False, 5.0), (None, None)], "f boolean, v double")
    got = disclosure.publication_table(df, F.col("f"), {"Value": "v"}).orderBy("place").collect()
    assert [r.statistic for r in got] == ["Mean (SD)", "Median [IQR]", "Range", "Missing n (%)"]
    assert {r.first for r in got[:3]} == {"insufficient n"} and got[0].p == "—" and got[0].effect == "—" and got[1].p == ""
    assert got[3].first == "~0 (0.0%)" and got[3].second == "~0 (50.0%)" and (got[0].n_first, got[0].n_second) == (0, 0)
    big = spark.range(100).select((F.col("id") < 50).alias("f"), F.col("id").cast("double").alias("v"))
    top = disclosure.publication_table(big, F.col("f"), {"Value": "v"}).orderBy("place").first()
    assert (top.first, top.p, top.effect, top.n_first) == ("24.50 (14.58)", "<0.001", "1.000", 50)


def plain_lowess(x, y, share, passes):
    """The published algorithm, point by point."""
    n = len(x)
    k = max(2, int(share * n + 1e-10))
    rw, fit = np.ones(n), np.zeros(n)
    for _ in range(passes + 1):
        for i in range(n):
            near = sorted(range(n), key=lambda j: (abs(x[j] - x[i]), x[j]))[:k]
            u = np.abs(x[near] - x[i]) / max(abs(x[j] - x[i]) for j in near)
            w = np.where(u <= 0.001, 1, np.where(u <= 0.999, (1 - u**3) ** 3, 0)) * rw[near]
            w = w / w.sum()
            mean = (w * x[near]).sum()
            spread = (w * (x[near] - mean) ** 2).sum()
            fit[i] = (w * (1 + (x[i] - mean) * (x[near] - mean) / spread) * y[near]).sum()
        r = np.abs(y - fit)
        rw = (1 - np.minimum(r / (6 * np.median(r)), 1) ** 2) ** 2
    return fit


def test_outliers_lose_their_pull(spark):
    rng = np.random.default_rng(1)
    x = np.arange(20, 60).astype(float)
    y = 0.5 * x + rng.normal(0, 1, 40)
    y[17] += 80
    df = spark.createDataFrame([(g, float(a), float(b)) for g in ("m", "n") for a, b in zip(x, y, strict=True)] + [("m", None, 1.0), ("m", 1.0, None)], "g string, x double, y double")
    got = {(r.g, r.x): r.fit for r in stats.lowess(df, "x", "y", ("g",), 0.4).collect()}
    want = plain_lowess(x, y, 0.4, 3)
    assert all(abs(got[g, a] - f) < 1e-6 for g in ("m", "n") for a, f in zip(x, want, strict=True)) and len(got) == 80
    once = {r.x: r.fit for r in stats.lowess(df.where("g = 'm'"), "x", "y", share=0.4, passes=0).collect()}
    assert abs(got["m", 37.0] - 18.5) < 1 < abs(once[37.0] - 18.5)
    with pytest.raises(ValueError):
        stats.lowess(df, "x", "y", ("g",), most=39)


def test_quantiles_by_narrowing(spark):
    """Groups far larger than their brackets, with ties, nulls and a null key, against plain quantiles."""
    rng = np.random.default_rng(9)
    groups = {"a": rng.normal(0, 1, 3000), "b": rng.integers(0, 9, 2500).astype(float), None: rng.exponential(1, 1000), "few": np.array([3.0, 1.0]), "one": np.array([5.0])}
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs] + [("a", None), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    shares = {"lo": 0.0, "q1": 0.25, "q": 0.617, "hi": 1.0}
    got = {r.g: r for r in ranks.quantiles(df, "v", shares, ("g",), "n", accuracy=50).collect()}
    assert set(got) == set(groups)
    for g, vs in groups.items():
        assert got[g].n == len(vs) and all(abs(got[g][k] - np.quantile(vs, q)) < 1e-9 for k, q in shares.items())
    whole = ranks.quantiles(df, "v", shares, accuracy=50).first()
    everything = np.concatenate(list(groups.values()))
    assert all(abs(whole[k] - np.quantile(everything, q)) < 1e-9 for k, q in shares.items())
    # Only what lies within the brackets is sorted.
    assert ranks.quantiles(df.where("false"), "v", shares, ("g",)).count() == 0


def test_bucketed_tables_meet_without_an_exchange(spark):
    a = io.write_bucketed(spark.range(1000).select((F.col("id") % 50).alias("k"), F.col("id").alias("v")), "lifelane_test_a", "k", 4)
    b = io.write_bucketed(spark.range(50).select(F.col("id").alias("k"), (F.col("id") * 2).alias("w")), "lifelane_test_b", "k", 4)
    out = a.join(b.hint("merge"), "k").groupBy("k").agg(F.sum("v").alias("v"), F.max("w").alias("w"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "SortMergeJoin" in plan
    assert {(r.k, r.v, r.w) for r in out.collect()} == {(k, sum(range(k, 1000, 50)), 2 * k) for k in range(50)}
    for name in ("a", "b"):
        spark.sql(f"DROP TABLE lifelane_test_{name}")


def test_codes_as_a_vector(spark):
    df = spark.createDataFrame([(1, "b,a,new"), (2, None), (3, ""), (4, "a,a")], "k int, codes string")
    out = encoding.multi_hot_vector(df, "codes", ["a", "b", "c"], "hot")
    assert modelling.feature_names(out, "hot") == ["a", "b", "c"] and out.columns == ["k", "codes", "hot"]
    got = {r.k: r.hot for r in out.collect()}
    assert [*got[1].indices] == [0, 1] and got[2].numNonzeros() == got[3].numNonzeros() == 0 and [*got[4].toArray()] == [1.0, 0.0, 0.0]


@pytest.mark.parametrize("seed", [1, 2])
def test_blocks_change_nothing(spark, seed):
    """As-of joins and islands of long keys, in blocks and in one piece: ties, null instants and keys, open ends."""
    rng = random.Random(seed)
    at = lambda d: None if d is None else datetime.datetime(2020, 1, 1) + datetime.timedelta(days=d)
    left = spark.createDataFrame([(rng.choice([1, 1, 1, 2, None]), at(rng.choice([None, *range(60)])), i) for i in range(150)], "k int, t timestamp_ntz, i int")
    right = spark.createDataFrame([(rng.choice([1, 1, 1, 2, None]), at(rng.choice([None, *range(60)])), i, rng.choice([None, i])) for i in range(120)], "k int, u timestamp_ntz, j int, v int")
    sources = [
        asof.Source(right, "u", {"a": F.col("j")}, ties=["j"], tolerance=5 * DAY),
        asof.Source(right, "u", {"b": F.col("j")}, direction="forward", exact=False, ties=["j"], gap="g"),
        asof.Source(right, "u", {"c": F.col("v"), "d": F.col("j")}, ties=["j"], each=True, exact=False),
    ]
    for keyed in (False, True):
        one, many = (sorted(map(str, asof.asof_many(left, by="k", left_ts="t", sources=sources, keyed=keyed, block=b).collect())) for b in (None, 20))
        assert one == many and len(one) == 150 - (0 if not keyed else left.where("k IS NULL OR t IS NULL").count())
    spans = spark.createDataFrame([(rng.choice([1, 1, 1, 2]), s, None if rng.random() < 0.05 else s + datetime.timedelta(days=rng.choice([0, 1, 3, 20]))) for s in (at(rng.randrange(400)) for _ in range(150))], "k int, s timestamp_ntz, e timestamp_ntz")
    whole, parts = (sorted(map(str, intervals.collapse(spans, ["k"], "s", "e", aggs={"n": F.count("*")}, block=b).collect())) for b in (None, 12))
    assert whole == parts and len(whole) > 10


def test_a_split_is_joined_and_prepared_once(spark):
    rows = spark.range(400).selectExpr("id % 80 AS k", "id", "cast(id % 3 = 0 AS int) AS y", "cast(id * 7 % 31 AS double) AS v", "if(id % 2 = 0, 'a', 'b') AS c")
    train, test, prep = experiment.split_rows(experiment.Table(rows, "k", "id"), {"numeric": ["v"], "binary": [], "category": ["c"]}, {"c": ["a", "b"]}, 7, 0.2, 2)
    assert all("lifelane-train" in f for f in train.inputFiles()) and all("lifelane-test" in f for f in test.inputFiles())
    assert set(train.columns) == {*rows.columns, "features", "w", "fold"} and set(test.columns) == {*rows.columns, "features"}
    assert train.inputFiles() and test.inputFiles() and train.count() + test.count() == 400
    again = prep.transform(rows).select("id", F.col("features").alias("f"))
    assert train.select("id", "features").unionByName(test.select("id", "features")).join(again, "id").where("features = f").count() == 400


def test_models_are_fitted_side_by_side(spark, monkeypatch):
    from threading import Barrier

    from lifelane.queries import modelling as queries

    meet = Barrier(2, timeout=60)

    class Waiting:
        def fit(self, train, parameters):
            meet.wait()  # breaks unless the other fit runs too
            return self

    rows = spark.createDataFrame([(0, 0.1), (1, 0.9), (0, 0.4), (1, 0.3)], "y int, p double")
    monkeypatch.setattr(queries, "_prepared", lambda spark, d: (None, rows, rows))
    monkeypatch.setattr(modelling, "models", lambda **_: {"a": (Waiting(), [{}]), "b": (Waiting(), [{}])})
    monkeypatch.setattr(modelling, "with_probability", lambda model, df: df)
    assert sorted((r.model, r.auc) for r in queries.ml_train_models(spark, "").collect()) == [("a", 0.75), ("b", 0.75)]


class Noting:
    """An estimator that notes the points and folds that it is fitted on."""

    def __init__(self):
        self.fits = []

    def fit(self, train, parameters):
        self.fits.append((*parameters.values(), *sorted(r.fold for r in train.select("fold").distinct().collect())))
        return self


def test_the_set_of_models_is_searched_whole(spark, monkeypatch):
    from lifelane.queries import modelling as queries

    penalty = modelling.models()["logistic"][0].regParam
    rows = spark.range(40).selectExpr("cast(id % 2 AS int) AS y", "cast(id % 10 / 10 AS double) AS p", "cast(id % 5 AS int) AS fold")
    noted, asked = {"a": Noting(), "b": Noting()}, []
    monkeypatch.setattr(queries, "_prepared", lambda spark, d: (None, rows, rows))
    monkeypatch.setattr(modelling, "models", lambda **given: asked.append(given) or {n: (e, [{penalty: v} for v in (0.1, 0.2, 0.3)]) for n, e in noted.items()})
    monkeypatch.setattr(modelling, "with_probability", lambda model, df: df)
    assert {r.model for r in queries.ml_train_models(spark, "").collect()} == {"a", "b"}
    assert asked == [{}]  # full rounds and steps
    folds = [tuple(i for i in range(5) if i != left) for left in range(5)]
    for e in noted.values():
        assert sorted(e.fits) == sorted([(v, *f) for v in (0.1, 0.2, 0.3) for f in folds] + [(0.1, *range(5))])


def test_the_experiment_is_run_whole(spark, monkeypatch):
    from lifelane.queries import modelling as queries

    class Begun(Exception):
        pass

    def begun(spark, tables, models, folder, *, splits=5, folds=5, background=100, **_):
        raise Begun(models, splits, folds, background)

    monkeypatch.setattr(experiment, "run", begun)
    with pytest.raises(Begun) as e:
        queries.ml_experiment(spark, "/root/testdata/sf0.001")
    models, *counts = e.value.args
    assert counts == [5, 5, 100] and {n: len(g) for n, (_, g) in models.items()} == {"logistic": 3, "boosted": 6, "boosted_slow": 4, "forest": 4}
    assert [models[n][0].getMaxIter() for n in ("logistic", "boosted", "boosted_slow")] == [1000, 100, 100]
    trees = models["forest"][0].numTrees
    assert {point[trees] for point in models["forest"][1]} == {50, 100}
