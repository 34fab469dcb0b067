"""Every query with SQL against DuckDB on the smallest tables; those without SQL must run."""

import pytest

from lifelane import catalog

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_matches_sql(spark, duck, same, name):
    same(catalog.queries()[name](spark, SF), duck.sql(catalog.oracle_sql()[name]))


@pytest.mark.parametrize("name", sorted(catalog.queries().keys() - catalog.oracle_sql().keys()))
def test_runs(spark, name):
    assert catalog.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns
    assert entry.oracle_sql().keys() <= entry.queries().keys()


def test_models_learn(spark):
    """One pass through preparation, folds, out-of-fold scores and attributions."""
    from pyspark.sql import functions as F

    from lifelane.operators import evaluation, modelling

    rows = spark.range(240).select((F.col("id") % 80).alias("k"), F.col("id").alias("row"), (F.col("id") % 7).cast("double").alias("a"), F.when(F.col("id") % 5 > 0, (F.col("id") % 11).cast("double")).alias("b"), F.when(F.col("id") % 2 == 0, "x").otherwise("y").alias("c"))
    rows = rows.withColumn("y", ((F.col("a") > 3) & (F.col("row") % 10 > 0)).cast("int"))
    types = modelling.feature_types(rows, "y", ("k", "row"))
    assert types == {"numeric": ["a", "b"], "binary": [], "category": ["c"]}
    ready = modelling.folded(modelling.weighted(modelling.preparation(types).fit(rows).transform(rows)), "k", k=3).cache()
    assert ready.groupBy("k").agg(F.count_distinct("fold").alias("n")).where("n > 1").isEmpty()
    scored = modelling.out_of_fold(ready, modelling.models(steps=50)["logistic"][0])
    assert scored.count() == 240 and evaluation.roc_auc(scored.select("y", "p")).collect()[0].auc > 0.8
    model = modelling.models(steps=50)["logistic"][0].fit(ready)
    top = modelling.linear_attribution(model, ready, ready, ["row"]).groupBy("feature").agg(F.avg(F.abs("value")).alias("v")).orderBy(F.desc("v")).first()
    assert top.feature == "num__s_0"  # the first of the standardised numbers: a
    shap = modelling.sampled_attribution(model, ready.where("row < 3"), ready.where("row BETWEEN 10 AND 11"), "row", permutations=2)
    total = {r.row: r.s for r in shap.groupBy("row").agg(F.sum("value").alias("s")).collect()}
    p = {r.row: r.p for r in modelling.with_probability(model, ready.where("row < 3 OR row BETWEEN 10 AND 11")).collect()}
    for row, s in total.items():
        assert abs(s - (p[row] - (p[10] + p[11]) / 2)) < 1e-9


def test_search_finds_the_best_point(spark):
    from pyspark.sql import functions as F

    from lifelane.operators import modelling

    rows = spark.range(120).select(F.col("id").alias("k"), ((F.col("id") * 7) % 31).cast("double").alias("a"), (F.col("id") % 3).cast("double").alias("b"))
    rows = rows.withColumn("y", (F.col("a") > 15).cast("int"))
    types = {"numeric": ["a", "b"], "binary": [], "category": []}
    ready = modelling.folded(modelling.weighted(modelling.preparation(types).fit(rows).transform(rows)), "k", k=3).cache()
    estimator, grid = modelling.models(steps=20)["logistic"]
    model, parameters, table = modelling.grid_search(ready, estimator, grid)
    found = {r.candidate: r for r in table.collect()}
    assert set(found) == {0, 1, 2} and all(r.auc > 0.95 and r.average_precision > 0.9 and r.balanced_accuracy > 0.8 for r in found.values())
    assert parameters in grid and modelling.with_probability(model, ready).where("p > 0.5 AND y = 1").count() > 40
    assert [len(g) for _, g in modelling.models().values()] == [3, 6, 4, 4]
