"""Classifier scores (y: 0/1, p) to curves and metrics, by group. Cumulative counts come from value counts, not from sorts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ranks


def curve(df: DataFrame, group: tuple[str, ...] = (), y: str = "y", p: str = "p") -> DataFrame:
    """Per group and distinct score as threshold (>=): tp, fp, positives, negatives, and pos, neg at the score itself."""
    r = ranks.value_counts(df, p, group, {"pos": F.sum(F.col(y).cast("long"))})
    tp = F.col("pos_total") - F.col("pos_below")
    fp = (F.col("total") - F.col("below")) - tp
    return r.select(*group, F.col(p).alias("threshold"), tp.alias("tp"), fp.alias("fp"), F.col("pos_total").alias("positives"), (F.col("total") - F.col("pos_total")).alias("negatives"), "pos", (F.col("n") - F.col("pos")).alias("neg"))


def roc_curve(df: DataFrame, group: tuple[str, ...] = ()) -> DataFrame:
    return curve(df, group).select(*group, "threshold", F.try_divide("tp", "positives").alias("tpr"), F.try_divide("fp", "negatives").alias("fpr"))


def roc_auc(df: DataFrame, group: tuple[str, ...] = (), least: int = 0) -> DataFrame:
    """Area under the curve by the rank sum, ties at one half; null with one class only; groups below least rows are left out."""
    c = curve(df, group)
    beaten = F.col("pos") * (F.col("negatives") - F.col("fp") + F.col("neg") / 2)
    out = c.groupBy(*group).agg(F.sum(beaten).alias("_s"), F.max("positives").alias("positives"), F.max("negatives").alias("negatives"))
    return out.where(F.col("positives") + F.col("negatives") >= least).select(*group, F.try_divide("_s", F.col("positives").cast("double") * F.col("negatives")).alias("auc"), "positives", "negatives")


def average_precision(df: DataFrame, group: tuple[str, ...] = ()) -> DataFrame:
    """The step sum of precision over gains in recall."""
    c = curve(df, group)
    return c.groupBy(*group).agg(F.sum(F.try_divide("pos", "positives") * F.col("tp") / (F.col("tp") + F.col("fp"))).alias("average_precision"))


def precision_recall(df: DataFrame, group: tuple[str, ...] = ()) -> DataFrame:
    """The points of the precision-recall curve by threshold, with the share of positives as baseline."""
    c = curve(df, group)
    return c.select(*group, "threshold", F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), F.try_divide("tp", "positives").alias("recall"), F.try_divide(F.col("positives"), F.col("positives") + F.col("negatives")).alias("prevalence"))


def best_f1(df: DataFrame, group: tuple[str, ...] = ()) -> DataFrame:
    """The threshold of the largest F1, the smallest of equals."""
    f1 = 2 * F.col("tp") / (F.col("tp") + F.col("fp") + F.col("positives"))
    return curve(df, group).withColumn("f1", f1).groupBy(*group).agg(F.max_by("threshold", F.struct("f1", -F.col("threshold"))).alias("threshold"), F.max("f1").alias("f1"))


def confusion(df: DataFrame, group: tuple[str, ...] = (), threshold: float | Column = 0.5) -> DataFrame:
    hit, yes = F.col("p") >= threshold, F.col("y") == 1
    return df.groupBy(*group).agg(F.count_if(hit & yes).alias("tp"), F.count_if(hit & ~yes).alias("fp"), F.count_if(~hit & yes).alias("fn"), F.count_if(~hit & ~yes).alias("tn"), F.avg((F.col("p") - F.col("y")) * (F.col("p") - F.col("y"))).alias("brier"))


def figures(df: DataFrame, group: tuple[str, ...] = (), threshold: float = 0.5) -> DataFrame:
    """A confusion() at threshold with auc, average_precision, and the best F1 (f1_best) with its threshold (best_threshold), from one curve."""
    c = curve(df, group)
    hit = F.col("threshold") >= threshold
    beaten = F.col("pos") * (F.col("negatives") - F.col("fp") + F.col("neg") / 2)
    f1 = 2 * F.col("tp") / (F.col("tp") + F.col("fp") + F.col("positives"))
    miss = F.col("pos") * (F.col("threshold") - 1) * (F.col("threshold") - 1) + F.col("neg") * F.col("threshold") * F.col("threshold")
    out = c.withColumn("_f1", f1).groupBy(*group).agg(
        F.sum(F.when(hit, F.col("pos")).otherwise(0)).alias("tp"),
        F.sum(F.when(hit, F.col("neg")).otherwise(0)).alias("fp"),
        F.sum(F.when(~hit, F.col("pos")).otherwise(0)).alias("fn"),
        F.sum(F.when(~hit, F.col("neg")).otherwise(0)).alias("tn"),
        (F.sum(miss) / F.sum(F.col("pos") + F.col("neg"))).alias("brier"),
        F.sum(beaten).alias("_s"),
        F.max("positives").alias("positives"),
        F.max("negatives").alias("negatives"),
        F.sum(F.try_divide("pos", "positives") * F.col("tp") / (F.col("tp") + F.col("fp"))).alias("average_precision"),
        F.max_by("threshold", F.struct("_f1", -F.col("threshold"))).alias("best_threshold"),
        F.max("_f1").alias("f1_best"),
    )
    return out.withColumn("auc", F.try_divide("_s", F.col("positives").cast("double") * F.col("negatives"))).drop("_s")


def rates(c: DataFrame) -> DataFrame:
    d = F.try_divide
    return c.withColumns({"sensitivity": d(F.col("tp"), F.col("tp") + F.col("fn")), "specificity": d(F.col("tn"), F.col("tn") + F.col("fp")), "ppv": d(F.col("tp"), F.col("tp") + F.col("fp")), "npv": d(F.col("tn"), F.col("tn") + F.col("fn"))})


def metrics(c: DataFrame) -> DataFrame:
    """Further figures of a confusion(): accuracy, balanced accuracy, F1 of the positive class, weighted and macro, MCC."""
    tp, fp, fn, tn = (F.col(k).cast("double") for k in ("tp", "fp", "fn", "tn"))
    d = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    pos, neg = d(2 * tp, 2 * tp + fp + fn), d(2 * tn, 2 * tn + fp + fn)
    n = tp + fp + fn + tn
    return c.withColumns(
        {
            "accuracy": d(tp + tn, n),
            "balanced_accuracy": (d(tp, tp + fn) + d(tn, tn + fp)) / 2,
            "f1": pos,
            "f1_weighted": d(pos * (tp + fn) + neg * (tn + fp), n),
            "f1_macro": (pos + neg) / 2,
            "mcc": d(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))),
        }
    )


def calibration(df: DataFrame, bins: int = 10) -> DataFrame:
    """bin, n, mean score and share of positives by quantile bins of the score; a score on a cut belongs below it."""
    cuts = ranks.quantiles(df, "p", {f"q{i}": i / bins for i in range(1, bins)})
    at = sum(((F.col("p") > F.col(f"q{i}")).cast("int") for i in range(1, bins)), F.lit(0))
    rows = df.crossJoin(F.broadcast(cuts))  # one row of cut points
    return rows.groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.avg("p").alias("mean_score"), F.avg("y").alias("positives"))


def mean_roc(df: DataFrame, split: str, group: tuple[str, ...] = (), points: int = 100) -> DataFrame:
    """Per group and point of a false-positive grid: mean true-positive rate over splits and its 2.5 and 97.5 percentiles.

    Each score's piece of a split's curve knows both its ends, so the grid points it covers follow without a sort.
    """
    c = curve(df, (*group, split)).where("neg > 0 AND positives > 0")
    last = points - 1
    x0, x1 = (F.col("fp") - F.col("neg")) / F.col("negatives"), F.col("fp") / F.col("negatives")
    y0, y1 = (F.col("tp") - F.col("pos")) / F.col("positives"), F.col("tp") / F.col("positives")
    lo, hi = F.ceil((F.col("fp") - F.col("neg")) * last / F.col("negatives")), F.ceil(F.col("fp") * last / F.col("negatives")) - 1
    rows = c.select(*group, split, x0.alias("x0"), x1.alias("x1"), y0.alias("y0"), y1.alias("y1"), F.explode(F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.array().cast("array<bigint>"))).alias("i"))
    value = F.when(F.col("i") == 0, F.lit(0.0)).otherwise(F.col("y0") + (F.col("i") / last - F.col("x0")) / (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")))
    ends = df.select(*group, split).distinct().select(*group, split, F.lit(last).cast("bigint").alias("i"), F.lit(1.0).alias("v"))
    rows = rows.select(*group, split, "i", value.alias("v")).unionByName(ends)
    return rows.groupBy(*group, "i").agg(F.avg("v").alias("tpr"), F.percentile("v", 0.025).alias("lo"), F.percentile("v", 0.975).alias("hi")).withColumn("fpr", F.col("i") / last).drop("i")


def chosen(df: DataFrame, names: dict[str, str], keep: list[str] = []) -> DataFrame:  # noqa: B006
    """The columns of keep and the metrics of names, under their new names; a metric that df lacks raises, and so do two of one name."""
    if missing := [c for c in [*keep, *names] if c not in df.columns]:
        raise ValueError(f"no such columns: {', '.join(missing)}")
    if len({*keep, *names.values()}) < len(keep) + len(names):
        raise ValueError(f"names are given twice: {', '.join(names.values())}")
    return df.select(*keep, *[F.col(f"`{c}`").alias(n) for c, n in names.items()])


def over_splits(df: DataFrame, model: str, metrics: list[str]) -> DataFrame:
    """model and, for each metric, its mean over splits and its 2.5 and 97.5 percentiles (<metric>_mean, _lo, _hi)."""
    q = lambda c: f"`{c}`"
    return df.groupBy(model).agg(*[a for m in metrics for a in (F.avg(q(m)).alias(f"{m}_mean"), F.percentile(q(m), 0.025).alias(f"{m}_lo"), F.percentile(q(m), 0.975).alias(f"{m}_hi"))])


def compact(df: DataFrame, model: str, metrics: list[str], digits: int = 3) -> DataFrame:
    """over_splits() as one text for each metric: mean (low–high)."""
    text = lambda c: F.round(f"`{c}`", digits).cast("string")
    return df.select(model, *[F.concat(text(f"{m}_mean"), F.lit(" ("), text(f"{m}_lo"), F.lit("–"), text(f"{m}_hi"), F.lit(")")).alias(m) for m in metrics])


def class_weights(df: DataFrame, y: str) -> DataFrame:
    n = F.count("*")
    return df.groupBy(y).agg(n.alias("n")).withColumn("weight", F.sum("n").over(Window.partitionBy(F.lit(1))) / (2 * F.col("n")))


def stratified_keys(df: DataFrame, key: str, row: str, y: str, share: float, seed: int) -> DataFrame:
    """key, test: one row of each key, chosen by a hash, decides its class; of each class the ceil(share * n) lowest hashes are test.

    Ranks are taken within 256 buckets of the hash, so a class is never sorted by one task.
    """
    one = df.groupBy(key).agg(F.min_by(y, F.md5(F.concat_ws(":", F.lit(seed), key, row))).alias("_y"))
    one = one.withColumn("_h", F.md5(F.concat_ws(":", F.lit(seed), key))).withColumn("_b", F.substring("_h", 1, 2))
    per = one.groupBy("_y", "_b").agg(F.count("*").alias("_c"))
    w = Window.partitionBy("_y")
    per = per.withColumns({"_before": F.sum("_c").over(w.orderBy("_b")) - F.col("_c"), "_n": F.sum("_c").over(w)})
    rank = F.row_number().over(Window.partitionBy("_y", "_b").orderBy("_h", key))
    return one.withColumn("_r", rank).join(F.broadcast(per), ["_y", "_b"]).select(key, (F.col("_before") + F.col("_r") <= F.ceil(share * F.col("_n"))).alias("test"))


def attribution_summary(df: DataFrame, split: str, feature: str, value: str) -> DataFrame:
    """feature, importance (mean over splits of the mean absolute value; a split without the feature counts 0), sd."""
    per = df.groupBy(split, feature).agg(F.avg(F.abs(value)).alias("m"))
    n = df.agg(F.count_distinct(split).alias("_n"))
    out = per.groupBy(feature).agg(F.sum("m").alias("_s"), F.sum(F.col("m") * F.col("m")).alias("_q")).crossJoin(F.broadcast(n))
    mean = F.col("_s") / F.col("_n")
    return out.select(feature, mean.alias("importance"), F.sqrt(F.greatest((F.col("_q") - F.col("_n") * mean * mean) / (F.col("_n") - 1), F.lit(0.0))).alias("sd"))
