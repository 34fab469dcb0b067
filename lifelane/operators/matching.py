"""Texts matched to reference texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def likeness(a, b):
    """100 for equal texts, down to 0: edit distance over the longer length."""
    longest = F.greatest(F.length(a), F.length(b), F.lit(1))
    return (1 - F.levenshtein(a, b) / longest) * 100


def best_reference(texts: DataFrame, text: str, reference: DataFrame, ref_text: str, ref_id: str, threshold: float = 89.0) -> DataFrame:
    """text, ref_id, score for each distinct text: the best reference at or above threshold, the smallest id of equals.

    An edit touches three trigrams at most, so of the trigrams of a text, one among the rarest 3e + 1 is in every
    reference within e edits: only these look for candidates, and trigrams that very many references hold drop out
    where a text has rarer ones. No cross join; texts so short that the edits allowed reach all their trigrams must
    share one all the same.
    """

    def grams(df, c):
        padded = F.concat(F.lit("  "), F.lower(F.col(c)), F.lit(" "))
        n = F.length(padded) - 2
        tri = F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(padded, i, F.lit(3)))
        return df.withColumn("_g", F.explode(F.array_distinct(tri)))

    left = grams(texts.select(text).where(F.col(text).isNotNull()).distinct(), text)
    right = grams(reference.select(ref_text, ref_id).dropDuplicates(), ref_text)
    slack = 1 - threshold / 100
    often = right.groupBy("_g").agg(F.count("*").alias("_df"))
    edits = F.floor(F.length(text) * (slack / (1 - slack)) + 1e-9) if slack < 1 else F.length(text)
    rank = F.row_number().over(Window.partitionBy(text).orderBy(F.col("_df").asc_nulls_first(), "_g"))
    left = left.join(often, "_g", "left").withColumn("_r", rank).where((F.col("_r") <= 3 * edits + 1) & F.col("_df").isNotNull()).select(text, "_g")
    short, long = F.least(F.length(text), F.length(ref_text)), F.greatest(F.length(text), F.length(ref_text))
    pairs = left.join(right, "_g").where(long - short <= slack * long).select(text, ref_text, ref_id).distinct()
    scored = pairs.withColumn("score", likeness(F.col(text), F.col(ref_text))).where(F.col("score") >= threshold)
    return scored.groupBy(text).agg(F.max_by(ref_id, F.struct("score", -F.col(ref_id))).alias(ref_id), F.max("score").alias("score"))
