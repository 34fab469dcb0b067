"""Continuous versions of operators whose state is small: windowed counts of measurements with late rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_summary(stream: DataFrame, ts: str, group: str, value: str, *, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """start, group, n, total per tumbling window of event time; rows later than `late` behind the newest are dropped.

    Works on a stream and on a batch alike.
    """
    rows = stream.withColumn("_t", F.col(ts).cast("timestamp"))
    out = rows.withWatermark("_t", late).groupBy(F.window("_t", width).alias("_w"), group).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("_w.start").cast("timestamp_ntz").alias("start"), group, "n", "total")
