"""The domain tables, made from the driver's tables: as DataFrames and, under the same names, as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.io import table


def exposures(spark: SparkSession, d: str) -> DataFrame:
    """k, code, brand, s, e (open: oe), dose, okey, ln, pk: a customer's shipments as intervals."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_linestatus", "l_returnflag", "l_shipdate")
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    part = table(spark, d, "part").select("p_partkey", "p_type", "p_brand")
    rows = li.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(part, F.col("l_partkey") == F.col("p_partkey"))
    end = F.col("l_shipdate") + F.make_dt_interval(F.col("l_quantity").cast("int"))
    return rows.select(
        F.col("o_custkey").alias("k"),
        F.col("p_type").alias("code"),
        F.col("p_brand").alias("brand"),
        F.col("l_shipdate").alias("s"),
        end.alias("e"),
        F.when(F.col("l_linestatus") != "O", end).alias("oe"),
        F.col("l_extendedprice").alias("dose"),
        F.col("l_returnflag").alias("rf"),
        F.col("l_orderkey").alias("okey"),
        F.col("l_linenumber").alias("ln"),
        F.col("l_partkey").alias("pk"),
    )


EXPO = """expo AS (SELECT o_custkey AS k, p_type AS code, p_brand AS brand, l_shipdate AS s, l_shipdate + to_days(l_quantity::INT) AS e,
  CASE WHEN l_linestatus <> 'O' THEN l_shipdate + to_days(l_quantity::INT) END AS oe, l_extendedprice AS dose, l_returnflag AS rf, l_orderkey AS okey, l_linenumber AS ln, l_partkey AS pk
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)"""


def measures(spark: SparkSession, d: str) -> DataFrame:
    """event_id, user_id, ts, event_type, value: a measurement series without ties."""
    return table(spark, d, "events").select("event_id", "user_id", "ts", "event_type", "value")


def flags(spark: SparkSession, d: str) -> DataFrame:
    """event_id, user_id, ts, test, flag, abnormal: laboratory results."""
    flag = F.when(F.col("value") < 5, F.lit("Lav")).when(F.col("value") > 60, F.lit("Høj")).otherwise(F.lit("Normal"))
    rows = measures(spark, d).select("event_id", "user_id", "ts", F.col("event_type").alias("test"), flag.alias("flag"))
    return rows.withColumn("abnormal", F.col("flag").isin("Lav", "Høj").cast("int"))


LABS = """labs AS (SELECT event_id, user_id, ts, event_type AS test, CASE WHEN value < 5 THEN 'Lav' WHEN value > 60 THEN 'Høj' ELSE 'Normal' END AS flag,
  CASE WHEN value < 5 OR value > 60 THEN 1 ELSE 0 END AS abnormal FROM events)"""


def spending(spark: SparkSession, d: str) -> DataFrame:
    """o_orderkey, k, day, amount: a yearly series with ties."""
    return table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("k"), F.col("o_orderdate").alias("day"), F.col("o_totalprice").alias("amount"))


SPEND = "spend AS (SELECT o_orderkey, o_custkey AS k, o_orderdate AS day, o_totalprice AS amount FROM orders)"


def stays(spark: SparkSession, d: str) -> DataFrame:
    """okey, k, s, e: an order's stay, from its day to its last shipment."""
    last = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("e"))
    return spending(spark, d).join(last, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_orderkey").alias("okey"), "k", F.col("day").alias("s"), "e")


STAYS = "stays AS (SELECT o_orderkey AS okey, o_custkey AS k, o_orderdate AS s, max(l_shipdate) AS e FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL)"


def predictions(spark: SparkSession, d: str) -> DataFrame:
    """split, user_id, event_id, y, p, model: scores in 1000 steps with ties."""
    rows = measures(spark, d)
    p = (F.floor((F.col("event_id") * 7919 % 1000) / 2) + F.floor(F.least(F.col("value"), F.lit(100.0))) * 5) / 1000
    return rows.select((F.col("event_id") % 5).alias("split"), "user_id", "event_id", "event_type", (F.col("value") > 20).cast("int").alias("y"), p.alias("p"))


PRED = """pred AS (SELECT event_id % 5 AS split, user_id, event_id, event_type, (value > 20)::INT AS y,
  ((event_id * 7919 % 1000) // 2 + CAST(floor(least(value, 100.0)) AS BIGINT) * 5)::DOUBLE / 1000 AS p FROM events)"""


def r(c, digits: int = 4):
    """A double rounded for comparison the way SQL engines on binary floats do it: scaled, halves away from zero."""
    x = (F.col(c) if isinstance(c, str) else c).cast("double")
    return F.signum(x) * F.floor(F.abs(x) * 10.0**digits + 0.5) / 10.0**digits
