"""Tables in and out."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's path under spark.checkpoint.dir; a temporary one only where that is unset and Spark runs in one process."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        shared = tempfile.mkdtemp(prefix="lifelane-shared-")
        spark.conf.set("spark.checkpoint.dir", shared)
    return f"{shared}/lifelane-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df written once to the shared folder and read again: what uses it twice computes it once, also after an executor is lost."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def drop(*tables: DataFrame) -> None:
    """Deletes tables that written() wrote, once nothing will read them any more."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.written_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def table_or_none(spark: SparkSession | DataFrameReader, path: str) -> DataFrame | None:
    """The table, or none if its path is missing, so that a job can skip the stage that needs it. spark may be a reader with options."""
    try:
        return (spark if isinstance(spark, DataFrameReader) else spark.read).parquet(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def code_reference(spark: SparkSession, path: str, schema: str, sep: str = ";") -> DataFrame:
    """A reference list as CSV with a header and quoted fields; the schema is stated, so nothing is inferred."""
    return spark.read.schema(schema).option("sep", sep).option("quote", '"').option("header", True).csv(path)


def write_table(df: DataFrame, path: str, partitions: int | None = None, key: str | None = None) -> DataFrame:
    """Writes parquet, dealt over partitions by key if given, and returns the table as read back."""
    if partitions and key:
        df = df.repartition(partitions, key)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_bucketed(df: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
    """Writes a table of the catalog in buckets of key, sorted by it: stages that join or group by key need no exchange.

    Tables that meet each other need the same number of buckets. A table of that name is replaced.
    """
    df.repartition(buckets, key).write.mode("overwrite").format("parquet").bucketBy(buckets, key).sortBy(key).saveAsTable(name)
    return df.sparkSession.table(name)


def write_results(df: DataFrame, path: str) -> None:
    """Small result tables as CSV with a header; quotes within a cell are doubled."""
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def grouped_codes(df: DataFrame, codes: str, sep: str = ", ") -> DataFrame:
    """A group table whose cell lists several codes, as one row per (code, group columns)."""
    return df.withColumn("code", F.explode(F.split(codes, sep))).drop(codes)
