import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

DATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    """DuckDB with the smallest tables as views."""
    import duckdb

    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"create view {t} as select * from '{DATA}/sf0.001/{t}.parquet'")
    return con


@pytest.fixture(scope="session")
def same():
    """Compares a DataFrame with a DuckDB relation, row by row in any order."""
    import math

    def norm(v):
        if v is None or isinstance(v, bool):
            return v
        if isinstance(v, float):
            return None if math.isnan(v) else round(v, 6) + 0.0
        return v if isinstance(v, int) else str(v)

    def check(df, relation):
        columns = sorted(df.columns)
        assert columns == sorted(relation.columns)
        at = [relation.columns.index(c) for c in columns]
        ours = sorted((tuple(map(norm, row)) for row in df.select(*columns).collect()), key=repr)
        theirs = sorted((tuple(norm(row[i]) for i in at) for row in relation.fetchall()), key=repr)
        assert ours == theirs

    return check
