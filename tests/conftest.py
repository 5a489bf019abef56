import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    conf = {"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.session.timeZone": "UTC", "spark.driver.memory": "4g"}
    session = SparkSession.builder.master("local[*]").config(map=conf).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small():
    return SMALL


@pytest.fixture(scope="session")
def same_as_sql(spark):
    """A check that a query's rows are those of its SQL."""
    import os

    import duckdb

    con = duckdb.connect()
    for name in os.listdir(SMALL):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SMALL}/{name}'")

    def check(query, sql):
        rel = con.sql(sql)
        cols = sorted(rel.columns)
        want = sorted(str([dict(zip(rel.columns, r, strict=True))[c] for c in cols]) for r in rel.fetchall())
        df = query(spark, SMALL)
        assert sorted(df.columns) == cols
        assert sorted(str([r[c] for c in cols]) for r in df.collect()) == want

    return check
