"""One session for all tests, and comparison of a query with its SQL."""

import glob
import os
import sys

import duckdb
import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false").config("spark.driver.memory", "4g").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def as_text(v):
    return repr(v) if isinstance(v, float) else str([as_text(x) for x in v]) if isinstance(v, list | tuple) else str(v)


@pytest.fixture(scope="session")
def agree(spark, duck):
    def check(query, sql):
        df = query(spark, SF)
        names = sorted(df.columns)
        assert names == sorted(duck.sql(sql).columns)
        want = duck.sql("SELECT " + ", ".join(f'"{c}"' for c in names) + f" FROM ({sql})").fetchall()
        got = [tuple(r) for r in df.select(*(f"`{c}`" for c in names)).collect()]
        assert sorted(map(as_text, got)) == sorted(map(as_text, want))

    return check
