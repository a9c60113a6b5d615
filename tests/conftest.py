import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    conf = {"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.sql.session.timeZone": "UTC", "spark.driver.memory": "4g", "spark.ui.showConsoleProgress": "false", "spark.checkpoint.dir": f"file://{tmp_path_factory.mktemp('shared')}"}
    s = SparkSession.builder.master("local[8]").config(map=conf).getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    """A function from a folder of tables to a DuckDB connection over them."""
    import duckdb

    def over(folder: str):
        c = duckdb.connect()
        c.execute("set timezone = 'UTC'")
        for name in os.listdir(folder):
            if name.endswith(".parquet"):
                c.execute(f"create view {name[:-8]} as select * from '{folder}/{name}'")
        return c

    return over


@pytest.fixture(scope="session")
def same(spark, duck):
    """Asserts that a query and its SQL give the same rows over a folder of tables."""

    def check(query, sql: str, folder: str) -> None:
        df = query(spark, folder)
        got = duck(folder).execute(sql)
        names = [d[0] for d in got.description]
        assert sorted(names) == sorted(df.columns)
        at = [names.index(c) for c in df.columns]
        assert sorted(repr(tuple(r)) for r in df.collect()) == sorted(repr(tuple(r[i] for i in at)) for r in got.fetchall())

    return check
