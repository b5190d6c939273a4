import glob
import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[*]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "6g")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    """Values as compared: floats rounded, arrays as lists."""
    if isinstance(value, float):
        return round(value, 9)
    return [plain(v) for v in value] if isinstance(value, (list, tuple)) else value


@pytest.fixture(scope="session")
def same_as_sql(spark, duck):
    """Compare a query's rows with its SQL's, columns by name, rows in any order."""

    def check(query, sql):
        df = query(spark, DATA)
        names = sorted(df.columns)
        mine = sorted((tuple(plain(r[n]) for n in names) for r in df.collect()), key=repr)
        cur = duck.execute(sql)
        order = [d[0] for d in cur.description]
        assert sorted(order) == names
        at = [order.index(n) for n in names]
        theirs = sorted((tuple(plain(r[i]) for i in at) for r in cur.fetchall()), key=repr)
        assert mine == theirs

    return check
