import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
DATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    from lodestone.session import ship

    ship(s)
    return s


@pytest.fixture(scope="session")
def duck():
    """DuckDB over the smallest test tables."""
    import duckdb

    con = duckdb.connect()
    for f in sorted(os.listdir(f"{DATA}/sf0.001")):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{DATA}/sf0.001/{f}')")
    return con


@pytest.fixture(scope="session")
def sf():
    return f"{DATA}/sf0.001"


def plain(v):
    """A value that compares alike whichever engine made it."""
    import datetime
    import decimal

    if isinstance(v, bool) or v is None or isinstance(v, str):
        return v
    if isinstance(v, (int, float, decimal.Decimal)):
        return round(float(v), 6)
    if isinstance(v, (datetime.datetime, datetime.date)):
        return str(v)[:19]
    if isinstance(v, (list, tuple)) or hasattr(v, "tolist"):
        return tuple(plain(x) for x in (v.tolist() if hasattr(v, "tolist") else v))
    return v


def same_rows(df, con, sql):
    """The rows of a Spark query and of its DuckDB SQL, columns in name order, as sorted lists."""
    names = sorted(df.columns)
    mine = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr)
    res = con.execute(sql)
    cols = [d[0] for d in res.description]
    assert sorted(cols) == names
    at = [cols.index(c) for c in names]
    theirs = sorted((tuple(plain(r[i]) for i in at) for r in res.fetchall()), key=repr)
    return mine, theirs
