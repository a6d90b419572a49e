import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "3g").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def oracle():
    """Rows of a SQL twin over the smallest tables."""
    import glob

    import duckdb

    con = duckdb.connect()
    for p in glob.glob(f"{SMALL}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return lambda sql: con.sql(sql)


def normal(v):
    if isinstance(v, float):
        return f"{round(v, 5) + 0.0:.6g}"
    if isinstance(v, (list, tuple)):
        return repr([normal(x) for x in v])
    return repr(v)


def same_rows(df, rel):
    cols = sorted(df.columns)
    assert cols == sorted(rel.columns)
    at = [list(rel.columns).index(c) for c in cols]
    mine = sorted(tuple(normal(r[c]) for c in cols) for r in df.collect())
    theirs = sorted(tuple(normal(r[i]) for i in at) for r in rel.fetchall())
    assert mine == theirs
