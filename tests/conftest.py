import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "6g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


def _plain(v):
    return float(v) if isinstance(v, float) else v


def rows_of(df):
    cols = sorted(df.columns)
    return sorted(repr(tuple(_plain(r[c]) for c in cols)) for r in df.collect())


def duck_rows(sql, sf=SF):
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{sf}/{f}'")
    cur = con.execute(sql)
    cols = [c[0] for c in cur.description]
    order = [cols.index(c) for c in sorted(cols)]
    return sorted(cols), sorted(repr(tuple(_plain(r[i]) for i in order)) for r in cur.fetchall())
