"""Run a query and its SQL over the same tables, and compare them as the driver does: by rows, in any order."""

import glob
import os
from collections import Counter
from datetime import datetime

SF = "/root/testdata/sf0.001"


def _cell(v):
    if isinstance(v, float):
        return round(v, 9)
    if isinstance(v, datetime):
        return v.replace(tzinfo=None)
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_cell(r[i]) for i in order) for r in rows)


def database():
    import duckdb

    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for path in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def assert_agrees(spark, con, query, sql):
    got = query(spark, SF)
    want = con.sql(sql)
    assert sorted(got.columns) == sorted(want.columns)
    mine, theirs = rows_of(got.columns, got.collect()), rows_of(want.columns, want.fetchall())
    assert mine == theirs, (list((mine - theirs).items())[:3], list((theirs - mine).items())[:3])
