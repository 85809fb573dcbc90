"""Spark rows against SQL rows, whatever their order."""

import glob
import os

import duckdb


def connect(folder):
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for path in glob.glob(f"{folder}/*.parquet"):
        c.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return c


def compare(spark, connection, folder, query, sql):
    df = query(spark, folder)
    cursor = connection.execute(sql)
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(df.columns)
    order = [names.index(n) for n in sorted(names)]
    want = sorted(repr(tuple(r[i] for i in order)) for r in cursor.fetchall())
    assert sorted(repr(tuple(r)) for r in df.select(*sorted(df.columns)).collect()) == want
