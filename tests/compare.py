"""Runs queries and their SQL over the same tables and compares the rows."""

from __future__ import annotations

import glob
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

DATA = "/root/testdata"


def views(d: str):
    con = duckdb.connect(config={"temp_directory": "/tmp/duckdb", "max_temp_directory_size": "4GB"})
    con.execute("set timezone='UTC'")
    for p in glob.glob(f"{d}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


def plain(v):
    if isinstance(v, float):
        return f"{v:.9g}"
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    return str(v)


def rows(cols, data):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return [cols[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in data)


def compare(spark, name: str, sf: str = "sf0.01"):
    import __spark_entry__ as e

    d = f"{DATA}/{sf}"
    t = time.time()
    df = e.queries()[name](spark, d)
    mine = rows(df.columns, df.collect())
    took = time.time() - t
    sql = e.oracle_sql().get(name)
    if sql is None:
        return took, len(mine[1]), None, mine
    cur = views(d).execute(sql)
    theirs = rows([c[0] for c in cur.description], cur.fetchall())
    return took, len(mine[1]), mine == theirs, (mine, theirs)


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as e

    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    args = [a for a in sys.argv[1:] if not a.startswith("sf")] or list(e.queries())
    sf = next((a for a in sys.argv[1:] if a.startswith("sf")), "sf0.01")
    for name in args:
        try:
            took, n, same, (mine, theirs) = compare(spark, name, sf)
            print(f"@@ {name}: {took:.1f} s, {n} rows, {'no SQL' if same is None else 'same' if same else 'DIFFERENT'}")
            if same is False:
                print("@@  ", mine[0], theirs[0] if isinstance(theirs[0], list) else "", len(theirs[1]))
                a, b = set(mine[1]), set(theirs[1])
                print("@@   only mine", sorted(a - b)[:3], "only SQL", sorted(b - a)[:3])
        except Exception as x:
            print(f"@@ {name}: FAILED {str(x)[:1500]}")
