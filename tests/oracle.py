"""Runs a query and its SQL counterpart and compares them as bags of rows."""

import glob
import os
from collections import Counter

import duckdb


def connect(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def bag(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(row[i] for i in order) for row in rows)


def spark_bag(df):
    return bag(df.columns, df.collect())


def duck_bag(con, sql):
    result = con.execute(sql)
    return bag([d[0] for d in result.description], result.fetchall())


def difference(df, con, sql):
    """Columns and some rows on which the two sides differ; empty when they agree."""
    result = con.execute(sql)
    names = sorted(d[0] for d in result.description)
    if sorted(df.columns) != names:
        return f"columns {sorted(df.columns)} / {names}"
    ours, theirs = spark_bag(df), bag([d[0] for d in result.description], result.fetchall())
    if ours == theirs:
        return ""
    return f"only ours {list((ours - theirs).items())[:3]} only theirs {list((theirs - ours).items())[:3]}"
