"""Spark's and DuckDB's results, as sorted rows of texts that are equal when values are."""

import decimal
import os

import duckdb

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{SF}/{name}'")
    return con


def text(x):
    if x is None:
        return "NULL"
    if isinstance(x, decimal.Decimal):
        x = float(x)
    if isinstance(x, float) and x == x and abs(x) < 1e18 and x == int(x):
        x = int(x)
    return str(x)


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(text(r[i]) for i in order) for r in values)


def spark_rows(df):
    return rows(df.columns, [tuple(r) for r in df.collect()])


def duck_rows(con, sql):
    found = con.execute(sql)
    return rows([d[0] for d in found.description], found.fetchall()), sorted(d[0] for d in found.description)
