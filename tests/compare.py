"""Runs a query and its SQL and compares all rows, whatever their order."""

import decimal
import os

import duckdb

DATA = "/root/testdata"


def tables(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{f}'")
    return con


def plain(value):
    if isinstance(value, float | decimal.Decimal):
        return f"{float(value):.9g}"
    return str(value)


def spark_rows(df, columns):
    return sorted(tuple(map(plain, r)) for r in df.select(*columns).collect())


def sql_rows(con, sql, columns):
    found = con.sql(sql)
    places = [list(found.columns).index(c) for c in columns]
    assert len(found.columns) == len(columns)
    return sorted(tuple(plain(r[i]) for i in places) for r in found.fetchall())


def same(spark, sf_dir, run, sql):
    df = run(spark, sf_dir)
    columns = sorted(df.columns)
    got, expected = spark_rows(df, columns), sql_rows(tables(sf_dir), sql, columns)
    assert got == expected
    return len(got)
