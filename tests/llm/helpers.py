"""Compares a query with its SQL on the same tables."""

import glob
import os

import duckdb

SMALL = "/root/testdata/sf0.001"


def plain(value):
    if isinstance(value, float):
        return round(value, 6)
    return value


def oracle_rows(sql, sf_dir=SMALL):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    got = con.sql(sql)
    return got.columns, got.fetchall()


def assert_equals_oracle(spark, query, sql, sf_dir=SMALL):
    columns, want = oracle_rows(sql, sf_dir)
    df = query(spark, sf_dir)
    assert sorted(df.columns) == sorted(columns)
    got = [tuple(plain(r[c]) for c in columns) for r in df.collect()]
    key = lambda row: tuple(map(str, row))
    assert sorted(got, key=key) == sorted((tuple(map(plain, r)) for r in want), key=key)
