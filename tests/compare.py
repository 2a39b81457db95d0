"""Comparison of a Spark query with its DuckDB SQL."""

import math

import duckdb

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 6))
    return repr(value)


def rows_of(df):
    names = sorted(df.columns)
    return names, sorted(tuple(plain(r[c]) for c in names) for r in df.collect())


def duck_rows(sql, sf_dir):
    with duckdb.connect() as con:
        for table in TABLES:
            con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
        found = con.sql(sql)
        names = sorted(found.columns)
        at = [found.columns.index(c) for c in names]
        return names, sorted(tuple(plain(r[i]) for i in at) for r in found.fetchall())
