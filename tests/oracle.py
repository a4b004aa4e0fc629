"""Compare a query with its DuckDB oracle on the same tables."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if isinstance(value, float):
        return float(f"{value:.12g}")
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    return str(value) if hasattr(value, "isoformat") else value


def duck(folder):
    connection = duckdb.connect()
    for table in TABLES:
        path = f"{folder}/{table}.parquet"
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return connection


def assert_same(df, connection, sql):
    columns = sorted(df.columns)
    relation = connection.sql(sql)
    assert sorted(relation.columns) == columns
    ours = sorted(repr(plain(tuple(r))) for r in df.select(*[f"`{c}`" for c in columns]).collect())
    theirs = sorted(repr(plain(r)) for r in relation.select(*[f'"{c}"' for c in columns]).fetchall())
    assert ours == theirs
