"""Rows of a query and of its SQL on DuckDB, in a form that can be compared."""

import datetime
import decimal
import os

import duckdb


def database(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(sf_dir):
        path = f"{sf_dir}/{f}"
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{path}{'/*' if os.path.isdir(path) else ''}')")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        return repr(float(v)) if v % 1 else repr(int(v))
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return repr(v)


def rows(table):
    table = table.select(sorted(table.column_names))
    return sorted(tuple(map(plain, r)) for r in zip(*[c.to_pylist() for c in table.columns]))
