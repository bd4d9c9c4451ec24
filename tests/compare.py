"""Rows of a query and of its SQL in DuckDB, made comparable."""

import datetime
import decimal

from lexframe.plans.fixtures import TABLES


def plain(v):
    if isinstance(v, float | decimal.Decimal):
        return float(f"{v:.9g}")
    if isinstance(v, dict):
        return tuple(map(plain, v.values()))
    if isinstance(v, list | tuple):
        return tuple(map(plain, v))
    if isinstance(v, datetime.datetime) and v.tzinfo:
        return v.replace(tzinfo=None)
    return v


def of_spark(df):
    names = sorted(df.columns)
    return names, sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr)


def of_duckdb(sql, sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    found = con.sql(sql)
    at = sorted(range(len(found.columns)), key=lambda i: found.columns[i])
    return [found.columns[i] for i in at], sorted((tuple(plain(r[i]) for i in at) for r in found.fetchall()), key=repr)
