"""Holds a query's rows against its SQL in DuckDB."""

import decimal
import math

import duckdb

from tests.conftest import TABLES


def plain(x):
    if isinstance(x, decimal.Decimal | float):
        return None if isinstance(x, float) and math.isnan(x) else round(float(x), 6)
    return None if x is None or x != x else str(x).split(" 00:00:00")[0] if not isinstance(x, int | bool | str) else x


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(([plain(r[i]) for i in order] for r in data), key=str)


def agree(spark, query, sql, folder):
    got = query(spark, folder)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    cur = con.execute(sql)
    columns = [c[0] for c in cur.description]
    want = cur.fetchall()
    assert sorted(columns) == sorted(got.columns)
    a, b = rows(got.columns, [tuple(r) for r in got.collect()]), rows(columns, want)
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        assert all(p == q or (isinstance(p, float) and isinstance(q, float | int) and math.isclose(p, q, abs_tol=1e-6)) or p == q for p, q in zip(x, y, strict=True)), (x, y)
    return len(a)
