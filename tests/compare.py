"""Rows of Spark and DuckDB in one form."""

import datetime
import decimal
import math


def plain(v):
    if v is None or isinstance(v, bool):
        return v
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}") + 0.0
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


def spark_rows(df):
    cols = sorted(df.columns)
    return sorted(repr(tuple(plain(r[c]) for c in cols)) for r in df.collect())


def duck_rows(con, sql, columns):
    r = con.execute(sql)
    names = [d[0] for d in r.description]
    assert sorted(names) == sorted(columns)
    at = [names.index(c) for c in sorted(columns)]
    return sorted(repr(tuple(plain(x[i]) for i in at)) for x in r.fetchall())
