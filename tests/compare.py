"""Runs a query and its SQL and compares the rows."""

from __future__ import annotations

import math
from collections import Counter
from decimal import Decimal


def plain(x):
    if isinstance(x, Decimal):
        x = float(x)
    if isinstance(x, float):
        return None if math.isnan(x) else 0.0 if x == 0 else float(f"{x:.9g}")
    return tuple(plain(y) for y in x) if isinstance(x, (list, tuple)) else x


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return [names[k] for k in order], Counter(tuple(plain(r[k]) for k in order) for r in rows)


def differences(spark, con, f, sql, sf_dir):
    """(columns equal, rows only in Spark, rows only in SQL)."""
    df = f(spark, sf_dir)
    a = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.sql(sql)
    b = rows_of(cur.columns, cur.fetchall())
    return a[0] == b[0], a[1] - b[1], b[1] - a[1], sum(a[1].values())
