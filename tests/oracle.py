"""Compares a query's rows with those of its SQL, order aside."""

import glob
import math
import os

import duckdb


def connect(sf_dir):
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(p)[: -len(".parquet")]
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{p if os.path.isfile(p) else p + '/*.parquet'}'")
    return c


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, bool):
        return v
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, (int, float)) and not isinstance(v, bool):
        return round(float(v), 6)
    return str(v)


def same(df, con, sql):
    """The first difference, or None."""
    got = df.collect()
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = cur.fetchall()
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    cols = sorted(names)
    key = lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r)
    a = sorted((tuple(plain(r[c]) for c in cols) for r in got), key=key)
    b = sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in want), key=key)
    if len(a) != len(b):
        return f"{len(a)} and {len(b)} rows; only here {list(set(a) - set(b))[:3]}, only there {list(set(b) - set(a))[:3]}"
    return next((f"{cols}: {x} and {y}" for x, y in zip(a, b, strict=True) if x != y), None)
