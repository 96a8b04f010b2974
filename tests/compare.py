"""Runs a query's DuckDB equivalent on the same tables and compares rows, in any order."""

import datetime
import glob
import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def database(folder, tables=TABLES):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in tables:
        files = glob.glob(f"{folder}/{t}.parquet/*.parquet") or [f"{folder}/{t}.parquet"]
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet({files})")
    return con


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else 0.0 if v == 0 else float(f"{v:.9g}")
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return v
    return float(v) if not isinstance(v, (list, tuple)) else tuple(map(_plain, v))


def same(df, con, sql):
    """None, or what differs."""
    want = con.execute(sql)
    names = [c[0] for c in want.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    order = [names.index(c) for c in sorted(names)]
    key = lambda r: tuple((x is None, str(x)) for x in r)
    b = sorted((tuple(_plain(r[i]) for i in order) for r in want.fetchall()), key=key)
    a = sorted((tuple(_plain(r[c]) for c in sorted(names)) for r in df.collect()), key=key)
    if a == b:
        return None
    odd = [(x, y) for x, y in zip(a, b) if x != y][:3]
    return f"{len(a)} and {len(b)} rows; {odd}"
