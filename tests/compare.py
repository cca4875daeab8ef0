"""Runs registered queries next to their SQL and compares the rows."""

import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def _plain(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return None if math.isnan(v) else v + 0.0
    if isinstance(v, int):
        return v
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return v


def rows_of(names, tuples):
    order = sorted(range(len(names)), key=lambda i: names[i])
    key = lambda row: [(v is None, str(type(v)), str(v)) for v in row]
    return sorted((tuple(_plain(t[i]) for i in order) for t in tuples), key=key)


def difference(df, con, sql):
    """None when equal, else a short description."""
    cur = con.execute(sql)
    want_names = [d[0] for d in cur.description]
    want = rows_of(want_names, cur.fetchall())
    have = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sorted(df.columns) != sorted(want_names):
        return f"columns {sorted(df.columns)} != {sorted(want_names)}"
    bad = [(h, w) for h, w in zip(have, want) if h != w]
    if len(have) != len(want) or bad:
        only_have = list(set(have) - set(want))[:3]
        only_want = list(set(want) - set(have))[:3]
        return f"rows {len(have)} != {len(want)} or values differ in {len(bad)}: {sorted(df.columns)} spark {only_have} sql {only_want}"
    kinds = lambda rows: [{type(v) for v in c if v is not None} for c in zip(*rows)]
    if have and kinds(have) != kinds(want):
        return f"types {kinds(have)} != {kinds(want)}"
    return None
