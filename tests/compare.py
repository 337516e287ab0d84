"""Compare a query with its SQL counterpart in DuckDB."""

from __future__ import annotations

import os
from collections import Counter


def _plain(v):
    return round(v, 9) if isinstance(v, float) else v


def duck(folder: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for f in sorted(os.listdir(folder)):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{folder}/{f}'")
    return con


def assert_same(df, con, sql: str) -> None:
    found = con.execute(sql)
    names = [c[0] for c in found.description]
    assert sorted(df.columns) == sorted(names)
    order = sorted(names)
    ours = Counter(tuple(_plain(r[c]) for c in order) for r in df.collect())
    theirs = Counter(tuple(_plain(r[names.index(c)]) for c in order) for r in found.fetchall())
    assert ours == theirs, (list((ours - theirs).items())[:3], list((theirs - ours).items())[:3])
