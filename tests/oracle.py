"""Run queries beside their SQL and compare rows."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def compare(df, con, sql):
    """None if equal, else what differs."""
    want = con.sql(sql)
    cols = sorted(df.columns)
    if cols != sorted(want.columns):
        return f"columns {cols} and {sorted(want.columns)}"
    mine = sorted(map(repr, (tuple(r[c] for c in cols) for r in df.collect())))
    at = [want.columns.index(c) for c in cols]
    theirs = sorted(map(repr, (tuple(r[k] for k in at) for r in want.fetchall())))
    if mine == theirs:
        return None
    a, b = set(mine), set(theirs)
    return f"{len(mine)} and {len(theirs)} rows; only here {sorted(a - b)[:3]}; only there {sorted(b - a)[:3]}"
