"""Runs a registered query and its SQL side by side."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows_of(df):
    cols = sorted(df.columns)
    return cols, sorted(repr(tuple(r[c] for c in cols)) for r in df.collect())


def compare(df, sql, sf_dir):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = cur.fetchall()
    cols, got = rows_of(df)
    assert cols == sorted(names)
    at = [names.index(c) for c in cols]
    other = sorted(repr(tuple(r[i] for i in at)) for r in want)
    assert len(got) == len(other)
    assert got == other, [(a, b) for a, b in zip(got, other, strict=True) if a != b][:3]
