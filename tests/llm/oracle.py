"""Compares a registered query with its SQL on a data directory."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def compare(df, sql, sf_dir):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    want = con.execute(sql).df()
    got = df.toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)
    a = sorted(map(repr, got[cols].astype(object).where(got[cols].notna(), None).itertuples(index=False, name=None)))
    b = sorted(map(repr, want[cols].astype(object).where(want[cols].notna(), None).itertuples(index=False, name=None)))
    assert len(a) == len(b)
    diff = [(x, y) for x, y in zip(a, b) if x != y]
    assert not diff, diff[:3]
