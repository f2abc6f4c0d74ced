"""Compare a query with its SQL, as the driver does: by column name, without order."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    return v


def assert_same(df, con, sql):
    names = sorted(df.columns)
    mine = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr)
    made = con.sql(sql)
    columns = list(made.columns)
    theirs = sorted((tuple(plain(r[columns.index(c)]) for c in names) for r in made.fetchall()), key=repr)
    assert sorted(columns) == names
    assert mine == theirs
    assert mine
