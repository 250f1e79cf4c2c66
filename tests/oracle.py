"""Compares a query with its SQL."""

import math

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    import duckdb

    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def _plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v + 0.0
    return v


def assert_same(df, connection, sql):
    cols = sorted(df.columns)
    got = sorted((tuple(map(_plain, r)) for r in df.select(*cols).collect()), key=str)
    result = connection.execute(sql)
    names = [d[0] for d in result.description]
    assert sorted(names) == cols
    want = sorted((tuple(_plain(r[names.index(c)]) for c in cols) for r in result.fetchall()), key=str)
    assert got == want
