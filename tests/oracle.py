"""Compare a query with its SQL, rows in any order, columns by name."""

import datetime
import decimal
import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    return con


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 6) + 0.0
    if isinstance(x, decimal.Decimal):
        return round(float(x), 6)
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None)
    return [plain(y) for y in x] if isinstance(x, list) else x


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(df, con, sql):
    out = con.execute(sql)
    expected = rows_of([d[0] for d in out.description], out.fetchall())
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    assert got[0] == expected[0], (got[0], expected[0])
    assert len(got[1]) == len(expected[1]), (len(got[1]), len(expected[1]), got[1][:3], expected[1][:3])
    different = [(a, b) for a, b in zip(got[1], expected[1], strict=True) if a != b]
    assert not different, (len(different), different[:3])
    return len(got[1])
