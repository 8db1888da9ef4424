"""Compares a query with its SQL in DuckDB."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return c


def value(v):
    return round(v, 6) if isinstance(v, float) else v


def rows_of(records, columns):
    return sorted(repr(tuple(value(r[c]) for c in columns)) for r in records)


def check(spark, folder, f, sql):
    df = f(spark, folder)
    columns = sorted(df.columns)
    result = connect(folder).execute(sql)
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    expected = [dict(zip(names, r, strict=True)) for r in result.fetchall()]
    assert rows_of((r.asDict() for r in df.collect()), columns) == rows_of(expected, columns)
