"""Runs a query and its SQL over the same tables."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def both(spark, sf, query, sql):
    df = query(spark, sf)
    names = sorted(df.columns)
    got = sorted((tuple(r[n] for n in names) for r in df.collect()), key=str)
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    result = db.execute(sql)
    columns = [c[0] for c in result.description]
    assert sorted(columns) == names
    order = [columns.index(n) for n in names]
    return got, sorted((tuple(r[i] for i in order) for r in result.fetchall()), key=str)
