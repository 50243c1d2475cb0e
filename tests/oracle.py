"""Runs a query and its SQL on the same tables and compares rows as multisets."""

import os
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    c = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def cell(x):
    return round(x, 9) if isinstance(x, float) else x


def rows_of(names, rows):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(names), Counter(tuple(cell(r[k]) for k in order) for r in rows)


def same(spark, query, sql, sf_dir):
    got = query(spark, sf_dir)
    want = connect(sf_dir).sql(sql)
    assert rows_of(got.columns, map(tuple, got.collect())) == rows_of(want.columns, want.fetchall())
