"""Runs a query and its SQL over the smallest tables and compares the rows."""

import math
from collections import Counter
from pathlib import Path

import duckdb

from tests.conftest import DATA


def value(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5)
    return v


def compare(spark, query, sql):
    con = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    df = query(spark, DATA)
    columns = sorted(df.columns)
    got = Counter(tuple(value(r[c]) for c in columns) for r in df.collect())
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    assert sorted(names) == columns
    assert got == Counter(tuple(value(r[names.index(c)]) for c in columns) for r in cur.fetchall())
