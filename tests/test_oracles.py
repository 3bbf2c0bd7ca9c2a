"""Every query against its SQL on the smallest tables, values and column names alike."""

import datetime
import math
import os
from pathlib import Path

import duckdb
import pytest

from vertexloom.plans.queries import QUERIES, SQL

DATA = os.environ.get("ORACLE_DIR", "/root/testdata/sf0.001")


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_plain(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    got = rows_of(df.columns, df.collect())
    if name in SQL:
        found = duck.execute(SQL[name])
        assert got == rows_of([d[0] for d in found.description], found.fetchall())
    else:
        assert got[1]
