"""Every query with SQL against DuckDB on the smallest tables; the others must run."""

import datetime
import math
import os
from pathlib import Path

import duckdb
import pytest

from newsloom import queries

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in Path(SMALL).glob("*.parquet"):
        files = f"{path}/*.parquet" if os.path.isdir(path) else path
        con.execute(f"create view {path.stem} as select * from read_parquet('{files}')")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9) + 0.0)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(plain, v)) + "]"
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return repr(v)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted("|".join(plain(r[k]) for k in order) for r in rows)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, duck, name):
    df = queries.QUERIES[name](spark, SMALL)
    got = [tuple(r) for r in df.collect()]
    if name in queries.ORACLE_SQL:
        result = duck.execute(queries.ORACLE_SQL[name])
        names = [c[0] for c in result.description]
        assert sorted(df.columns) == sorted(names)
        assert rows_of(df.columns, got) == rows_of(names, result.fetchall())
