"""Every query with a stated result, against DuckDB on the smallest tables."""

import datetime
import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

SQL = entry.oracle_sql()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


@pytest.fixture(scope="session")
def duck(sf_dir):
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_gives_what_the_sql_states(spark, duck, sf_dir, name):
    df = entry.queries()[name](spark, sf_dir)
    result = duck.execute(SQL[name])
    columns = [c[0] for c in result.description]
    assert sorted(df.columns) == sorted(columns)
    want = sorted((tuple(plain(v) for v in row) for row in result.fetchall()), key=repr)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    assert len(got) == len(want)
    assert got == want
    kinds = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean", "TIMESTAMP": "timestamp_ntz", "DATE": "date", "BIGINT[]": "array<bigint>", "INTEGER[]": "array<int>", "VARCHAR[]": "array<string>"}
    types = dict(df.dtypes)
    assert [types[c] for c in columns] == [kinds[str(d[1])] for d in result.description]


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 6


def test_queries_without_sql_are_few():
    assert set(SQL) <= set(entry.queries())
    plain_only = {n for n in entry.queries() if n not in SQL and not n.startswith("op") and n != "pipeline"}
    assert plain_only == {"approximate_sketches"}
