"""Every registered query that SQL can express against DuckDB over the same tables; test_numeric.py has the others."""

import math
import os

import duckdb
import pytest

from heddle import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SF}/{name}')")
    return con


def cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.5g}"
    return str([cell(x) for x in v]) if isinstance(v, list | tuple) else str(v)


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(cell(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_equals_sql(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF)
    want = duck.execute(catalog.ORACLE_SQL[name])
    assert table(got.columns, got.collect()) == table([d[0] for d in want.description], want.fetchall())


def test_the_others_are_named_where_they_are_held_against_numpy():
    here = os.path.dirname(__file__)
    text = "".join(open(os.path.join(here, n)).read() for n in os.listdir(here) if n.endswith(".py"))
    assert not [n for n in set(catalog.QUERIES) - set(catalog.ORACLE_SQL) if n not in text]
