"""Every registered query of the library's own operators against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

from latticeflow.plans import catalogue

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for name in os.listdir(SMALL):
        con.execute(f"create view {name.split('.')[0]} as select * from '{SMALL}/{name}'")
    return con


def normal(rows):
    def one(v):
        return "~" if v is None or v != v else repr(round(v, 6)) if isinstance(v, float) else str(v)

    return sorted(tuple(map(one, r)) for r in rows)


def test_all_have_sql():
    assert catalogue.oracle_sql().keys() == catalogue.queries().keys()


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_equals_sql(spark, tables, name):
    got = catalogue.queries()[name](spark, SMALL)
    want = tables.execute(catalogue.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert normal(tuple(r) for r in got.select(*[f"`{c}`" for c in columns]).collect()) == normal(want.fetchall())
