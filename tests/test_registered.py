"""Every registered query against its SQL on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from askmill.plans.oracle import ORACLE
from askmill.plans.registered import QUERIES as OWN
from conftest import SF

QUERIES = {name: query for name, query in entry.queries().items() if name in OWN}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def rows(table):
    def plain(value):
        if isinstance(value, float):
            return None if math.isnan(value) else round(value, 9)
        return value

    names = sorted(table.column_names)
    found = [tuple(plain(v) for v in r.values()) for r in table.select(names).to_pylist()]
    return names, sorted(found, key=lambda r: [(v is None, str(v)) for v in r])


def test_each_query_has_its_check():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", QUERIES)
def test_query_equals_sql(spark, duck, name):
    assert rows(QUERIES[name](spark, SF).toArrow()) == rows(duck.sql(ORACLE[name]).to_arrow_table())


def test_entry(spark):
    assert entry.entry(spark).count() == 160
