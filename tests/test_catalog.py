"""Every catalogue query with SQL gives the rows that DuckDB gives."""

import os

import duckdb
import pytest

from maskwright.functions.registry import CATEGORIES
from maskwright.plans.catalog import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(n for n in SQL if n.removeprefix("detect_") not in CATEGORIES))
def test_query(spark, db, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    result = db.execute(SQL[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == cols
    want = sorted((tuple(row[names.index(c)] for c in cols) for row in result.fetchall()), key=repr)
    assert sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr) == want
