import glob
import os

import duckdb
import pytest

from tabprep.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", QUERIES)
def test_same_as_sql(spark, tables, name):
    mine, theirs = QUERIES[name](spark, SF), tables.sql(ORACLE_SQL[name])
    columns = sorted(mine.columns)
    assert columns == sorted(theirs.columns)
    rows = sorted(map(repr, map(tuple, mine.select(*[f"`{c}`" for c in columns]).collect())))
    listed = ", ".join(f'"{c}"' for c in columns)
    assert rows == sorted(map(repr, theirs.project(listed).fetchall()))


def test_entry(spark):
    import __spark_entry__ as contract

    assert contract.entry(spark).count() > 0
    assert set(contract.oracle_sql()) <= set(contract.queries())
