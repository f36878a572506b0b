"""Every registered query against its SQL counterpart, on the driver's tables."""

import math
import os

import pytest

import __spark_entry__ as entry_module
from panelfx.catalog.oracle import all_oracles
from panelfx.catalog.queries import all_queries

SF_DIR = "/root/testdata/sf0.01"
TABLES = "customer orders events documents embeddings benchmark"
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"create view {t} as select * from '{SF_DIR}/{t}.parquet'")
    return con


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "NULL"
    return repr(float(value)) if isinstance(value, float) else str(value)


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0


def test_every_query_has_sql():
    assert all_queries().keys() == all_oracles().keys()
    assert all_queries().keys() <= entry_module.queries().keys()


@pytest.mark.parametrize("name", sorted(all_queries()))
def test_query(spark, con, name):
    mine = entry_module.queries()[name](spark, SF_DIR)
    theirs = con.execute(entry_module.oracle_sql()[name])
    columns = [d[0] for d in theirs.description]
    rows = theirs.fetchall()
    assert sorted(mine.columns) == sorted(columns)
    assert canonical(mine.columns, mine.collect()) == canonical(columns, rows)
