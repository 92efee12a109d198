"""Every registered query runs, and agrees with its oracle where it has one."""

from __future__ import annotations

import glob
import os

import duckdb
import pytest

import __spark_entry__
from glossmill.jobs.registry import QUERIES, SQL

DATA = "/root/testdata/sf0.001"


def rows(found, columns):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(repr([round(r[k], 6) if isinstance(r[k], float) else r[k] for k in order]) for r in found), sorted(columns)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = __spark_entry__.queries()[name](spark, DATA)
    got = rows([tuple(r) for r in df.collect()], df.columns)
    if name in SQL:
        expected = duck.sql(SQL[name])
        assert got == rows(expected.fetchall(), expected.columns)
    else:
        assert got[0]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
