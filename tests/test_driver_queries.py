"""Every core query with SQL gives what DuckDB gives."""

from __future__ import annotations

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from seqweave.plans import queries as core

SF = "/root/testdata/sf0.001"


def plain(v):
    if v is None or v != v:
        return "null"
    return repr(round(v, 6)) if isinstance(v, float) else str(v)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(core.SQL))
def test_query(spark, duck, name):
    df = core.QUERIES[name](spark, SF)
    want = duck.sql(core.SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(df.columns)
    order = [columns.index(c) for c in sorted(columns)]
    assert sorted(tuple(plain(r[c]) for c in sorted(columns)) for r in df.collect()) == sorted(tuple(plain(r[k]) for k in order) for r in want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
