"""The queries with SQL give what DuckDB gives."""

from __future__ import annotations

import duckdb
import pytest

from seqweave.llm import queries

SF = "/root/testdata/sf0.001"


def plain(v):
    return "null" if v is None else repr(round(v, 6)) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query(spark, name):
    c = duckdb.connect()
    for t in ("documents", "pages"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df, want = queries.QUERIES[name](spark, SF), c.sql(queries.SQL[name])
    names = sorted(want.columns)
    assert names == sorted(df.columns)
    order = [want.columns.index(n) for n in names]
    assert sorted(tuple(plain(r[n]) for n in names) for r in df.collect()) == sorted(tuple(plain(r[k]) for k in order) for r in want.fetchall())
