"""Queries of the training-data operators give the rows of their SQL twins."""

from __future__ import annotations

import duckdb
import pytest

from newsgraph.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_sql(spark, sf, name):
    con = duckdb.connect()
    for table in ("documents", "pages", "benchmark"):
        con.execute(f"create view {table} as select * from '{sf}/{table}.parquet'")
    result = con.execute(queries.ORACLE[name])
    columns = [c[0] for c in result.description]
    df = queries.QUERIES[name](spark, sf)
    assert sorted(columns) == sorted(df.columns)
    assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr) == sorted(map(tuple, result.fetchall()), key=repr)
