"""Every corpus query with SQL, against DuckDB on the same tables."""

import os

import duckdb
import pytest

from tidegauge.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f[:-8]} as select * from read_parquet('{SF}/{f}')")
    got = QUERIES[name](spark, SF)
    rel = con.sql(ORACLE_SQL[name])
    assert sorted(rel.columns) == sorted(got.columns)
    rows = [tuple(r[c] for c in rel.columns) for r in got.collect()]
    assert sorted(map(repr, rows)) == sorted(map(repr, rel.fetchall())) and rows
