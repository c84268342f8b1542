"""Every catalogue query with SQL, against DuckDB on the same tables."""

import math
import os

import duckdb
import pytest

from tidegauge.plans.catalogue import ORACLE_SQL, QUERIES, flagship

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f[:-8]} as select * from read_parquet('{SF}/{f}')")
    return con


def same(x, y):
    if x is None or y is None:
        return x is y
    if isinstance(x, float) or isinstance(y, float):
        return math.isclose(float(x), float(y), rel_tol=1e-7, abs_tol=2e-6)
    return x == y


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, oracle, name):
    got = QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    rel = oracle.sql(ORACLE_SQL[name])
    assert sorted(rel.columns) == columns
    key = lambda row: tuple((v is None, round(v, 3) if isinstance(v, float) else v) for v in row)
    text_first = sorted(columns, key=lambda c: (dict(got.dtypes)[c] == "double", c))
    a = sorted((tuple(r[c] for c in text_first) for r in got.collect()), key=key)
    b = sorted((tuple(row[rel.columns.index(c)] for c in text_first) for row in rel.fetchall()), key=key)
    assert len(a) == len(b) > 0 or name in ("vintage_new_cells", "cov_listwise")
    for x, y in zip(a, b, strict=True):
        assert all(map(same, x, y)), (x, y)


def test_flagship_and_models(spark):
    assert flagship(spark, SF).count() > 70
    for name in sorted(set(QUERIES) - set(ORACLE_SQL)):
        rows = QUERIES[name](spark, SF).collect()
        assert rows, name


def test_news_sum_to_the_change(spark):
    rows = QUERIES["dfm_news"](spark, SF).toPandas()
    for _, part in rows.groupby("view_date"):
        assert math.isclose(part["news"].sum(), part["y_new"].iloc[0] - part["y_old"].iloc[0], abs_tol=0.05 + 1e-6 * abs(part["y_new"].iloc[0]))
