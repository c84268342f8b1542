"""The step from given parameters against its SQL, on tables whose estimates lie beyond the guards of a fit."""

import math
from datetime import date

import duckdb

from tidegauge.plans.catalogue import ORACLE_SQL, QUERIES
from tidegauge.plans.fixtures import FIXED_SERIES

MONTHS = [date(y, m, 1) for y in range(1996, 2003) for m in range(1, 13)]


def differs(spark, tmp_path, value):
    rows = [(k, value(k, name), day, name) for name in FIXED_SERIES for k, day in enumerate(MONTHS)]
    spark.createDataFrame(rows, "o_orderkey long, o_totalprice double, o_orderdate date, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    con = duckdb.connect()
    con.execute(f"create view orders as select * from read_parquet('{tmp_path}/orders.parquet/*.parquet')")
    want = {(name, i): v for name, i, v in con.sql(ORACLE_SQL["fixed_em_step"]).fetchall()}
    got = {(r["name"], r["i"]): r["value"] for r in QUERIES["fixed_em_step"](spark, str(tmp_path)).collect()}
    assert got.keys() == want.keys()
    return want, [k for k in want if not math.isclose(got[k], want[k], abs_tol=1.5e-5)]


def test_transition_is_not_clipped(spark, tmp_path):
    want, wrong = differs(spark, tmp_path, lambda k, name: 1000 * 1.06**k)
    assert want["a", 0] > 0.99 and not wrong


def test_series_without_variance_has_no_noise(spark, tmp_path):
    want, wrong = differs(spark, tmp_path, lambda k, name: 1000.0 if name == "3-MEDIUM" else 1000 + 300 * math.sin(k))
    assert want["r", 2] == 0 and not wrong
