"""Calendar, frequency and transform functions: exact cases."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegauge.functions import dates as D
from tidegauge.functions import frequency as Q
from tidegauge.operators import evaluation as E
from tidegauge.operators import missing as X
from tidegauge.operators import moments as M
from tidegauge.operators import panel as P
from tidegauge.operators import scalar as S
from tidegauge.operators import vintage as V
from tidegauge.plans import kernel as K

RELEASES = [
    (25, "2024-03-01", "2024-03-25"),
    (-5, "2024-03-01", "2024-02-25"),
    (-1, "2024-03-01", "2024-02-29"),
    (-5, "2024-01-01", "2023-12-27"),
    (-5, "2023-03-01", "2023-02-24"),
    (85, "2024-02-01", "2024-02-29"),
    (-35, "2024-03-01", "2024-02-01"),
    (None, "2024-03-01", "2024-03-01"),
    (0, "2024-03-01", None),
]


def test_release_dates(spark):
    df = spark.createDataFrame(RELEASES, "d int, p string, want string")
    got = df.select(D.release_date("d", F.col("p").cast("date")).cast("string").alias("x"), "want").collect()
    assert [r["x"] for r in got] == [r["want"] for r in got]


def test_period_names(spark):
    cases = [("2024m3", "m", "2024-03-01"), ("2024Q1", "q", "2024-03-01"), ("2024q4", "q", "2024-12-01"), ("2024s2", "sa", "2024-07-01"), ("2024", "a", "2024-01-01"),
             ("2024-03-15", "d", "2024-03-15"), ("2024m03d15", "w", "2024-03-15"), ("2024m13", "m", None), ("x", "q", None), ("", "a", None), ("2024m2d31", "d", None)]
    for text, f, want in cases:
        got = spark.createDataFrame([(text,)], "t string").select(D.parse_period("t", f).cast("string").alias("x")).first()["x"]
        assert got == want, (text, f, got)


def test_timestamps(spark):
    cases = ["2024-03-15", "2024-03-15 10:00:00", "2024/03/15", "03/15/2024", "15-03-2024", "1710460800", "no"]
    df = spark.createDataFrame([(c,) for c in cases], "t string")
    got = [r["d"] for r in df.select(D.parse_timestamp("t").cast("date").alias("d")).collect()]
    assert got == [dt.date(2024, 3, 15)] * 6 + [None]


def test_tents():
    assert Q.tent(5) == [1, 2, 3, 2, 1] and Q.tent(4) == [1, 2, 2, 1] and Q.tent(3, "linear") == [1, 1, 1]
    assert Q.tent_for("q", "m") == (1, 2, 3, 2, 1) and len(Q.tent_for("w", "d")) == 2
    r, q = Q.constraint_matrix((1, 2, 3))
    assert r.tolist() == [[1, -2, 0], [1, 0, -3]] and not q.any()
    assert Q.chain_length("q", "m") == 5 and Q.chain_length("m", "m") == 1 and Q.chain_length("q", "m", idio_slow=False) == 0
    assert Q.higher("d") is None and Q.higher("q") == "m" and Q.annual_factor("q") == pytest.approx(4 / 3)
    assert len(Q.tent(6, "exponential")) == 6
    with pytest.raises(ValueError):
        Q.aggregation(["d", "q"], "m")
    with pytest.raises(ValueError):
        Q.tent(5, "round")


def small(spark, values, series="a"):
    rows = [(dt.date(2020 + k // 12, k % 12 + 1, 1), series, v) for k, v in enumerate(values)]
    return spark.createDataFrame(rows, "period date, series_id string, value double")


def test_empty_and_bad_values(spark):
    empty = small(spark, [])
    assert P.complete(empty).count() == 0 and M.standardise(P.complete(empty)).count() == 0
    df = spark.createDataFrame([(float("nan"),), (float("inf"),), (1.0,), (None,)], "v double")
    assert [r["x"] for r in df.select(P.finite("v").alias("x")).collect()] == [None, None, 1.0, None]
    flat = P.complete(small(spark, [2.0, 2.0, None, 2.0]))
    assert {r["z"] for r in M.standardise(flat).collect()} == {0.0, None}


def test_views_mask_and_keep_rows(spark):
    panel = P.complete(small(spark, [1.0, 2.0])).withColumn("release_day", F.lit(15))
    got = {r["t"]: r["value"] for r in V.view(panel, "2020-02-10").collect()}
    assert got == {0: 1.0, 1: None}
    both = V.availability(V.views(panel, ["2020-01-10", "2020-02-20"])).orderBy("view_date").collect()
    assert [(r["n_available"], r["n_missing"]) for r in both] == [(0, 2), (2, 0)]


def test_faster_series_are_an_error(spark):
    spec = spark.createDataFrame([("a", "w")], "series_id string, frequency string")
    with pytest.raises(ValueError, match="faster"):
        P.reject_faster(spec, "m")
    assert P.slower_count(spec, "d").first()["n_slower"] == 1


def test_fills(spark):
    panel = P.complete(small(spark, [None, 1.0, None, 3.0, 4.0, None]))
    spline = [r["value"] for r in X.fill_spline(panel).orderBy("t").collect()]
    assert np.allclose(spline[1:5], [1, 2, 3, 4]) and all(v is not None for v in spline)
    assert [r["value"] for r in X.fill_median(panel).orderBy("t").collect()] == [3.0, 1.0, 3.0, 3.0, 4.0, 3.0]
    nothing = P.complete(small(spark, [None, None]))
    assert {r["value"] for r in X.treat(nothing, 5).collect()} == {None}
    assert X.trim(panel).count() == 4


def test_unpivot_and_pivot_round_trip(spark):
    panel = small(spark, [1.0, 2.0]).unionByName(small(spark, [3.0, None], "b"))
    back = P.unpivot(P.pivot(panel, ["a", "b"]))
    assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, panel.collect()), key=str)


def test_rotation_of_several_factors(spark):
    rng = np.random.default_rng(5)
    true = rng.normal(size=(30, 3))
    turn = np.linalg.qr(rng.normal(size=(3, 3)))[0]
    seen = true @ turn
    rows = spark.createDataFrame([(t, k, float(true[t, k]), float(seen[t, k])) for t in range(30) for k in range(3)], "t int, k int, true double, estimate double")
    got = E.recovery(E.rotated(rows, "t"), "k").collect()
    assert len(got) == 4 and all(abs(r["correlation"] - 1) < 1e-9 and r["rmse"] < 1e-9 for r in got)


def test_long_series_of_one_state(spark):
    y = np.random.default_rng(3).normal(size=1000)
    rows = spark.createDataFrame([("a", t, float(y[t]) if t % 7 else None) for t in range(1000)] + [("b", 0, 1.0), ("c", 0, None), ("c", 1, 2.0)], "series_id string, t int, z double")
    arrays = S.as_arrays(rows)
    z, v = {}, {}
    for name, ys in (("a", [None if t % 7 == 0 else y[t] for t in range(1000)]), ("b", [1.0]), ("c", [None, 2.0])):
        p = K.Params(np.array([[S.A]]), np.ones((1, 1)), np.array([[S.Q]]), np.array([[S.R]]), np.array([S.Z0]), np.array([[S.V0]]))
        f = K.kalman_filter(np.array([[np.nan if x is None else x] for x in ys]), p)
        s = K.smooth(f, p.a)
        z |= {(name, t): (f.zu[t + 1, 0], s.z[t + 1, 0]) for t in range(len(ys))}
        v |= {(name, t): s.v[t + 1, 0, 0] for t in range(len(ys))}
    filtered = {(r["series_id"], r["t"]): r["z"] for r in S.filtered(arrays).collect()}
    smoothed = {(r["series_id"], r["t"]): (r["z"], r["v"]) for r in S.smoothed(arrays).collect()}
    assert filtered.keys() == smoothed.keys() == z.keys()
    for k in z:
        assert abs(filtered[k] - z[k][0]) < 1e-9 and abs(smoothed[k][0] - z[k][1]) < 1e-6 and abs(smoothed[k][1] - v[k]) < 1e-6
