"""The spline of array folds against the dense one."""

import numpy as np
import pytest

from tidegauge.operators import missing as X
from tidegauge.plans import linalg

SCHEMA = "period date, series_id string, t int, value double"


def series():
    rng = np.random.default_rng(7)
    out = {}
    for k, n in enumerate((1, 2, 3, 4, 5, 9, 40, 120)):
        x = rng.normal(size=n).cumsum()
        x[rng.random(n) < 0.4] = np.nan
        out[f"s{k}"] = x
    for k in range(6):  # so many observations, and gaps at both ends
        x = np.full(30, np.nan)
        x[np.sort(rng.choice(np.arange(3, 26), k, replace=False))] = rng.normal(size=k)
        out[f"o{k}"] = x
    return out


@pytest.mark.parametrize("mode", ["spline", "smooth", "median"])
def test_every_mode(spark, mode):
    data = series()
    rows = [(None, s, t, None if np.isnan(v) else float(v)) for s, x in data.items() for t, v in enumerate(x)]
    got = {(r["series_id"], r["t"]): r["value"] for r in X.fill_spline(spark.createDataFrame(rows, SCHEMA).repartition(3), mode, 2).collect()}
    assert len(got) == len(rows)
    for s, x in data.items():
        want = linalg.spline_fill(x, mode, 2)
        for t, v in enumerate(want):
            assert got[s, t] is None if np.isnan(v) else np.isclose(got[s, t], v, rtol=1e-8, atol=1e-8)


def test_unknown_mode_and_no_rows(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert X.fill_spline(none).count() == 0
    with pytest.raises(ValueError):
        X.fill_spline(none, "other")
