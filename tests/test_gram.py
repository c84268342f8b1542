"""Tiles of cross products and leading components against dense NumPy."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tidegauge.operators import gram
from tidegauge.operators import moments as M
from tidegauge.operators.models import principal_components
from tidegauge.plans import linalg

SCHEMA = "t int, series_id string, value double"


def frame(spark, x):
    t, n = x.shape
    cells = pd.DataFrame({"t": np.repeat(np.arange(t), n), "series_id": np.tile([f"s{i:04d}" for i in range(n)], t), "value": x.ravel()})
    return spark.createDataFrame(cells, SCHEMA).replace(float("nan"), None).repartition(4)


def noisy(t, n, seed=0, missing=0.3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(t, 2)) @ rng.normal(size=(2, n)) + 0.5 * rng.normal(size=(t, n)) + 1e6
    x[rng.random((t, n)) < missing] = np.nan
    return x


def test_tiles_are_pairwise_sums(spark):
    x = noisy(60, 23)
    x[:, 5] = np.nan
    x[:30, 6], x[30:, 7] = np.nan, np.nan
    seen = np.isfinite(x)
    got = {(r["a"], r["b"]): r for r in M.covariance_pairwise(frame(spark, x)).collect()}
    assert len(got) == 23 * 24 // 2
    for i in range(23):
        for j in range(i, 23):
            both = seen[:, i] & seen[:, j]
            c = np.mean((x[both, i] - x[both, i].mean()) * (x[both, j] - x[both, j].mean())) if both.sum() > 1 else float(i == j)
            assert np.isclose(got[f"s{i:04d}", f"s{j:04d}"]["covariance"], max(c, 1e-10) if i == j else c, atol=1e-8)


def test_any_width_gives_the_same(spark, monkeypatch):
    x = noisy(25, 17, 1)
    want = None
    for width, periods in ((256, 512), (4, 512), (5, 7), (1, 10)):
        monkeypatch.setattr(gram, "PERIODS", periods)
        rows = sorted(map(tuple, gram.products(frame(spark, x), width).select("a", "b", "n", *[F.round(c, 6) + 0.0 for c in ("sx", "sy", "sxy")]).collect()))
        want = want or rows
        assert len(rows) == 17 * 18 // 2 and all(np.allclose(a[2:], b[2:], atol=1e-5) and a[:2] == b[:2] for a, b in zip(rows, want, strict=True))


def test_pairs_that_never_meet_and_no_rows(spark):
    x = np.full((8, 2), np.nan)
    x[:4, 0], x[4:, 1] = 1.5, 2.5
    got = {(r["a"], r["b"]): (r["n"], r["sxy"]) for r in gram.products(frame(spark, x), 1).collect()}
    assert got == {("s0000", "s0000"): (4, 0.0), ("s0000", "s0001"): (0, 0.0), ("s0001", "s0001"): (4, 0.0)}
    assert gram.products(frame(spark, x).where("t < 0")).count() == 0


def test_cells_travel_once_for_each_block(spark):
    """What is multiplied grows with the number of blocks, not with the number of series."""
    x = noisy(20, 64, 2, 0.0)
    names = gram.series_blocks(frame(spark, x), 16)
    assert names.select("block").distinct().count() <= 4 and names.count() == 64
    tiles = gram.products(frame(spark, x), 16)
    plan = tiles._jdf.queryExecution().optimizedPlan().toString()
    assert "Cartesian" not in plan and tiles.count() == 64 * 65 // 2


def test_components_of_many_series(spark):
    rng = np.random.default_rng(4)
    n, t = 120, 80
    x = rng.normal(size=(t, 3)) * np.array([6.0, 4.0, 2.5]) @ np.linalg.qr(rng.normal(size=(n, 3)))[0].T + 0.2 * rng.normal(size=(t, n))
    x[7, 3] = np.nan
    full = x[np.isfinite(x).all(1)]
    values, vectors = linalg.principal_components(np.cov(full.T), 3)
    loads, found = gram.components(frame(spark, x), 3)
    assert np.allclose(found, values, rtol=1e-9)
    got = np.zeros((n, 3))
    for r in loads.collect():
        got[int(r["series_id"][1:]), r["k"]] = r["value"]
    assert np.allclose(got, vectors, atol=1e-6)


def test_components_of_few_series_and_of_none(spark):
    x = noisy(30, 5, 6, 0.05)
    loads, scores = principal_components(frame(spark, x).withColumn("period", F.lit(None).cast("date")), 2)
    full = (x - np.nanmean(x, 0)) / np.nanstd(x, 0)
    _, vectors = linalg.principal_components(np.cov(full[np.isfinite(full).all(1)].T), 2)
    assert np.allclose([r["value"] for r in loads.orderBy("series_id", "k").collect()], vectors.ravel(), atol=1e-6)
    assert scores.count() == 60
    constant = frame(spark, np.ones((5, 3)))
    loads, values = gram.components(constant, 2)
    assert np.allclose(values, 0) and loads.count() == 6
