"""Collapsed filter, maximisation and weights of wide panels against the kernel's own, which knows all series."""

import numpy as np
import pandas as pd
import pytest

from tidegauge.operators import wide as W
from tidegauge.plans import kernel as K
from tidegauge.plans.kernel import Layout, Params

PANEL, LOADINGS = "model string, t int, series_id string, z double", "model string, series_id string, c array<double>, r double"


def system(m, n, t, seed, missing=0.3):
    rng = np.random.default_rng(seed)
    a = rng.normal(size=(m, m))
    a *= 0.8 / np.abs(np.linalg.eigvals(a)).max()
    root = rng.normal(size=(m, m))
    p = Params(a, rng.normal(size=(n, m)), 0.2 * np.eye(m) + 0.05 * root @ root.T, np.diag(rng.uniform(0.2, 2.0, n)), rng.normal(size=m), np.eye(m))
    y = rng.normal(size=(t, n))
    y[rng.random((t, n)) < missing] = np.nan
    y[t // 2] = np.nan
    return y, p


def tables(spark, models):
    cells, loads, trans = [], [], []
    for name, (y, p) in models.items():
        cells += [(name, t, f"s{i:05d}", None if np.isnan(v) else float(v)) for t, row in enumerate(y) for i, v in enumerate(row)]
        loads += [(name, f"s{i:05d}", c.tolist(), float(p.r[i, i])) for i, c in enumerate(p.c)]
        trans.append((name, p.a.tolist(), p.q.tolist(), p.z0.tolist(), p.v0.tolist()))
    frame = lambda rows, schema: spark.createDataFrame(rows, schema).repartition(4)
    return frame(cells, PANEL), frame(loads, LOADINGS), frame(trans, W.TRANSITION)


def check_states(got, models):
    for name, (y, p) in models.items():
        f = K.kalman_filter(y, p)
        s = K.smooth(f, p.a)
        rows = sorted((r for r in got if r["model"] == name), key=lambda r: r["t"])
        assert [r["t"] for r in rows] == list(range(-1, len(y)))
        assert [r["n_observed"] for r in rows] == [0, *np.isfinite(y).sum(1)]
        for k, r in enumerate(rows):
            for column, want in (("z_filtered", f.zu), ("v_filtered", f.vu), ("z", s.z), ("v", s.v)):
                assert np.allclose(r[column], want[k].ravel(), rtol=1e-8, atol=1e-8)
            assert np.isclose(r["loglik"], f.loglik, rtol=1e-8)


def test_equals_the_filter_that_sees_every_series(spark):
    models = {f"m{k}": system(3, 6 + k, 15 + k, k) for k in range(12)}
    check_states(W.states(*tables(spark, models), 3).collect(), models)
    got = {r["model"]: r["loglik"] for r in W.log_likelihoods(*tables(spark, models), 3).collect()}
    assert all(np.isclose(got[k], K.kalman_filter(*v).loglik) for k, v in models.items())


def test_ten_thousand_series(spark):
    rng = np.random.default_rng(1)
    y, p = system(2, 10_000, 12, 3)
    cells = pd.DataFrame({"model": "m", "t": np.repeat(np.arange(12), 10_000), "series_id": np.tile([f"s{i:05d}" for i in range(10_000)], 12), "z": y.ravel()})
    _, loadings, transitions = tables(spark, {"m": (y, p)})
    panel = spark.createDataFrame(cells, PANEL).replace(float("nan"), None)
    rows = sorted(W.states(panel, loadings, transitions, 2).collect(), key=lambda r: r["t"])
    # one series at a time: a filter without any matrix of the size of the panel
    z, v, loglik = p.z0, p.v0, 0.0
    for t in range(12):
        z, v = p.a @ z, p.a @ v @ p.a.T + p.q
        for i in np.flatnonzero(np.isfinite(y[t])):
            c = p.c[i]
            f = c @ v @ c + p.r[i, i]
            miss = y[t, i] - c @ z
            loglik += -0.5 * (np.log(f) + miss * miss / f)
            z, v = z + v @ c * (miss / f), v - np.outer(v @ c, v @ c) / f
        assert np.allclose(rows[t + 1]["z_filtered"], z, atol=1e-6) and np.allclose(rows[t + 1]["v_filtered"], v.ravel(), atol=1e-8)
    assert np.isclose(rows[0]["loglik"], loglik, rtol=1e-7)
    weights = W.news_weights(panel, loadings, transitions, 2, "s00007", 5)
    assert weights.count() == np.isfinite(y).sum()
    i = int(rng.integers(10_000))
    assert weights.where(f"series_id = 's{i:05d}'").count() == np.isfinite(y[:, i]).sum()


def test_maximisation_is_the_kernels(spark):
    layout = Layout(("m",) * 6, ((1,),) * 6, (2,), idio=False)
    models = {}
    for k in range(3):
        y, p = system(2, 6, 40, 20 + k)
        p.z0[:] = 0
        models[f"m{k}"] = (y, p)
    loads, trans, loglik = W.em_step(*tables(spark, models), 2, 2)
    loads, trans, loglik = loads.collect(), {r["model"]: r for r in trans.collect()}, {r["model"]: r["loglik"] for r in loglik.collect()}
    for name, (y, p) in models.items():
        want, before = K.em_step(y, p, layout, K.Options(ar_clip=None))
        assert np.isclose(loglik[name], before)
        assert np.allclose(trans[name]["a"], want.a, atol=1e-7) and np.allclose(trans[name]["q"], want.q, atol=1e-7)
        assert np.allclose(trans[name]["z0"], want.z0, atol=1e-7) and np.allclose(trans[name]["v0"], want.v0, atol=1e-7)
        for r in loads:
            if r["model"] == name:
                i = int(r["series_id"][1:])
                assert np.allclose(r["c"], want.c[i], atol=1e-6) and np.isclose(r["r"], want.r[i, i], atol=1e-6)


def test_likelihood_rises_until_it_settles(spark):
    models = {}
    for k in range(2):
        y, p = system(1, 8, 40, 40 + k, 0.1)
        models[f"m{k}"] = (y, p)
    _, _, path = W.fit(*tables(spark, models), 1, 1, max_iter=6, threshold=1e-3)
    for name in models:
        steps = [r["loglik"] for r in path.where(f"model = '{name}'").orderBy("step").collect()]
        assert len(steps) > 1 and all(b >= a - 1e-6 for a, b in zip(steps, steps[1:], strict=False))


def test_weights_are_derivatives(spark):
    models = {"x": system(2, 4, 9, 5), "y": system(2, 4, 9, 6)}
    got = W.news_weights(*tables(spark, models), 2, "s00001", 4).collect()
    for name, (y, p) in models.items():
        base = p.c[1] @ K.run(y, p).z[5]
        rows = [r for r in got if r["model"] == name]
        assert len(rows) == np.isfinite(y).sum()
        for r in rows:
            moved = y.copy()
            moved[r["t"], int(r["series_id"][1:])] += 1.0
            assert np.isclose(p.c[1] @ K.run(moved, p).z[5] - base, r["weight"], atol=1e-6)


def test_series_without_data_or_loadings(spark):
    y, p = system(2, 5, 10, 9)
    y[:, 3] = np.nan
    panel, loadings, transitions = tables(spark, {"m": (y, p)})
    without = loadings.where("series_id <> 's00004'")
    y4 = y.copy()
    y4[:, 4] = np.nan
    check_states(W.states(panel, without, transitions, 2).collect(), {"m": (y4, p)})
    new, _, _ = W.em_step(panel, loadings, transitions, 2, 2)
    kept = new.where("series_id = 's00003'").first()
    assert np.allclose(kept["c"], p.c[3]) and np.isclose(kept["r"], p.r[3, 3])
    with pytest.raises(Exception, match="no transition"):
        W.states(panel, loadings, transitions.where("model = 'other'"), 2).collect()
    assert W.states(panel.where("t < 0"), loadings, transitions.where("model = 'other'"), 2).count() == 0
