"""Factor models of wide panels: a period's series are collapsed to what the states need of them.

With observation errors that are independent of each other, a period's observations enter the
filter only by C' R^-1 y and C' R^-1 C over the series observed, and the likelihood by three sums
more. These are aggregates over the long panel, combined before their shuffle: a row of the size of
the states each period, whatever the number of series. The recursion over time then runs on
those rows, one worker call a model, and any number of models side by side. The maximisation goes
back to the panel: the moments of the states join it by period, and each series' loadings and
variance are sums of its own.

Tables: a panel (model, t, series_id, z), z standardised and null where missing, every period of a
model present; loadings (model, series_id, c array<double>, r double), r above 0; transitions
(model, a, q, v0 array<array<double>>, z0 array<double>). All models of a call have ``m`` states, of
which the observed factors come first; a model with fewer has zeros. Series without loadings are
not observed.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans import kernel, linalg
from ..sources.scratch import written

TRANSITION = "model string, a array<array<double>>, q array<array<double>>, z0 array<double>, v0 array<array<double>>"
SUMS = ("n", "yy", "log_r")


def _upper(m: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(m) for j in range(i, m)]


def _vector(name: str, m: int) -> Column:
    return F.array(*[F.col(f"{name}{i}") for i in range(m)])


def collapse(panel: DataFrame, loadings: DataFrame, m: int) -> DataFrame:
    """model, t, n, yy, log_r, h (C' R^-1 y) and j (C' R^-1 C, its upper half row by row): a row for every period."""
    cells = panel.select("model", "t", "series_id", "z").join(loadings.select("model", "series_id", "c", "r"), ["model", "series_id"], "left")
    seen = F.col("z").isNotNull() & F.col("c").isNotNull()
    over = lambda x: F.coalesce(F.sum(F.when(seen, x)), F.lit(0.0))
    c = [F.get("c", F.lit(i)) for i in range(m)]
    sums = [F.count_if(seen).alias("n"), over(F.col("z") * F.col("z") / F.col("r")).alias("yy"), over(F.log("r")).alias("log_r")]
    sums += [over(c[i] * F.col("z") / F.col("r")).alias(f"h{i}") for i in range(m)]
    sums += [over(c[i] * c[j] / F.col("r")).alias(f"j{k}") for k, (i, j) in enumerate(_upper(m))]
    return cells.groupBy("model", "t").agg(*sums).select("model", "t", *SUMS, _vector("h", m).alias("h"), _vector("j", len(_upper(m))).alias("j"))


def collapsed_filter(h: np.ndarray, j: np.ndarray, sums: np.ndarray, p: kernel.Params) -> kernel.Filtered:
    """``kernel.kalman_filter`` on collapsed periods: ``h`` T x m, ``j`` T x m x m, ``sums`` T x (n, yy, log_r); p.c and p.r are not used."""
    n, m = len(h), len(p.a)
    zu, vu, zp, vp = np.zeros((n + 1, m)), np.zeros((n + 1, m, m)), np.zeros((n + 1, m)), np.zeros((n + 1, m, m))
    zu[0], vu[0], loglik = p.z0, p.v0, 0.0
    for t in range(1, n + 1):
        zp[t] = p.a @ zu[t - 1]
        vp[t] = linalg.symmetric(p.a @ vu[t - 1] @ p.a.T + p.q)
        count, yy, log_r = sums[t - 1]
        if not count:
            zu[t], vu[t] = zp[t], vp[t]
            continue
        inner = np.eye(m) + j[t - 1] @ vp[t]
        vu[t] = linalg.symmetric(np.linalg.solve(inner.T, vp[t]).T)
        miss = h[t - 1] - j[t - 1] @ zp[t]
        zu[t] = zp[t] + vu[t] @ miss
        squares = yy - 2 * zp[t] @ h[t - 1] + zp[t] @ j[t - 1] @ zp[t] - miss @ vu[t] @ miss
        loglik += -0.5 * (log_r + linalg.log_det(inner) + squares)
    return kernel.Filtered(zu, vu, zp, vp, loglik if np.isfinite(loglik) else float("-inf"))


def _square(values: pd.Series) -> np.ndarray:
    return np.array([[np.asarray(row, float) for row in matrix] for matrix in values])


def _runs(periods: DataFrame, transitions: DataFrame) -> DataFrame:
    """Collapsed periods and transitions of each model in one frame for its worker call."""
    start = transitions.select("model", F.lit(-1).alias("t"), F.struct("a", "q", "z0", "v0").alias("start"))
    rows = periods.select("model", "t", F.struct(*SUMS, "h", "j").alias("sums"))
    return rows.unionByName(start, allowMissingColumns=True)


def _solved(pdf: pd.DataFrame, m: int) -> tuple[np.ndarray, np.ndarray, kernel.Params, kernel.Filtered, kernel.Smoothed]:
    """Periods, counts, parameters, filter and smoother of one model's rows."""
    pdf = pdf.sort_values("t")
    first, rest = pdf.iloc[0]["start"], pdf[pdf["t"] >= 0]
    if first is None:
        raise ValueError("a model of the panel has no transition")
    a, q, v0 = (np.array([np.asarray(r, float) for r in first[k]]) for k in ("a", "q", "v0"))
    p = kernel.Params(a, np.zeros((0, m)), q, np.zeros((0, 0)), np.asarray(first["z0"], float), v0)
    h = np.array([np.asarray(s["h"], float) for s in rest["sums"]]).reshape(len(rest), m)
    j = np.zeros((len(rest), m, m))
    for k, (x, y) in enumerate(_upper(m)):
        j[:, x, y] = j[:, y, x] = [s["j"][k] for s in rest["sums"]]
    sums = np.array([[s[c] for c in SUMS] for s in rest["sums"]], float).reshape(len(rest), 3)
    f = collapsed_filter(h, j, sums, p)
    return rest["t"].to_numpy(), sums[:, 0], p, f, kernel.smooth(f, p.a)


STATES = "model string, t int, n_observed long, z_filtered array<double>, v_filtered array<double>, z array<double>, v array<double>, loglik double"


def states(panel: DataFrame, loadings: DataFrame, transitions: DataFrame, m: int) -> DataFrame:
    """Filtered and smoothed states of each model and period; matrices row by row; period -1 is the start."""

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        t, n, _, f, s = _solved(pdf, m)
        rows = zip([-1, *t.tolist()], [0, *n.astype(int).tolist()], f.zu, f.vu, s.z, s.v, strict=True)
        return pd.DataFrame([(key[0], k, c, zu, vu.ravel(), z, v.ravel(), f.loglik) for k, c, zu, vu, z, v in rows])

    return _runs(collapse(panel, loadings, m), transitions).groupBy("model").applyInPandas(one, STATES)


def log_likelihoods(panel: DataFrame, loadings: DataFrame, transitions: DataFrame, m: int) -> DataFrame:
    return states(panel, loadings, transitions, m).where("t = -1").select("model", "loglik")


MOMENTS = f"model string, t int, z array<double>, zz array<double>, {TRANSITION.partition(', ')[2]}, loglik double"


def em_step(panel: DataFrame, loadings: DataFrame, transitions: DataFrame, m: int, factors: int, least_r: float = kernel.LEAST_R) -> tuple[DataFrame, DataFrame, DataFrame]:
    """New loadings, new transitions and the log-likelihoods (model, loglik) of those that came in.

    The first ``factors`` states are the factors; their rows of the transition are free, the others
    (lags) stay. A series keeps to the states on which its loadings are not zero; one that was never
    observed keeps what it has. The worker of a model returns moments of the states only; they are
    written before they meet the panel.
    """

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        t, _, p, f, s = _solved(pdf, m)
        second = s.v + s.z[:, :, None] * s.z[:, None, :]
        now, before, cross = second[1:].sum(0), second[:-1].sum(0), s.lag[1:].sum(0) + s.z[1:].T @ s.z[:-1]
        a, q, k = p.a.copy(), p.q.copy(), slice(0, factors)
        a[k] = linalg.solve(before, cross[k].T).T
        noise = now[k, k] - a[k] @ cross[k].T - cross[k] @ a[k].T + a[k] @ before @ a[k].T
        q[k, k] = linalg.positive(noise / max(len(t), 1), kernel.LEAST_Q)
        v0 = linalg.positive(s.v[0], 1e-10)
        head = (key[0], -1, None, None, a.tolist(), q.tolist(), s.z[0].tolist(), v0.tolist(), f.loglik)
        return pd.DataFrame([head, *[(key[0], int(x), z.tolist(), zz.ravel().tolist(), *[None] * 5) for x, z, zz in zip(t, s.z[1:], second[1:], strict=True)]])

    found = _runs(collapse(panel, loadings, m), transitions).groupBy("model").applyInPandas(one, MOMENTS)
    found = written(found)
    new = found.where("t = -1").select("model", "a", "q", "z0", "v0")
    loglik = found.where("t = -1").select("model", "loglik")
    return _loadings(panel, loadings, found.where("t >= 0").select("model", "t", "z", "zz"), m, least_r), new, loglik


def _loadings(panel: DataFrame, loadings: DataFrame, moments: DataFrame, m: int, least_r: float) -> DataFrame:
    """Regression of each series on the smoothed states it loads on: sums by series, then a small system each."""
    cells = panel.where("z is not null").select("model", "t", "series_id", F.col("z").alias("y")).join(moments, ["model", "t"])
    sums = [F.count(F.lit(1)).alias("n"), F.sum(F.col("y") * F.col("y")).alias("yy")]
    sums += [F.sum(F.col("y") * F.get("z", F.lit(i))).alias(f"h{i}") for i in range(m)]
    sums += [F.sum(F.get("zz", F.lit(i * m + j))).alias(f"j{k}") for k, (i, j) in enumerate(_upper(m))]
    found = cells.groupBy("model", "series_id").agg(*sums)
    rows = loadings.select("model", "series_id", "c", "r").join(
        found.select("model", "series_id", "n", "yy", _vector("h", m).alias("h"), _vector("j", len(_upper(m))).alias("j")), ["model", "series_id"], "left"
    )

    def solved(batches):
        for pdf in batches:
            c, r = [], []
            for row in pdf.itertuples(index=False):
                old = np.asarray(row.c, float)
                free = np.flatnonzero(old)
                if row.h is None or not len(free):
                    c.append(old.tolist())
                    r.append(row.r)
                    continue
                left, h = np.zeros((m, m)), np.asarray(row.h, float)
                for k, (i, j) in enumerate(_upper(m)):
                    left[i, j] = left[j, i] = row.j[k]
                loads = np.zeros(m)
                loads[free] = linalg.solve(left[np.ix_(free, free)], h[free])
                c.append(loads.tolist())
                r.append(max((row.yy - 2 * loads @ h + loads @ left @ loads) / row.n, least_r))
            yield pd.DataFrame({"model": pdf["model"], "series_id": pdf["series_id"], "c": c, "r": r})

    return rows.mapInPandas(solved, "model string, series_id string, c array<double>, r double")


def fit(panel: DataFrame, loadings: DataFrame, transitions: DataFrame, m: int, factors: int, max_iter: int = 50, threshold: float = 1e-5) -> tuple[DataFrame, DataFrame, DataFrame]:
    """EM from given parameters until the likelihood of every model has settled: loadings, transitions, and the path (model, step, loglik).

    Each step's parameters are written, so that a step depends on tables and never on a growing plan.
    """
    path: list[DataFrame] = []
    for step in range(max_iter):
        loadings, transitions, loglik = (written(x) for x in em_step(panel, loadings, transitions, m, factors))
        path.append(loglik.select("model", F.lit(step).alias("step"), "loglik"))
        if step:
            before = path[-2].select("model", F.col("loglik").alias("before"))
            middle = (F.abs("loglik") + F.abs("before")) / 2
            if path[-1].join(before, "model").where(F.abs(F.col("loglik") - F.col("before")) >= threshold * middle).isEmpty():
                break
    return loadings, transitions, reduce(DataFrame.unionByName, path)


def stationary(transitions: DataFrame) -> DataFrame:
    """The transitions with each model's stationary covariance as its v0, its start at 0."""

    def solved(batches):
        for pdf in batches:
            a, q = (([np.array([np.asarray(r, float) for r in m]) for m in pdf[c]]) for c in ("a", "q"))
            v0 = [linalg.stationary_covariance(x, y).tolist() for x, y in zip(a, q, strict=True)]
            yield pd.DataFrame({"model": pdf["model"], "a": [x.tolist() for x in a], "q": [x.tolist() for x in q], "z0": [[0.0] * len(x) for x in a], "v0": v0})

    return transitions.select("model", "a", "q", "z0", "v0").mapInPandas(solved, TRANSITION)


def news_weights(panel: DataFrame, loadings: DataFrame, transitions: DataFrame, m: int, target: str, target_t: int) -> DataFrame:
    """model, t, series_id, weight: what the smoothed ``target`` at ``target_t`` (standardised) owes to each observed cell.

    The worker of a model sweeps back over its collapsed periods and returns a vector a period; the
    weights of the cells are a join with the loadings, however many series there are.
    """
    aim = loadings.where(F.col("series_id") == target).select("model", F.col("c").alias("aim"))
    runs = _runs(collapse(panel, loadings, m), transitions).join(aim, "model")

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        t, _, p, f, s = _solved(pdf, m)
        rest = pdf.sort_values("t")
        rest = rest[rest["t"] >= 0]
        j = np.zeros((len(rest), m, m))
        for k, (x, y) in enumerate(_upper(m)):
            j[:, x, y] = j[:, y, x] = [v["j"][k] for v in rest["sums"]]
        at = int(np.flatnonzero(t == target_t)[0]) + 1
        d = kernel.sensitivities(f, s.gain, j, p.a, at, np.asarray(pdf.iloc[0]["aim"], float))
        return pd.DataFrame({"model": key[0], "t": t, "d": [row.tolist() for row in d[1:]]})

    owed = runs.groupBy("model").applyInPandas(one, "model string, t int, d array<double>")
    cells = panel.where("z is not null").select("model", "t", "series_id").join(loadings.select("model", "series_id", "c", "r"), ["model", "series_id"]).join(owed, ["model", "t"])
    dot = F.aggregate(F.zip_with("c", "d", lambda x, y: x * y), F.lit(0.0), lambda x, y: x + y)
    return cells.select("model", "t", "series_id", (dot / F.col("r")).alias("weight"))
