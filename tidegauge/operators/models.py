"""Factor models as grouped work: many models, vintages or steps in one job.

A recursion over time is sequential, so one model (periods x series) is one worker call, and
``groupBy(model)`` runs any number side by side. A fitted model is a long table of parameters
and results; on the driver it is a ``Model``, whose size depends on the specification only.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.dates import step_back
from ..functions.frequency import higher, periods_per_year
from ..plans import kernel, linalg
from ..sources.scratch import written
from .gram import components
from .missing import to_matrix
from .moments import standardise
from .vintage import released, view, views

FIT_SCHEMA = "model string, kind string, name string, i int, j int, value double"
_MATRICES = ("a", "c", "q", "r", "z0", "v0")


@dataclass(frozen=True)
class ModelSpec:
    """Everything a worker needs to fit: series in order, their layout, and the iteration's limits."""

    series: tuple[str, ...]
    layout: kernel.Layout
    block_names: tuple[str, ...] = ("Block_Global",)
    max_iter: int = 50
    threshold: float = 1e-5
    clip: float | None = None
    options: kernel.Options = kernel.Options()

    def json(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def from_json(cls, text: str) -> ModelSpec:
        raw = json.loads(text)
        options = {k: tuple(v) if isinstance(v, list) else v for k, v in raw.pop("options", {}).items()}
        tuples = {k: tuple(tuple(x) if isinstance(x, list) else x for x in v) if isinstance(v, list) else v for k, v in raw.pop("layout").items()}
        raw = {k: tuple(v) if isinstance(v, list) else v for k, v in raw.items()}
        return cls(layout=kernel.Layout(**tuples), options=kernel.Options(**options), **raw)


def _cells(kind: str, name: list[str] | str, values: np.ndarray) -> pd.DataFrame:
    values = np.atleast_2d(values)
    i, j = np.indices(values.shape)
    names = name if isinstance(name, str) else np.repeat(np.array(name, object), values.shape[1])
    return pd.DataFrame({"kind": kind, "name": names, "i": i.ravel(), "j": j.ravel(), "value": values.ravel()})


def _result(spec: ModelSpec, fitted: kernel.Fit, x: np.ndarray) -> pd.DataFrame:
    smooth, s = kernel.smoothed_panel(fitted, x)
    parts = [_cells("matrix", k, getattr(fitted.params, k)) for k in _MATRICES]
    parts += [_cells("mean", list(spec.series), fitted.mean[:, None]), _cells("std", list(spec.series), fitted.std[:, None])]
    parts += [_cells("smoothed", list(spec.series), smooth.T)]
    for b, (name, k) in enumerate(zip(spec.block_names, spec.layout.factors, strict=True)):
        o = spec.layout.offsets[b]
        parts.append(_cells("factor", name, s.z[1:, o : o + k]))
        # a slow series' weights sum to one, so its loading is the sum over the lags
        lags = fitted.params.c[:, o : o + k * spec.layout.depth].reshape(len(spec.series), spec.layout.depth, k)
        parts.append(_cells(f"loading:{name}", list(spec.series), lags.sum(1)))
    parts.append(_cells("loglik", "em", np.array(fitted.logliks)[None, :]))
    parts.append(_cells("converged", "em", np.array([[float(fitted.converged)]])))
    if fitted.guards:
        parts.append(_cells("guard", list(fitted.guards), np.array([[float(n)] for n in fitted.guards.values()])))
    return pd.concat(parts, ignore_index=True)


def fit(panel: DataFrame, spec: ModelSpec, model: str = "model") -> DataFrame:
    """Fit the specification to each model's rows (model, t, series_id, value); a long result table."""

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x = to_matrix(pdf, list(spec.series))
        out = _result(spec, kernel.fit(x, spec.layout, spec.max_iter, spec.threshold, spec.clip, spec.options), x)
        out.insert(0, "model", key[0])
        return out

    rows = panel.select(F.col(model).cast("string").alias("model") if model in panel.columns else F.lit(model).alias("model"), "t", "series_id", "value")
    return rows.groupBy("model").applyInPandas(one, FIT_SCHEMA)


@dataclass
class Model:
    """A fitted model on the driver."""

    spec: ModelSpec
    fitted: kernel.Fit

    @classmethod
    def from_table(cls, fits: DataFrame, spec: ModelSpec, model: str | None = None) -> Model:
        """Collects the parameters of one model: matrices of its state size, whatever the data's size."""
        rows = fits.where(F.col("kind").isin("matrix", "mean", "std", "loglik", "converged", "guard"))
        pdf = (rows if model is None else rows.where(F.col("model") == model)).toPandas()

        def matrix(kind: str, name: str | None = None) -> np.ndarray:
            part = pdf[(pdf["kind"] == kind) & ((pdf["name"] == name) if name else True)]
            out = np.zeros((part["i"].max() + 1, part["j"].max() + 1)) if len(part) else np.zeros((0, 0))
            out[part["i"], part["j"]] = part["value"]
            return out

        m = {k: matrix("matrix", k) for k in _MATRICES}
        params = kernel.Params(**{k: v[0] if k == "z0" else v for k, v in m.items()})
        fitted = kernel.Fit(
            spec.layout,
            params,
            matrix("mean")[:, 0],
            matrix("std")[:, 0],
            matrix("loglik").ravel().tolist(),
            bool(matrix("converged").any()),
            {r["name"]: int(r["value"]) for _, r in pdf[pdf["kind"] == "guard"].iterrows()},
        )
        return cls(spec, fitted)

    def index(self, series: str) -> int:
        if series not in self.spec.series:
            raise KeyError(f"unknown series {series!r}")
        return self.spec.series.index(series)


def factors(fits: DataFrame) -> DataFrame:
    return fits.where("kind = 'factor'").select("model", F.col("name").alias("block"), F.col("i").alias("t"), F.col("j").alias("k"), "value")


def loadings(fits: DataFrame) -> DataFrame:
    rows = fits.where(F.col("kind").startswith("loading:"))
    return rows.select("model", F.col("name").alias("series_id"), F.substring_index("kind", ":", -1).alias("block"), F.col("j").alias("k"), "value")


def smoothed(fits: DataFrame) -> DataFrame:
    return fits.where("kind = 'smoothed'").select("model", F.col("name").alias("series_id"), F.col("j").alias("t"), "value")


def logliks(fits: DataFrame) -> DataFrame:
    return fits.where("kind = 'loglik'").select(F.col("model").alias("run"), F.col("j").alias("iteration"), F.col("value").alias("loglik"))


def wide_factors(fits: DataFrame, blocks: list[str], per_block: int = 1) -> DataFrame:
    """One column F1, F2, .. a factor, in the order of blocks, one row a period."""
    names = [f"{b}_{k}" for b in blocks for k in range(per_block)]
    rows = factors(fits).withColumn("name", F.concat_ws("_", "block", "k"))
    return rows.groupBy("model", "t").pivot("name", names).agg(F.first("value")).withColumnsRenamed({n: f"F{j + 1}" for j, n in enumerate(names)})


def wide_smoothed(fits: DataFrame, series: list[str]) -> DataFrame:
    """One column a series, one row a period."""
    return smoothed(fits).groupBy("model", "t").pivot("series_id", series).agg(F.first("value"))


def transition_radius(fits: DataFrame) -> DataFrame:
    """Spectral radius of each model's transition matrix."""

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        a = np.zeros((pdf["i"].max() + 1,) * 2)
        a[pdf["i"], pdf["j"]] = pdf["value"]
        return pd.DataFrame([(key[0], linalg.spectral_radius(a))])

    return fits.where("kind = 'matrix' and name = 'a'").groupBy("model").applyInPandas(one, "model string, radius double")


def series_report(fits: DataFrame, panel: DataFrame) -> DataFrame:
    """Of each series: mean and deviation, largest loading, sum of squares, and error of the smoothed values in percent of the deviation."""
    loads = loadings(fits).groupBy("model", "series_id").agg(F.max(F.abs("value")).alias("largest"), F.sum(F.col("value") * F.col("value")).alias("squares"))
    base = [fits.where(F.col("kind") == k).select("model", F.col("name").alias("series_id"), F.col("value").alias(k)) for k in ("mean", "std")]
    both = smoothed(fits).join(panel.select("series_id", "t", F.col("value").alias("actual")), ["series_id", "t"]).where("actual is not null")
    error = both.groupBy("model", "series_id").agg(F.sqrt(F.avg(F.pow(F.col("value") - F.col("actual"), 2))).alias("rmse"))
    keys = ["model", "series_id"]
    return loads.join(base[0], keys).join(base[1], keys).join(error, keys, "left").withColumn("rmse_percent", 100 * F.col("rmse") / F.col("std"))


def diagnose(fits: DataFrame, top: int = 5) -> DataFrame:
    """The loadings of largest size of each block's factors."""
    w = Window.partitionBy("model", "block", "k").orderBy(F.abs("value").desc(), "series_id")
    return loadings(fits).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def places(spec: ModelSpec) -> list[tuple[str, int, int, str, str, int, int]]:
    """What each free entry of a model's matrices stands for: matrix, i, j, section, name, factor, lag."""
    layout, out = spec.layout, []
    for b, (block, r) in enumerate(zip(spec.block_names, layout.factors, strict=True)):
        o = layout.offsets[b]
        for k in range(r):
            out += [("a", o + k, o + lag * r + j, "factor transition", block, k, lag * r + j) for lag in range(layout.lags_of(b)) for j in range(r)]
            out += [("q", o + k, o + j, "factor variance", block, k, j) for j in range(r)]
    for i, name in enumerate(spec.series):
        slow = len(layout.weights(i)) > 1
        for b in np.flatnonzero(layout.blocks[i]).tolist():
            r = layout.factors[b]
            for lag in range(len(layout.weights(i))):
                out += [("c", i, layout.offsets[b] + lag * r + k, "slow loading" if slow else "loading", name, layout.offsets[b] // layout.depth + k, lag) for k in range(r)]
        if layout.chains[i]:
            o = layout.chain_offsets[i]
            out += [("a", o, o, "own transition", name, 0, 0), ("q", o, o, "own variance", name, 0, 0)]
        out.append(("r", i, i, "observation variance", name, 0, 0))
    return out


def result_tables(matrices: DataFrame, spec: ModelSpec) -> DataFrame:
    """The estimates of each model by what they mean: model, section, name (series or block), factor, lag, value.

    ``matrices`` are rows of model, name, i, j, value: those of ``fit`` of kind ``matrix``, or of ``em_update``.
    Sections are loading, slow loading (by lag of the tent), factor transition, factor variance, own
    transition, own variance and observation variance.
    """
    at = matrices.sparkSession.createDataFrame(places(spec), "matrix string, i int, j int, section string, name string, factor int, lag int")
    rows = matrices.select("model", F.col("name").alias("matrix"), "i", "j", "value")
    return rows.join(at, ["matrix", "i", "j"]).select("model", "section", "name", "factor", "lag", "value")


def fit_summary(fits: DataFrame) -> DataFrame:
    """Of each model: iterations, last log-likelihood, whether it converged, and how often guards acted."""
    n = lambda kind: F.col("kind") == kind
    return fits.groupBy("model").agg(
        F.count_if(n("loglik")).alias("iterations"),
        F.max_by("value", F.when(n("loglik"), F.col("j"))).alias("loglik"),
        F.max(F.when(n("converged"), F.col("value") > 0)).alias("converged"),
        F.coalesce(F.sum(F.when(n("guard"), F.col("value"))), F.lit(0.0)).alias("guarded"),
    )


STATES_SCHEMA = "model string, t int, k int, n_observed int, z_filtered double, v_filtered double, z double, v double, loglik double"


def _by_model(panel: DataFrame, by: str | None) -> DataFrame:
    """The panel with a column ``model``: the one named ``by``, or one model for all rows."""
    return panel.select((F.lit("0") if by is None else F.col(by).cast("string")).alias("model"), "t", "series_id", "value")


def fixed_states(model: Model, panel: DataFrame, by: str | None = None) -> DataFrame:
    """Filtered and smoothed states of a panel under the model's parameters; position -1 is the start.

    With ``by`` the panel holds several, a worker call each.
    """
    names = list(model.spec.series)

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x = to_matrix(pdf, names)
        y, first = model.fitted.standardise(x), int(pdf["t"].min())
        f = kernel.kalman_filter(y, model.fitted.params)
        s = kernel.smooth(f, model.fitted.params.a)
        n_seen = [0, *np.isfinite(y).sum(1).tolist()]
        return pd.DataFrame(
            [(key[0], first + t - 1, k, n_seen[t], f.zu[t, k], f.vu[t, k, k], s.z[t, k], s.v[t, k, k], f.loglik) for t in range(len(s.z)) for k in range(s.z.shape[1])]
        )

    return _by_model(panel, by).groupBy("model").applyInPandas(one, STATES_SCHEMA)


def em_update(model: Model, panel: DataFrame, by: str | None = None) -> DataFrame:
    """The parameters after one EM step from the model's own, by matrix and place, and the log-likelihood before it.

    With ``by`` the panel holds several that all start from these parameters, a worker call each.
    """
    names = list(model.spec.series)

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        y = model.fitted.standardise(to_matrix(pdf, names))
        new, loglik = kernel.em_step(y, model.fitted.params, model.spec.layout, model.spec.options)
        parts = [_cells("matrix", k, getattr(new, k)) for k in _MATRICES] + [_cells("loglik", "loglik", np.array([[loglik]]))]
        return pd.concat(parts, ignore_index=True).assign(model=key[0])[["model", "name", "i", "j", "value"]]

    return _by_model(panel, by).groupBy("model").applyInPandas(one, "model string, name string, i int, j int, value double")


def forecast(spark: SparkSession, model: Model, panel: DataFrame, horizon: int | None = None) -> DataFrame:
    """Each series ``horizon`` periods after the panel's end (a year by default)."""
    h, names = horizon or periods_per_year(model.spec.layout.clock), list(model.spec.series)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        x = to_matrix(pdf, names)
        values, _ = kernel.forecast(model.fitted, x, h)
        steps = np.repeat(np.arange(1, h + 1), len(names))
        return pd.DataFrame({"series_id": names * h, "h": steps, "t": int(pdf["t"].max()) + steps, "value": values.ravel()})

    return panel.select(F.lit(0).alias("model"), "t", "series_id", "value").groupBy("model").applyInPandas(one, "series_id string, h int, t int, value double")


def filter_state(model: Model, panel: DataFrame, t: int) -> kernel.State:
    """Where the model's filter stands before period ``t`` of a panel: one mean and variance, whatever the panel's length."""
    if t <= 0:
        return kernel.State(0, model.fitted.params.z0, model.fitted.params.v0)
    names = list(model.spec.series)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        y = model.fitted.standardise(to_matrix(pdf, names))
        f = kernel.kalman_filter(y, model.fitted.params)
        return pd.DataFrame([(f.zu[-1].tolist(), f.vu[-1].ravel().tolist(), f.loglik, int(np.isfinite(y).sum()), int((~np.isfinite(y)).sum()))])

    before = panel.where(F.col("t") < t).select(F.lit(0).alias("model"), "t", "series_id", "value")
    row = before.groupBy("model").applyInPandas(one, "z array<double>, v array<double>, loglik double, seen long, missing long").first()
    if row is None:
        return filter_state(model, panel, 0)
    m = len(row["z"])
    return kernel.State(t, np.array(row["z"]), np.array(row["v"]).reshape(m, m), row["loglik"], row["seen"], row["missing"])


def views_part(panel: DataFrame, view_dates: list[str]) -> int | None:
    """The first period at which the views differ: some of them know a cell that others do not."""
    low, high = (F.lit(d).cast("date") for d in (min(view_dates), max(view_dates)))
    late = F.col("release_day").isNotNull() & (F.col("release_date") > low) & (F.col("release_date") <= high)
    return released(panel).where(late & F.col("value").isNotNull()).agg(F.min("t").alias("t")).first()["t"]


def shared_state(model: Model, panel: DataFrame, view_dates: list[str], target_t: int) -> kernel.State:
    """The filter's state where the views begin to differ, or at the target if that comes first.

    All views agree on what lies before, so it is filtered once for all of them.
    """
    parts = views_part(panel, view_dates)
    t = target_t if parts is None else min(parts, target_t)
    return filter_state(model, view(panel, min(view_dates)), max(t, 0))


def _seen_rows(model: Model, panel: DataFrame, view_dates: list[str], state: kernel.State) -> tuple[DataFrame, kernel.Fit]:
    """The views' rows from the state's period on, and the model that goes on from there."""
    return views(panel.where(F.col("t") >= state.t), view_dates).select("view_date", "t", "series_id", "value"), model.fitted.resumed(state)


def nowcasts(model: Model, panel: DataFrame, view_dates: list[str], series: str, target_t: int, state: kernel.State | None = None) -> DataFrame:
    """The target as nowcast on each view date, with the view's availability; one worker call a view.

    The panel carries release_day. A view beyond the panel's end extends it with missing rows. Every
    view goes on from the ``state`` that they share; one kept from before (``ParquetStore.save_state``)
    spares reading what lies before it, as long as no cell there has changed.
    """
    i, names = model.index(series), list(model.spec.series)
    state = state or shared_state(model, panel, view_dates, target_t)
    rows, fitted = _seen_rows(model, panel, view_dates, state)
    at = target_t - state.t

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x = to_matrix(pdf, names)
        value = kernel.nowcast(fitted, x, at, i)
        observed = at < len(x) and bool(np.isfinite(x[at, i]))
        return pd.DataFrame([(key[0], series, target_t, value, observed, state.seen + int(np.isfinite(x).sum()), state.missing + int((~np.isfinite(x)).sum()))])

    return rows.groupBy("view_date").applyInPandas(
        one, "view_date date, series_id string, t int, nowcast double, observed boolean, n_available long, n_missing long"
    )


_PART = "news_series string, n_cells long, actual double, expected double, weight double, news double"
STEP_SCHEMA = (
    "step int, view_date date, before_date date, series_id string, t int, y_old double, nowcast double, observed boolean, n_available long, n_missing long, "
    f"failed string, parts array<struct<{_PART.replace(' ', ':').replace(',:', ',')}>>"
)


def _parts(names: list[str], n: kernel.News) -> list[dict]:
    out = []
    for k in np.unique(n.cells[:, 1]) if len(n.cells) else []:
        mine = n.cells[:, 1] == k
        means = {c: float(v[mine].mean()) for c, v in (("actual", n.actual), ("expected", n.expected), ("weight", n.weight))}
        out.append({"news_series": names[k], "n_cells": int(mine.sum()), **means, "news": float(n.parts[mine].sum())})
    return out


def steps(model: Model, panel: DataFrame, view_dates: list[str], series: str, target_t: int, state: kernel.State | None = None) -> DataFrame:
    """Each view with its predecessor, oldest first: nowcast, and what each series' new cells add to the one before.

    A view's rows go to its own step and the next, so a step is one group and one worker call. A step
    that raises is a row with its reason in ``failed`` and nulls; so is one of a view that knows nothing. Where only
    the news fail, the nowcast stays.
    """
    i, names, dates = model.index(series), list(model.spec.series), sorted(view_dates)
    state = state or shared_state(model, panel, dates, target_t)
    rows, fitted = _seen_rows(model, panel, dates, state)
    at, days = target_t - state.t, [pd.Timestamp(d).date() for d in dates]
    uses = [F.struct(F.lit(k + later).alias("step"), F.lit(1 - later).alias("side"), F.lit(d).cast("date").alias("view_date")) for k, d in enumerate(dates) for later in (0, 1) if k + later < len(dates)]
    use = panel.sparkSession.range(1).select(F.explode(F.array(*uses)).alias("u")).select("u.*")

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        k = int(key[0])
        row = dict.fromkeys(name.split()[0] for name in STEP_SCHEMA.split(", parts")[0].split(", ")) | {"parts": []}
        row |= {"step": k, "view_date": days[k], "before_date": days[k - 1] if k else None, "series_id": series, "t": target_t}
        doing = ""
        try:
            new = to_matrix(pdf[pdf["side"] == 1], names)
            row |= {"n_available": state.seen + int(np.isfinite(new).sum()), "n_missing": state.missing + int((~np.isfinite(new)).sum())}
            if not row["n_available"]:
                raise ValueError(f"nothing is known on {dates[k]}")
            row |= {"nowcast": kernel.nowcast(fitted, new, at, i), "observed": at < len(new) and bool(np.isfinite(new[at, i]))}
            if k:
                doing = "news: "
                found = kernel.news(fitted, to_matrix(pdf[pdf["side"] == 0], names), new, at, i)
                row |= {"y_old": found.old, "parts": _parts(names, found)}
        except Exception as e:  # noqa: BLE001  the other steps go on
            row["failed"] = f"{doing}{type(e).__name__}: {e}"
        return pd.DataFrame([row])

    return rows.join(use, "view_date").select("step", "side", "t", "series_id", "value").groupBy("step").applyInPandas(one, STEP_SCHEMA)


def news(model: Model, panel: DataFrame, view_dates: list[str], series: str, target_t: int, state: kernel.State | None = None) -> DataFrame:
    """What each series' new cells add between neighbouring views; the parts sum to the change.

    A step without new cells is a row without a series. A step that fails raises its reason.
    """
    found = steps(model, panel, view_dates, series, target_t, state).where("step > 0")
    head = ["view_date", "before_date", "series_id", "t", "y_old", F.when(F.col("failed").isNotNull(), F.raise_error(F.col("failed")).cast("double")).otherwise(F.col("nowcast")).alias("y_new")]
    rows = found.select(*head, F.explode_outer("parts").alias("p")).select("*", "p.*").drop("p")
    return rows.withColumns({"n_cells": F.coalesce("n_cells", F.lit(0)), "news": F.coalesce("news", F.lit(0.0))})


def news_summary(news_rows: DataFrame, top: int = 5) -> DataFrame:
    """Total change and the parts of largest size, by view; missing ones last."""
    w = Window.partitionBy("view_date").orderBy(F.abs("news").desc_nulls_last(), "news_series")
    total = F.sum("news").over(Window.partitionBy("view_date"))
    return news_rows.withColumn("total", total).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def view_dates(spark: SparkSession, target: str, steps: int, frequency: str, higher_frequency: bool = False) -> list[str]:
    """``steps`` dates back from the target, oldest first."""
    f = (higher(frequency) or frequency) if higher_frequency else frequency
    dates = F.array(*[step_back(F.lit(target).cast("date"), k, f).cast("string") for k in range(steps, 0, -1)])
    return spark.range(1).select(dates.alias("d")).first()["d"]


def backtest(model: Model, panel: DataFrame, dates: list[str], series: str, target_t: int, state: kernel.State | None = None) -> DataFrame:
    """Nowcasts of one target over the views in one pass: steps() with the actual value and each step's error.

    A failed step has no error; the others keep theirs.
    """
    actual = panel.where((F.col("series_id") == series) & (F.col("t") == target_t)).select(F.first("value")).scalar()
    out = steps(model, panel, dates, series, target_t, state).withColumn("actual", actual)
    e = F.col("nowcast") - F.col("actual")
    return out.withColumn("error", e).withColumn("abs_error", F.abs(e)).withColumn("squared_error", e * e)


def backtest_summary(steps: DataFrame) -> DataFrame:
    return steps.agg(
        F.avg("abs_error").alias("mae"), F.avg("squared_error").alias("mse"), F.sqrt(F.avg("squared_error")).alias("rmse"), F.count("error").alias("n"), F.count_if(F.col("error").isNull()).alias("n_failed")
    )


def dataset(model: Model, panel: DataFrame, series: str, periods: list[int], backward: int = 0) -> DataFrame:
    """For each period: its nowcast without its own value, the actual, their difference, and features.

    With ``backward`` the nowcast is made on each of so many weeks before the period and in it, as the
    cells were released by then; ``path`` holds them, oldest first, and the last is the baseline.
    Features are the factors at the last known period and the mean of the panel's last row.
    """
    i, names, layout = model.index(series), list(model.spec.series), model.spec.layout

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        t = int(key[0])
        x = to_matrix(pdf, names)
        actual, x[t, i] = x[t, i], np.nan
        x[t + 1 :] = np.nan
        path = []
        if backward:
            date = pd.to_datetime(pdf.loc[pdf["t"] == t, "period"]).iloc[0]
            for weeks in range(backward, -1, -1):
                view = date - pd.Timedelta(weeks=weeks)
                known = (pd.to_datetime(pdf["period"]) <= view) & ~(pd.to_datetime(pdf["release_date"]) > view)
                past = to_matrix(pdf.assign(value=pdf["value"].where(known)), names)
                past[t, i] = np.nan
                path.append(kernel.nowcast(model.fitted, past, t, i))
        else:
            path.append(kernel.nowcast(model.fitted, x, t, i))
        baseline = path[-1]
        _, s = kernel.smoothed_panel(model.fitted, x[: t + 1])
        last = x[t][np.isfinite(x[t])]
        state = [float(s.z[-1, o]) for b, o in enumerate(layout.offsets[:-1])]
        return pd.DataFrame([(t, series, baseline, actual, actual - baseline, [*state, float(last.mean()) if len(last) else 0.0], path)])

    columns = ["t", "series_id", "value"]
    if backward:
        panel, columns = released(panel), ["t", "period", "release_date", "series_id", "value"]
    rows = panel.select(*columns, F.explode(F.array(*[F.lit(int(p)) for p in periods])).alias("period_t"))
    return rows.groupBy("period_t").applyInPandas(
        one, "t int, series_id string, baseline double, actual double, target double, features array<double>, path array<double>"
    )


STATE_SCHEMA = "t int, series_id string, nowcast double, history array<double>, residuals array<double>, factors array<double>, features array<double>"


def states(model: Model, panel: DataFrame, series: str, periods: list[int], lookback: int | None = None) -> DataFrame:
    """What a downstream model sees at each period, knowing nothing later.

    The nowcast of the period without its own value, the history before and at it (a year by
    default, padded with nulls on the left), the history less the nowcast, the factors, and all of
    it as one vector in which missing numbers are 0.
    """
    i, names, layout = model.index(series), list(model.spec.series), model.spec.layout
    rows_back = lookback or periods_per_year(layout.clock)

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x, t = to_matrix(pdf, names), int(key[0])
        x = x[: t + 1]
        past = np.concatenate([np.full(max(0, rows_back - len(x)), np.nan), x[-rows_back:, i]])
        blind = x.copy()
        blind[-1, i] = np.nan
        now = kernel.nowcast(model.fitted, blind, t, i)
        _, s = kernel.smoothed_panel(model.fitted, blind)
        state = [float(s.z[-1, o]) for o in layout.offsets[:-1]]
        residuals = past - now
        nulls = [[None if np.isnan(v) else float(v) for v in part] for part in (past, residuals)]
        return pd.DataFrame([(t, series, now, *nulls, state, [now, *np.nan_to_num(past).tolist(), *np.nan_to_num(residuals).tolist(), *state])])

    rows = panel.select("t", "series_id", "value", F.explode(F.array(*[F.lit(int(p)) for p in periods])).alias("period_t"))
    return rows.groupBy("period_t").applyInPandas(one, STATE_SCHEMA)


def equal_loadings(rows: DataFrame, y: str, xs: list[str]) -> DataFrame:
    """Least-squares loadings of ``y`` on ``xs`` (few columns) held equal, from one row of sums."""
    columns, n = [*xs, y], len(xs)
    places = [(i, j) for i in range(n + 1) for j in range(i, n + 1)]
    sums = [F.sum(F.col(columns[i]) * F.col(columns[j])).alias(f"s{i}_{j}") for i, j in places]

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        cross = np.zeros((n + 1, n + 1))
        for i, j in places:
            cross[i, j] = cross[j, i] = pdf[f"s{i}_{j}"].iloc[0]
        root = np.linalg.cholesky(cross[:n, :n] + 1e-12 * np.eye(n)).T  # n rows with the same normal equations
        held = np.hstack([np.ones((n - 1, 1)), -np.eye(n - 1)])
        return pd.DataFrame({"x": xs, "loading": linalg.constrained_ls(root, np.linalg.solve(root.T, cross[:n, n]), held, np.zeros(n - 1))})

    return rows.agg(*sums).withColumn("model", F.lit(0)).groupBy("model").applyInPandas(one, "x string, loading double")


def principal_components(panel: DataFrame, k: int = 1) -> tuple[DataFrame, DataFrame]:
    """Loadings (series_id, k, value) and factors (t, k, value) of the standardised panel.

    The panel is standardised once and written; loadings are found without the covariance
    (``gram.components``), and the factors are a join and a sum.
    """
    z = written(standardise(panel).select("t", "series_id", F.col("z").alias("value")))
    loads, _ = components(z, k)
    loads = written(loads)
    scores = z.join(loads.withColumnRenamed("value", "w"), "series_id").groupBy("t", "k").agg(F.sum(F.col("value") * F.col("w")).alias("value"))
    return loads, scores
