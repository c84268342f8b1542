"""The user's facade: configuration, data, training, forecasts, nowcasts, news and backtests."""

from __future__ import annotations

import logging
import re
from collections.abc import Callable, Mapping
from datetime import date
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.dates import parse_period
from .operators import models as G
from .operators import panel as P
from .sources import config as C
from .sources import tables

log = logging.getLogger(__name__)
#: Periods by name: ``2024m3``, ``2024q1``, ``2024s2``, ``2024``.
PERIOD_NAME = re.compile(r"\d{4}(?:([mqs])\d{1,2})?$")
#: What the package offers as functions on the default session.
ON_DEFAULT = tuple(
    """load_config load_data load_result train predict plot_data nowcast decompose update backtest dataset state reset
    from_yaml from_spec from_spec_df from_dict factors loadings smoothed diagnose report summary data original_data time quality""".split()
)


class FactorSession:
    """One model and its data. Every result but accessors' scalars is a DataFrame."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.reset()

    def reset(self) -> None:
        self.config: C.ModelConfig | None = None
        self.panel: DataFrame | None = None
        self.fits: DataFrame | None = None
        self.model: G.Model | None = None
        self._views: tables.ViewManager | None = None
        self._start: Any = None

    # configuration

    def load_config(self, given: Any = None, *, base: Any = None, override: Any = None) -> FactorSession:
        """From a path, mapping, source or configuration; or a base with an override on top."""
        src = C.MergedSource(C.source(base), C.source(override)) if base is not None else C.source(given)
        self.config = C.ModelConfig.from_mapping(src.mapping())
        return self

    def from_yaml(self, path: str) -> FactorSession:
        return self.load_config(C.YamlSource(path))

    def from_dict(self, mapping: Mapping[str, Any]) -> FactorSession:
        return self.load_config(mapping)

    def from_spec(self, path: str, **settings: Any) -> FactorSession:
        """From a spec CSV."""
        return self.from_spec_df(self.spark.read.csv(path, header=True), **settings)

    def from_spec_df(self, spec: DataFrame, folder: str | None = None, name: str = "spec", **settings: Any) -> FactorSession:
        """From a spec table; with ``folder`` also written there as YAML."""
        mapping = C.spec_mapping(spec)
        if folder:
            C.write_yaml(mapping, folder, name)
        return self.load_config(mapping | settings)

    # data

    def _configured(self) -> C.ModelConfig:
        if self.config is None:
            raise RuntimeError("load a configuration first")
        return self.config

    def load_data(self, data: DataFrame | str, start: str | None = None, end: str | None = None, transform: bool = True) -> FactorSession:
        """A panel (period, series_id, value) or the path of a CSV; aligned, completed and transformed.

        With ``transform=False`` values stay as they are.
        """
        spec = self._configured().series_table(self.spark)
        rows = tables.read_csv(self.spark, data) if isinstance(data, str) else data
        missing = [r["series_id"] for r in P.unmatched(rows, spec).select("series_id").collect()]
        if len(missing) == len(self._configured().series):
            raise ValueError("none of the configured series is in the data")
        if missing:
            log.warning("series without data: %s", ", ".join(missing))
        clock = self._configured().settings.clock
        if not transform:
            spec = spec.withColumn("transformation", F.lit("lin"))
        self.panel, self._views, self._start = P.load(rows, spec, start, end, clock), None, None
        return self

    def _data(self) -> DataFrame:
        if self.panel is None:
            raise RuntimeError("load data first")
        return self.panel

    def data(self) -> DataFrame:
        return self._data().select("period", "t", "series_id", "value")

    def original_data(self) -> DataFrame:
        return self._data().select("period", "t", "series_id", F.col("raw_value").alias("value"))

    def time(self) -> DataFrame:
        """The calendar: position and period."""
        return self._data().select("t", "period").distinct()

    def view(self, view_date: str) -> DataFrame:
        """The panel as known on a date; asked for again, the same one."""
        if self._views is None:
            self._views = tables.ViewCatalogue(self._data())
        return self._views.get(view_date)

    def quality(self) -> DataFrame:
        return P.quality(self._data())

    # training

    def train(self, max_iter: int | None = None, threshold: float | None = None, store: tables.ResultStore | None = None, **overrides: Any) -> FactorSession:
        """Fit the model; with a store also save the result. Settings given here go before the configuration's."""
        here = {r["series_id"] for r in self._data().select("series_id").distinct().collect()}
        names = [s.series_id for s in self._configured().series if s.series_id in here]
        spec = self._configured().model(names, max_iter, threshold, **overrides)
        self.fits = G.fit(self._data(), spec).cache()
        self.model = G.Model.from_table(self.fits, spec)
        if not self.model.fitted.converged:
            log.warning("not converged in %d iterations", spec.max_iter)
        for line in self._configured().warnings(self.model.fitted.guards):
            log.warning("%s", line)
        if store is not None:
            store.save(self.fits, spec)
        return self

    def load_result(self, store: tables.ResultStore, result_id: str) -> FactorSession:
        """A stored result; what the configuration says otherwise than the result's own is logged."""
        self.fits, spec = store.load(result_id)
        self.model = G.Model.from_table(self.fits, spec)
        if self.config is not None:
            for line in self.config.drift_from(spec):
                log.warning("the result was fitted otherwise: %s", line)
        return self

    def _trained(self) -> G.Model:
        if self.model is None:
            raise RuntimeError("train the model first")
        return self.model

    def factors(self) -> DataFrame:
        self._trained()
        return G.factors(self.fits)

    def loadings(self) -> DataFrame:
        self._trained()
        return G.loadings(self.fits)

    def smoothed(self) -> DataFrame:
        self._trained()
        return G.smoothed(self.fits)

    def diagnose(self, top: int = 5) -> DataFrame:
        self._trained()
        return G.diagnose(self.fits, top)

    # use

    def predict(self, horizon: int | None = None) -> DataFrame:
        return G.forecast(self.spark, self._trained(), self._data(), horizon)

    def plot_data(self, horizon: int | None = None) -> DataFrame:
        """What a factor and forecast chart shows: kind, name, t, value."""
        f = self.factors().select(F.lit("factor").alias("kind"), F.concat_ws("_", "block", "k").alias("name"), "t", "value")
        return f.unionByName(self.predict(horizon).select(F.lit("forecast").alias("kind"), F.col("series_id").alias("name"), "t", "value"))

    def backtest_lines(self, steps: DataFrame) -> DataFrame:
        """What a backtest chart shows: view_date, kind (nowcast, actual, error), value."""
        return steps.unpivot("view_date", ["nowcast", "actual", "error"], "kind", "value")

    def summary(self) -> DataFrame:
        """Iterations, last log-likelihood, convergence and guards of the fit."""
        self._trained()
        return G.fit_summary(self.fits)

    def _target(self, period: str | int | date) -> int:
        """The position of a period: its date, ISO text, name such as ``2024q1``, or the position itself."""
        if isinstance(period, int):
            if period < 0:
                raise ValueError(f"{period} lies before the data")
            return period
        if isinstance(period, date):
            period = period.isoformat()[:10]
        if named := PERIOD_NAME.match(period.strip().lower()):
            f = {"m": "m", "q": "q", "s": "sa", "": "a"}[named[1] or ""]
            period = str(self.spark.range(1).select(parse_period(F.lit(period), f).alias("p")).first()["p"])
        if self._start is None:
            self._start = self._data().agg(F.min("period").alias("p"), F.min("t").alias("t")).first()
        start = self._start
        clock = self._configured().settings.clock
        row = self.spark.range(1).select(F.lit(start["p"]).alias("a"), F.lit(period).cast("date").alias("b"))
        step = {"m": 1, "q": 3, "sa": 6, "a": 12}.get(clock)
        apart = F.floor((12 * (F.year("b") - F.year("a")) + F.month("b") - F.month("a")) / step) if step else F.floor(F.datediff("b", "a") / {"d": 1, "w": 7}[clock])
        t = int(row.select(apart.alias("k")).first()["k"]) + start["t"]
        if t < start["t"]:
            raise ValueError(f"{period} lies before the data")
        return t

    def position(self, period: str | int | date) -> int:
        """The calendar position of a period, given by a date, its text, a name such as ``2024q1``, or the position."""
        return self._target(period)

    def nowcast(self, series: str, view_dates: str | list[str], period: str) -> DataFrame:
        dates = [view_dates] if isinstance(view_dates, str) else view_dates
        return G.nowcasts(self._trained(), self._data(), dates, series, self._target(period))

    def decompose(self, series: str, old_view: str, new_view: str, period: str) -> DataFrame:
        return G.news(self._trained(), self._data(), [old_view, new_view], series, self._target(period))

    def update(self, series: str, old_view: str, new_view: str, period: str, callback: Callable[[DataFrame], None] | None = None) -> DataFrame:
        """The news of a view; a callback gets its summary, and its errors are logged, not raised."""
        found = G.news_summary(self.decompose(series, old_view, new_view, period))
        if callback is not None:
            try:
                callback(found)
            except Exception:
                log.exception("the callback failed")
        return found

    def backtest(self, series: str, period: str, steps: int = 20, higher_frequency: bool = False) -> DataFrame:
        spec = self._trained().spec.layout
        dates = G.view_dates(self.spark, period, steps, spec.clock, higher_frequency)
        return G.backtest(self._trained(), self._data(), dates, series, self._target(period))

    def dataset(self, series: str, periods: list[str], backward: int = 0) -> DataFrame:
        return G.dataset(self._trained(), self._data(), series, [self._target(p) for p in periods], backward)

    def state(self, series: str, periods: str | list[str], lookback: int | None = None) -> DataFrame:
        """Nowcast, history, residuals, factors and feature vector of a series at each period."""
        named = [periods] if isinstance(periods, str) else periods
        return G.states(self._trained(), self._data(), series, [self._target(p) for p in named], lookback)

    def history(self, series: str, rows: int = 4) -> DataFrame:
        """Each period's recent values of a series."""
        return P.lookback(self._data().where(F.col("series_id") == series), rows).select("period", "t", "history")

    def report(self) -> DataFrame:
        """Loadings and fit of each series."""
        self._trained()
        return G.series_report(self.fits, self._data())


_default: FactorSession | None = None


def default() -> FactorSession:
    """The module's own session, made on first use."""
    global _default
    if _default is None:
        _default = FactorSession(SparkSession.builder.getOrCreate())
    return _default
