"""The nine series transforms, as window expressions over a complete calendar.

``step`` is the number of calendar rows between two observations of the series, ``year`` the
number of its periods in a year. As lags count rows, a quarterly series on a monthly calendar
reaches back four rows for ``ch1`` and ``pc1``; ``clock_scaled`` makes that a year of rows, and
annualises by the periods of the series.
"""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

from .frequency import PERIODS_PER_YEAR, ROW_STEP, annual_factor, case_of, periods_per_year

EPSILON = 1e-10
CODES = ("lin", "chg", "ch1", "pch", "pc1", "pca", "cch", "cca", "log")


def in_order() -> WindowSpec:
    """A series' cells by calendar position."""
    return Window.partitionBy("series_id").orderBy("t")


def _lagged(value: Column, frequency: Column, rows: dict[str, int], otherwise: int) -> Column:
    """The value so many rows earlier, by frequency: one lag for each distinct distance."""
    by_distance: dict[int, list[str]] = {}
    for f, n in rows.items():
        by_distance.setdefault(n, []).append(f)
    out = F.lag(value, otherwise).over(in_order())
    for n, names in by_distance.items():
        if n != otherwise:
            out = F.when(frequency.isin(names), F.lag(value, n).over(in_order())).otherwise(out)
    return out


def _log(x: Column) -> Column:
    return F.log(F.abs(x) + F.lit(EPSILON))


def _percent(now: Column, before: Column) -> Column:
    return F.try_divide(F.lit(100.0) * (now - before), F.abs(before + F.lit(EPSILON)))


def transformed(
    value: str | Column = "value", transformation: str | Column = "transformation", frequency: str | Column = "frequency", clock_scaled: bool = False
) -> Column:
    """One CASE over the transformation; unknown codes leave the value as it is."""
    value, transformation, frequency = (F.col(c) if isinstance(c, str) else c for c in (value, transformation, frequency))
    year_rows = {f: periods_per_year(f) * (ROW_STEP.get(f, 1) if clock_scaled else 1) for f in PERIODS_PER_YEAR}
    before = _lagged(value, frequency, ROW_STEP, 1)
    year = _lagged(value, frequency, year_rows, 12)
    factor = case_of(frequency, {f: float(periods_per_year(f)) if clock_scaled else annual_factor(f) for f in PERIODS_PER_YEAR}, 12.0)
    change = F.lit(100.0) * (_log(value) - _log(before))
    code = F.lower(transformation)
    return (
        F.when(code == "chg", value - before)
        .when(code == "ch1", value - year)
        .when(code == "pch", _percent(value, before))
        .when(code == "pc1", _percent(value, year))
        .when(code == "pca", factor * _percent(value, before))
        .when(code == "cch", change)
        .when(code == "cca", factor * change)
        .when(code == "log", _log(value))
        .otherwise(value)
    )
