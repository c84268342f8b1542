"""What was known on a date: release masks, many vintages at once, availability and new cells.

A vintage is never copied: it is the panel with a condition. Several view dates unfold inside
each row from an array, so they cost a generator and no join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import release_date, step_back


def _date(x: str | Column) -> Column:
    return F.lit(x).cast("date") if isinstance(x, str) else x


def released(panel: DataFrame) -> DataFrame:
    """Add the release date; needs ``release_day`` from the specification."""
    return panel.withColumn("release_date", release_date("release_day", "period"))


def visible(view_date: Column) -> Column:
    return F.col("release_day").isNull() | (view_date >= F.col("release_date"))


def view(panel: DataFrame, view_date: str | Column) -> DataFrame:
    """The panel as known on a date; cells not yet released are null, rows stay."""
    seen = visible(_date(view_date))
    out = released(panel)
    for c in ("value", "raw_value"):
        if c in panel.columns:
            out = out.withColumn(c, F.when(seen, F.col(c)))
    return out


def views(panel: DataFrame, view_dates: list[str] | Column) -> DataFrame:
    """All views below each other, with ``view_date``."""
    dates = F.array(*[_date(d) for d in view_dates]) if isinstance(view_dates, list) else view_dates
    out = released(panel).withColumn("view_date", F.explode(dates))
    return out.withColumn("value", F.when(visible(F.col("view_date")), F.col("value")))


def backward_dates(target: str, steps: int, frequency: str) -> Column:
    """An array of view dates, ``steps`` of them back from the target, oldest first."""
    return F.array(*[step_back(_date(target), k, frequency) for k in range(steps, 0, -1)])


def availability(viewed: DataFrame) -> DataFrame:
    """Known and unknown cells of each view."""
    return viewed.groupBy("view_date").agg(F.count("value").alias("n_available"), F.count_if(F.col("value").isNull()).alias("n_missing"))


def new_cells(panel: DataFrame, old_view: str, new_view: str) -> DataFrame:
    """Cells unknown in the old view and known in the new one: two conditions on one scan."""
    rows = released(panel).where(F.col("value").isNotNull())
    return rows.where(~visible(_date(old_view)) & visible(_date(new_view)))
