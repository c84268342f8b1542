"""Panel operators: a long table (period DATE, series_id STRING, value DOUBLE) and its shapes.

A panel's size is series x periods, already aggregated from the facts; the facts are scanned
once, pruned to the columns used, and combined before the one shuffle on (period, series).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import INTERVALS
from ..functions.frequency import rank, rank_column
from ..functions.transforms import in_order, transformed

KEYS = ["period", "series_id"]


def finite(value: str | Column) -> Column:
    """NaN and infinities are missing."""
    value = (F.col(value) if isinstance(value, str) else value).cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)


def build(facts: DataFrame, date: str | Column, series: str | Column, value: str | Column, clock: str = "m") -> DataFrame:
    """Sum facts to one value a period and series."""
    day = (F.col(date) if isinstance(date, str) else date).cast("date")
    period = {"d": day, "w": F.trunc(day, "WEEK"), "m": F.trunc(day, "MM"), "q": F.trunc(day, "QUARTER"), "a": F.trunc(day, "YEAR")}[clock]
    series, value = (F.col(x) if isinstance(x, str) else x for x in (series, value))
    return (
        facts.select(period.alias("period"), series.alias("series_id"), value.cast("double").alias("value"))
        .groupBy(*KEYS)
        .agg(F.sum("value").alias("value"))
    )


def with_t(panel: DataFrame, clock: str = "m") -> DataFrame:
    """Add ``t``, the period's position on the calendar that starts with the panel's first."""
    start = panel.agg(F.min("period")).scalar()
    if clock in ("d", "w"):
        t = F.expr("0") + F.floor(F.datediff("period", start) / (1 if clock == "d" else 7))
    else:
        months = 12 * (F.year("period") - F.year(start)) + F.month("period") - F.month(start)
        t = F.floor(months / {"m": 1, "q": 3, "sa": 6, "a": 12}[clock])
    return panel.withColumn("t", t.cast("int"))


def complete(panel: DataFrame, clock: str = "m") -> DataFrame:
    """Every series at every period from the panel's first to its last, missing cells null, with ``t``.

    The calendar is unfolded inside each series' row from two scalar bounds, so there is no
    product of two tables.
    """
    low, high = panel.agg(F.min("period")).scalar(), panel.agg(F.max("period")).scalar()
    calendar = F.posexplode(F.sequence(low, high, F.expr(f"interval {INTERVALS[clock]}"))).alias("t", "period")
    grid = panel.select("series_id").distinct().select("series_id", calendar)
    return grid.join(panel, KEYS, "left").select("period", "series_id", "t", *[c for c in panel.columns if c not in KEYS])


def between(panel: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Periods from start to end, both included."""
    if start:
        panel = panel.where(F.col("period") >= F.lit(start).cast("date"))
    return panel.where(F.col("period") <= F.lit(end).cast("date")) if end else panel


def pivot(panel: DataFrame, series: list[str], value: str = "value") -> DataFrame:
    """One column a series; naming them saves the job that finds them."""
    return panel.groupBy("period").pivot("series_id", series).agg(F.first(value))


def unpivot(wide: DataFrame, key: str = "period", series: list[str] | None = None) -> DataFrame:
    """One row a cell."""
    names = series or [c for c in wide.columns if c != key]
    return wide.unpivot(key, names, "series_id", "value")


def align(panel: DataFrame, spec: DataFrame) -> DataFrame:
    """The cells of the specified series, with their specification; others are dropped.

    A specification is a small table; Spark broadcasts it if its size allows.
    """
    return panel.join(spec, "series_id")


def unmatched(panel: DataFrame, spec: DataFrame) -> DataFrame:
    """Specified series that the panel lacks."""
    return spec.join(panel.select("series_id").distinct(), "series_id", "left_anti")


def downsample(panel: DataFrame, frequency: str | Column = "frequency") -> DataFrame:
    """Null the cells that are no period end of a slower series on a monthly calendar."""
    frequency = F.col(frequency) if isinstance(frequency, str) else frequency
    month = F.month("period")
    keep = (
        F.when(frequency == "q", month % 3 == 0).when(frequency == "sa", month % 6 == 0).when(frequency == "a", month == 12).otherwise(F.lit(True))
    )
    return panel.withColumn("value", F.when(keep, F.col("value")))


def reject_faster(spec: DataFrame, clock: str = "m") -> None:
    """A series faster than the clock is an error."""
    faster = [r["series_id"] for r in spec.where(rank_column("frequency") < rank(clock)).select("series_id").limit(5).collect()]
    if faster:
        raise ValueError(f"series faster than the clock {clock}: {', '.join(faster)}")


def transform(panel: DataFrame, clock_scaled: bool = False) -> DataFrame:
    """Apply each series' transformation; ``raw_value`` keeps the level. Needs a complete calendar."""
    out = panel.withColumn("transformed", transformed("value", clock_scaled=clock_scaled))
    return out.withColumnRenamed("value", "raw_value").withColumnRenamed("transformed", "value")


def drop_leading_empty(panel: DataFrame) -> DataFrame:
    """Drop the first periods at which no series has a value."""
    first = panel.where(F.col("value").isNotNull()).agg(F.min("t")).scalar()
    return panel.where(F.col("t") >= first)


def load(facts: DataFrame, spec: DataFrame, start: str | None = None, end: str | None = None, clock: str = "m") -> DataFrame:
    """Align, complete, cut to the sample, transform, drop the empty start.

    The calendar is that of the specified series: ``t`` counts from the first period of theirs in the sample.
    """
    reject_faster(spec, clock)
    own = facts.select(*KEYS, finite("value").alias("value")).join(spec.select("series_id"), "series_id", "left_semi")
    panel = complete(between(own, start, end), clock)
    return drop_leading_empty(transform(align(panel, spec)))


def quality(panel: DataFrame, max_missing: float = 0.9) -> DataFrame:
    """Observations, missing share and warnings of each series, in one aggregation."""
    n_series = panel.select("series_id").distinct().agg(F.count(F.lit(1))).scalar()
    out = panel.groupBy("series_id").agg(F.count(F.lit(1)).alias("n_periods"), F.count("value").alias("n_obs"))
    missing = 1 - F.col("n_obs") / F.col("n_periods")
    return out.select(
        "series_id",
        "n_periods",
        "n_obs",
        missing.alias("missing_share"),
        (missing > max_missing).alias("mostly_missing"),
        (F.col("n_obs") < n_series).alias("fewer_obs_than_series"),
    )


def extend(panel: DataFrame, periods: int, clock: str = "m") -> DataFrame:
    """Append ``periods`` empty periods to a complete panel."""
    last = panel.agg(F.max("t")).scalar()
    ends = panel.where(F.col("t") == last).select("series_id", F.col("period").alias("end"), F.col("t").alias("end_t"))
    step = F.expr(f"interval {INTERVALS[clock]}")
    steps = ends.select("series_id", "end", "end_t", F.posexplode(F.sequence("end", F.col("end") + step * F.lit(periods), step)).alias("k", "period"))
    new = steps.where("k > 0").select(F.col("period").cast("date").alias("period"), "series_id", (F.col("end_t") + F.col("k")).alias("t"))
    return panel.unionByName(new, allowMissingColumns=True)


def find_period(panel: DataFrame, target: str, clock: str = "m") -> DataFrame:
    """The first position of the target's month, or of the very date on a day or week clock."""
    day = F.lit(target).cast("date")
    match = F.col("period") == day if clock in ("d", "w") else F.trunc("period", "MM") == F.trunc(day, "MM")
    return panel.where(match).agg(F.min("t").alias("t"))


def block_patterns(spec: DataFrame) -> DataFrame:
    """Series that load on the same blocks, as one group each."""
    return spec.groupBy(F.array_join(F.array_sort("blocks"), ",").alias("pattern")).agg(F.count(F.lit(1)).alias("n_series"), F.array_join(F.array_sort(F.collect_list("series_id")), ",").alias("series"))


def lookback(panel: DataFrame, rows: int) -> DataFrame:
    """Each cell's last ``rows`` values, oldest first, padded with nulls on the left."""
    lags = [F.lag("value", k).over(in_order()) for k in range(rows - 1, 0, -1)]
    return panel.withColumn("history", F.array(*lags, F.col("value")))


def slower_count(spec: DataFrame, clock: str = "m") -> DataFrame:
    """How many series are slower than the clock."""
    return spec.agg(F.sum((rank_column("frequency") > rank(clock)).cast("int")).alias("n_slower"))


