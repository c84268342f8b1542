"""Calendar functions: release dates, period names and ends, ranges, backward steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INTERVALS = {"d": "1 day", "w": "7 days", "m": "1 month", "q": "3 months", "sa": "6 months", "a": "12 months"}
MONTHS = {"m": 1, "q": 3, "sa": 6, "a": 12}
DAYS = {"d": 1, "w": 7}


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def release_date(day: str | Column, period: str | Column) -> Column:
    """When a period's value is published.

    A positive day is a day of the period's month, at most its last; a negative one counts back
    from the end of the month before, at most to its first. Null: with the period itself. Zero
    has no meaning and gives null.
    """
    day, period = _c(day), _c(period)
    before = F.add_months(period, -1)
    late = F.date_add(F.trunc(period, "MM"), F.least(day, F.dayofmonth(F.last_day(period))) - 1)
    early = F.greatest(F.date_add(F.last_day(before), day + 1), F.trunc(before, "MM"))
    return F.when(day.isNull(), period).when(day > 0, late).when(day < 0, early)


def parse_period(text: str | Column, frequency: str) -> Column:
    """A date from ``2024m3``, ``2024q1``, ``2024s2``, ``2024`` or, for days and weeks, ISO or ``2024m03d15``.

    Letters in either case; a quarter is dated at its last month. Anything else is null.
    """
    low = F.lower(F.trim(_c(text)))

    def part(pattern: str, k: int) -> Column:
        return F.try_to_number(F.nullif(F.regexp_extract(low, pattern, k), F.lit("")), F.lit("9999")).cast("int")

    def first(year: Column, month: Column, top: int = 12) -> Column:
        return F.when(month.between(1, top), F.make_date(year, month, F.lit(1)))

    if frequency == "m":
        p = r"^(\d{4})m(\d{1,2})$"
        return first(part(p, 1), part(p, 2))
    if frequency == "q":
        p = r"^(\d{4})q([1-4])$"
        return first(part(p, 1), part(p, 2) * 3)
    if frequency == "sa":
        p = r"^(\d{4})s([12])$"
        return first(part(p, 1), part(p, 2) * 6 - 5)
    if frequency == "a":
        return first(part(r"^(\d{4})$", 1), F.lit(1))
    p = r"^(\d{4})m(\d{1,2})d(\d{1,2})$"
    iso = F.when(low.rlike(r"^\d{4}-\d{2}-\d{2}$"), low)
    named = F.when(low.rlike(p), F.concat_ws("-", F.regexp_extract(low, p, 1), F.lpad(F.regexp_extract(low, p, 2), 2, "0"), F.lpad(F.regexp_extract(low, p, 3), 2, "0")))
    return F.to_date(F.try_to_timestamp(F.coalesce(iso, named), F.lit("yyyy-MM-dd")))


def parse_timestamp(text: str | Column) -> Column:
    """ISO dates and times, then the common written forms; numbers are seconds since 1970."""
    text = F.trim(_c(text))
    forms = ["yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd", "yyyy/MM/dd", "MM/dd/yyyy", "dd-MM-yyyy"]
    seconds = F.when(text.rlike(r"^\d+(\.\d+)?$"), F.timestamp_seconds(F.expr("0D") + text.try_cast("double")))
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in forms], seconds)


def period_end(date: str | Column, frequency: str) -> Column:
    """Last day of the period that holds the date."""
    date = _c(date)
    if frequency in DAYS:
        return date if frequency == "d" else F.date_add(F.trunc(date, "WEEK"), 6)
    months = MONTHS[frequency]
    to_go = (months - 1) - (F.month(date) - 1) % months
    return F.last_day(F.add_months(F.trunc(date, "MM"), to_go))


def next_period_end(date: str | Column, frequency: str) -> Column:
    """Last day of the period after the one that holds the date."""
    end = period_end(date, frequency)
    if frequency in DAYS:
        return F.date_add(end, DAYS[frequency])
    return F.last_day(F.add_months(end, MONTHS[frequency]))


def step_back(date: str | Column, n: int | Column, frequency: str) -> Column:
    """The date ``n`` periods earlier; months keep the day of the month where there is one."""
    date, n = _c(date), n if isinstance(n, Column) else F.lit(n)
    if frequency in DAYS:
        return F.date_sub(date, n * DAYS[frequency])
    return F.add_months(date, n * -MONTHS[frequency])


def date_range(df: DataFrame, start: Column, end: Column, frequency: str, name: str = "period") -> DataFrame:
    """``df`` with a row for each date from start to end, stepping from the start itself."""
    return df.withColumn(name, F.explode(F.sequence(start, end, F.expr(f"interval {INTERVALS[frequency]}"))))


def same_month(a: str | Column, b: str | Column) -> Column:
    return F.trunc(_c(a), "MM") == F.trunc(_c(b), "MM")


def date_range_of(df: DataFrame, start: Column, periods: int | Column, frequency: str, name: str = "period") -> DataFrame:
    """``df`` with a row for each of ``periods`` dates, stepping from the start itself; none for fewer than one."""
    n = periods if isinstance(periods, Column) else F.lit(periods)
    steps = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return df.withColumn(name, F.explode(F.transform(steps, lambda k: step_back(start, -k, frequency))))


def at_position(t: str | Column, start: Column, frequency: str) -> Column:
    """The date of a calendar position that counts from ``start``."""
    return step_back(start, -_c(t), frequency)


def days_in_month(date: str | Column) -> Column:
    return F.dayofmonth(F.last_day(_c(date)))


def make_date(year: Column, month: Column, day: Column) -> Column:
    """Null for a day that the month lacks."""
    return F.try_make_timestamp(year, month, day, F.lit(0), F.lit(0), F.lit(0)).cast("date")


def written(date: str | Column, pattern: str = "yyyy-MM-dd") -> Column:
    return F.date_format(_c(date), pattern)
