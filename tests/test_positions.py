"""Positions count on the calendar of the specified series, not on that of all series in the data."""

from tidegauge import FactorSession
from tidegauge.operators import panel as P


def test_the_calendar_starts_with_the_specified_series(spark):
    cells = [(f"2001-{m:02d}-01", "other", 1.0) for m in range(1, 13)] + [(f"2001-{m:02d}-01", "a", float(m)) for m in range(4, 11)]
    rows = spark.createDataFrame(cells, "period string, series_id string, value double").selectExpr("cast(period as date) as period", "series_id", "value")
    # the first change of a is May's; the calendar begins with its first level, and ends with its last
    session = FactorSession(spark).from_dict({"series": {"a": {"transformation": "chg"}}}).load_data(rows)
    assert session.position("2001-05-01") == 1 and session.position("2001q4") == 8
    assert sorted((r["t"], str(r["period"])) for r in session.time().collect()) == [(m - 4, f"2001-{m:02d}-01") for m in range(5, 11)]


def test_only_the_sample_counts(spark):
    cells = [(f"2001-{m:02d}-01", s, 1.0) for m in range(1, 13) for s in ("a", "other") if s == "other" or m > 5]
    rows = spark.createDataFrame(cells, "period string, series_id string, value double").selectExpr("cast(period as date) as period", "series_id", "value")
    spec = spark.createDataFrame([("a", "m", "lin")], "series_id string, frequency string, transformation string")
    got = sorted((r["t"], str(r["period"])) for r in P.load(rows, spec, "2001-03-01", "2001-08-01").collect())
    assert got == [(0, "2001-06-01"), (1, "2001-07-01"), (2, "2001-08-01")]
