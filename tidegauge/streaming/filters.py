"""Streams of observations: panels that grow, and a Kalman filter that keeps its state.

A published value is an event; what a vintage view is to a table, a watermark is to a stream.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.scalar import Q, R, V0, Z0, A

STATE = "t long, z double, v double, loglik double"
FILTERED = "series_id string, t long, value double, z double, v double, loglik double, late boolean"


def growing_panel(events: DataFrame, time: str, series: str, value: str, every: str = "1 day", late: str = "2 days") -> DataFrame:
    """Sums by window and series over a stream; a window closes ``late`` after its end."""
    rows = events.select(F.col(time).cast("timestamp").alias("ts"), F.col(series).alias("series_id"), F.col(value).cast("double").alias("value"))
    sums = rows.withWatermark("ts", late).groupBy(F.window("ts", every), "series_id").agg(F.sum("value").alias("value"))
    return sums.select(F.col("window.start").cast("date").alias("period"), "series_id", "value")


def _advance(state: tuple, t: int, y: float | None, a: float, q: float, r: float) -> tuple:
    """Predict to ``t``, however many periods on, and update if there is a value."""
    last, z, v, loglik = state
    steps = t - last
    grown = a**steps  # as many periods as there are, in one step
    z, v = grown * z, grown * grown * v + q * (steps if a * a == 1 else (1 - grown * grown) / (1 - a * a))
    if y is not None and not math.isnan(y):
        f = v + r
        miss = y - z
        loglik -= 0.5 * (math.log(f) + miss * miss / f)
        z, v = z + v / f * miss, v - v * v / f
    return t, z, v, loglik


def kalman_stream(observations: DataFrame, a: float = A, q: float = Q, r: float = R, z0: float = Z0, v0: float = V0) -> DataFrame:
    """Filter a stream (series_id, t, value), one state of four numbers a series.

    Rows of a batch are taken in order of ``t``; periods without a row are predicted over, however
    many there are, in one step. A row at or before the filter's position comes too late to count,
    and one without ``t`` has no place: both pass marked, and change nothing.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.get if state.exists else (-1, z0, v0, 0.0)
        rows = []
        cells = [(None if pd.isna(t) else int(t), float(y)) for pdf in frames for t, y in zip(pdf["t"], pdf["value"], strict=True)]
        for t, y in sorted(cells, key=lambda x: (x[0] is None, x[0] or 0, math.isnan(x[1]), x[1])):
            late = t is None or t <= now[0]
            if not late:
                now = _advance(now, t, y, a, q, r)
            rows.append((key[0], t, y, now[1], now[2], now[3], late))
        state.update(tuple(now))
        yield pd.DataFrame(rows, columns=["series_id", "t", "value", "z", "v", "loglik", "late"]).astype({"t": "Int64"})

    rows = observations.select("series_id", F.col("t").cast("long").alias("t"), F.col("value").cast("double").alias("value"))
    return rows.groupBy("series_id").applyInPandasWithState(step, FILTERED, STATE, "append", GroupStateTimeout.NoTimeout)
