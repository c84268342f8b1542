"""Missing data: trimming, fills, clipping-robust moments' inputs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.linalg import METHODS, SPARSE
from .scalar import fold_path


def row_gaps(panel: DataFrame) -> DataFrame:
    """Series and missing cells of each period, one small row a period."""
    return panel.groupBy("t").agg(F.count(F.lit(1)).alias("n_series"), F.count_if(F.col("value").isNull()).alias("n_missing"))


def trim(panel: DataFrame, threshold: float = SPARSE) -> DataFrame:
    """Drop the first and last periods that miss more than the share; those between stay."""
    full = row_gaps(panel).where(F.col("n_missing") <= F.lit(threshold) * F.col("n_series"))
    return panel.where(F.col("t").between(full.agg(F.min("t")).scalar(), full.agg(F.max("t")).scalar()))


def eligible(panel: DataFrame, share: float = 0.5, least: int = 2) -> DataFrame:
    """Periods with enough observed series to start an estimation from: a share of them, and at least ``least``."""
    rows = row_gaps(panel).withColumn("n_observed", F.col("n_series") - F.col("n_missing"))
    return rows.where(F.col("n_observed") >= F.greatest(F.lit(float(least)), F.lit(share) * F.col("n_series"))).select("t", "n_observed")


def fill_median(panel: DataFrame) -> DataFrame:
    """Missing cells get the median of the series' observed values."""
    return panel.withColumn("value", F.coalesce("value", F.median("value").over(Window.partitionBy("series_id"))))


def _steps(seen: Column) -> Column:
    """Observed cells (place, value) with the step and slope to the next one."""

    def ahead(knot: Column, k: Column) -> Column:
        then = F.get(seen, k + 1)
        h = (then["i"] - knot["i"]).cast("double")
        return F.struct(knot["i"].alias("i"), knot["y"].alias("y"), h.alias("h"), ((then["y"] - knot["y"]) / h).alias("s"))

    return F.transform(seen, ahead)


def _equations(knots: Column) -> Column:
    """A row (before, here, after, right) of the tridiagonal system for the slope at every knot: not-a-knot ends, a parabola of three, a line of two."""
    n = F.size(knots)

    def row(knot: Column, k: Column) -> Column:
        h, s = (lambda j: F.get(knots, j)["h"]), (lambda j: F.get(knots, j)["s"])
        one = lambda a, b, c, r: F.struct(*[x.cast("double").alias(y) for x, y in ((a, "before"), (b, "here"), (c, "after"), (r, "right"))])
        none = F.lit(0.0)
        inner = one(h(k), 2 * (h(k - 1) + h(k)), h(k - 1), 3 * (h(k) * s(k - 1) + h(k - 1) * s(k)))

        def end(near: Column, far: Column) -> Column:
            two = h(near) + h(far)
            right = ((h(near) + 2 * two) * h(far) * s(near) + h(near) * h(near) * s(far)) / two
            parabola = s(near) + h(near) * (s(near) - s(far)) / two
            few = F.when(n == 2, s(near)).otherwise(parabola)
            return F.when(n < 4, one(none, F.lit(1.0), none, few)).otherwise(F.when(k == 0, one(none, h(far), two, right)).otherwise(one(two, h(far), none, right)))

        return F.when(k == 0, end(k, k + 1)).when(k == n - 1, end(k - 1, k - 2)).otherwise(inner)

    return F.transform(knots, row)


def _down(rows: Column) -> Column:
    """The system's rows without what stands before the diagonal, last one first: a fold down the rows."""
    start = F.struct(F.lit(0.0).alias("after"), F.lit(0.0).alias("right"))

    def step(above: Column, row: Column) -> Column:
        pivot = row["here"] - row["before"] * above["after"]
        return F.struct((row["after"] / pivot).alias("after"), ((row["right"] - row["before"] * above["right"]) / pivot).alias("right"))

    return F.reverse(fold_path(rows, start, step))


def _up(rows: Column) -> Column:
    """The solution, last one first: a fold back up."""
    return fold_path(rows, F.lit(0.0), lambda below, row: row["right"] - row["after"] * below)


def _curve(knots: Column, slopes: Column) -> Column:
    """The spline at every place from the first knot to the last."""

    def piece(k: Column) -> Column:
        here, d, then = F.get(knots, k), F.get(slopes, k), F.get(slopes, k + 1)
        c2, c3 = (3 * here["s"] - 2 * d - then) / here["h"], (d + then - 2 * here["s"]) / (here["h"] * here["h"])
        return F.transform(F.sequence(F.lit(0), here["h"].cast("int") - 1), lambda u: here["y"] + u * (d + u * (c2 + u * c3)))

    inner = F.flatten(F.transform(F.sequence(F.lit(0), F.size(knots) - 2), piece))
    return F.concat(inner, F.array(F.get(knots, F.size(knots) - 1)["y"]))


def _median(values: Column) -> Column:
    x = F.array_sort(F.filter(values, lambda v: v.isNotNull()))
    middle = lambda k: F.get(x, k.cast("int"))
    return (middle((F.size(x) - 1) / 2) + middle(F.size(x) / 2)) / 2


def fill_spline(panel: DataFrame, mode: str = "spline", smooth: int = 3) -> DataFrame:
    """Fill each series from a cubic spline through its observations.

    ``spline`` keeps the curve inside and a moving average of it, over 2 ``smooth`` + 1 periods, at the ends;
    ``smooth`` puts the moving average into every missing cell; ``median`` the median of the spline-filled
    series. Series without values stay empty. A series is one row of arrays and the spline two folds over it.
    """
    if mode not in ("spline", "smooth", "median"):
        raise ValueError(f"unknown mode {mode!r}")
    cells = F.array_sort(F.collect_list(F.struct("t", "period", "value")))
    observed = F.filter(F.transform("cells", lambda c, i: F.struct(i.alias("i"), c["value"].alias("y"))), lambda c: c["y"].isNotNull())
    rows = panel.groupBy("series_id").agg(cells.alias("cells")).withColumn("seen", observed)
    # a column for each stage: an expression inside a lambda would be worked out again for every element
    several = lambda c: F.when(F.size("seen") > 1, c)
    for name, stage in (("knots", _steps(F.col("seen"))), ("system", several(_equations(F.col("knots")))), ("solved", several(_down(F.col("system")))), ("back", several(_up(F.col("solved")))), ("slopes", F.reverse("back"))):
        rows = rows.withColumn(name, stage)
    rows = rows.withColumn("curve", several(_curve(F.col("knots"), F.col("slopes"))).otherwise(F.transform("seen", lambda k: k["y"])))
    first = F.get("seen", F.lit(0))["i"]
    own = F.transform("cells", lambda c, i: F.coalesce(c["value"], F.when(i >= first, F.get("curve", i - first))))
    rows = rows.withColumn("inside", own).withColumn("middle", _median(F.col("inside")))
    rows = rows.withColumn("filled", F.transform("inside", lambda x: F.coalesce(x, "middle")))

    def average(i: Column) -> Column:
        near = F.sequence(i - smooth, i + smooth)
        at = lambda j: F.get("filled", F.greatest(F.lit(0), F.least(j, F.size("filled") - 1)))
        return F.aggregate(near, F.lit(0.0), lambda done, j: done + at(j)) / (2 * smooth + 1)

    def value(c: Column, i: Column) -> Column:
        if mode == "median":
            return F.coalesce(c["value"], F.col("middle"))
        return F.coalesce(c["value"], average(i)) if mode == "smooth" else F.coalesce(F.get("inside", i), average(i))

    done = F.transform("cells", lambda c, i: F.struct(c["period"].alias("period"), c["t"].alias("t"), value(c, i).alias("value")))
    kinds = dict(panel.dtypes)
    return rows.select("series_id", F.explode(done).alias("c")).select("c.period", "series_id", F.col("c.t").cast(kinds["t"]).alias("t"), "c.value")


def treat(panel: DataFrame, method: int = 2, k: int = 3, mode: str = "spline") -> DataFrame:
    """The numbered methods: trim, then fill."""
    cut, fill = METHODS[method]
    if cut != "none":
        panel = trim(panel, SPARSE if cut == "sparse" else 1 - 1e-9)
    return panel if fill == "none" else fill_spline(panel, mode, k)


def mask(panel: DataFrame) -> DataFrame:
    """Which cells are missing."""
    return panel.withColumn("missing", F.col("value").isNull())


def to_matrix(pdf: pd.DataFrame, series: list[str]) -> np.ndarray:
    """Periods by series, in the given order, from the rows of one model's panel."""
    return pdf.pivot(index="t", columns="series_id", values="value").reindex(columns=series).to_numpy(float)
