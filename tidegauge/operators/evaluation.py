"""Errors, recovery and summaries, as aggregates."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.transforms import in_order
from ..plans.linalg import rotation


def naive(panel: DataFrame) -> DataFrame:
    """Predict each cell by the series' last earlier value."""
    before = Window.partitionBy("series_id").orderBy("t").rowsBetween(Window.unboundedPreceding, -1)
    return panel.withColumn("prediction", F.last("value", ignorenulls=True).over(before))


def rmse(rows: DataFrame, actual: str = "value", prediction: str = "prediction") -> DataFrame:
    """Root mean squared error of each series and overall (series_id null), over pairs of both."""
    error = F.col(actual) - F.col(prediction)
    both = rows.where(error.isNotNull() & ~F.isnan(error))
    return both.rollup("series_id").agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(error * error)).alias("rmse"), F.avg(F.abs(error)).alias("mae"))


def step_metrics(rows: DataFrame, by: list[str]) -> DataFrame:
    """Mean absolute, mean squared and root mean squared error by ``by``; steps without errors count as failed."""
    e = F.col("value") - F.col("prediction")
    return rows.groupBy(*by).agg(
        F.avg(F.abs(e)).alias("mae"), F.avg(e * e).alias("mse"), F.sqrt(F.avg(e * e)).alias("rmse"), F.count(e).alias("n"), F.count_if(e.isNull()).alias("n_failed")
    )


def top_changes(panel: DataFrame, n: int = 5) -> DataFrame:
    """The largest changes of the last period by size; ties by name, missing ones last."""
    change = F.col("value") - F.lag("value").over(in_order())
    last = panel.agg(F.max("t")).scalar()
    rows = panel.withColumn("change", change).where(F.col("t") == last)
    return rows.orderBy(F.abs("change").desc_nulls_last(), "series_id").limit(n).select("series_id", "change")


def summary(rows: DataFrame, by: str, value: str) -> DataFrame:
    """Mean, deviation, least and greatest."""
    return rows.groupBy(by).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.min(value).alias("low"), F.max(value).alias("high"))


def rotated(rows: DataFrame, key: str) -> DataFrame:
    """(key, k, true, estimate) with the estimates turned by the orthogonal matrix nearest to the true values.

    The k x k cross products are one aggregate, their SVD one worker call, and the turn a join and a sum.
    """
    pairs = rows.select(key, F.col("k").alias("i"), "estimate").join(rows.select(key, F.col("k").alias("j"), "true"), key)
    cross = pairs.groupBy("i", "j").agg(F.sum(F.col("estimate") * F.col("true")).alias("value"))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        names = sorted(set(pdf["i"]))
        m = pdf.pivot(index="i", columns="j", values="value").reindex(index=names, columns=names).fillna(0.0).to_numpy()
        turn = rotation(m)
        return pd.DataFrame([(a, b, float(turn[x, y])) for x, a in enumerate(names) for y, b in enumerate(names)])

    kind = rows.schema["k"].dataType.simpleString()
    turn = cross.withColumn("model", F.lit(0)).groupBy("model").applyInPandas(one, f"i {kind}, j {kind}, w double")
    turned = rows.select(key, F.col("k").alias("i"), "estimate").join(turn, "i").groupBy(key, F.col("j").alias("k")).agg(F.sum(F.col("estimate") * F.col("w")).alias("estimate"))
    return rows.select(key, "k", "true").join(turned, [key, "k"])


def recovery(rows: DataFrame, by: str, true: str = "true", estimate: str = "estimate") -> DataFrame:
    """Correlation and error of estimated factors or loadings; signs are taken as they are."""
    return rows.rollup(by).agg(F.corr(true, estimate).alias("correlation"), F.sqrt(F.avg(F.pow(F.col(true) - F.col(estimate), 2))).alias("rmse"))


def convergence(logliks: DataFrame, threshold: float = 1e-4, decrease: float = 1e-3) -> DataFrame:
    """Relative change of neighbouring log-likelihoods, whether it has converged, whether it fell."""
    w = Window.partitionBy("run").orderBy("iteration")
    before = F.lag("loglik").over(w)
    change = 2 * F.abs(F.col("loglik") - before) / (F.abs("loglik") + F.abs(before) + F.lit(2.220446049250313e-16))
    rows = logliks.withColumn("change", change).where("change is not null")
    rows = rows.withColumn("converged", F.col("change") < threshold)
    return rows.join(logliks.select("run", (F.col("iteration") + 1).alias("iteration"), F.col("loglik").alias("before")), ["run", "iteration"]).withColumn(
        "decreased", F.col("loglik") - F.col("before") < -decrease
    ).drop("before")
