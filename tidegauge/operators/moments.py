"""Standardising, covariances and the sums of the estimation steps, as aggregates.

Covariances come from blocks of series (``gram``): a row a pair is their result, never their input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written
from .gram import complete_periods, products

LEAST_STD = 1e-8
LEAST_VARIANCE = 1e-10


def moments(panel: DataFrame, clip: float | None = None) -> DataFrame:
    """Mean and deviation (population) of each series; a clip at ``clip`` concerns only these."""
    x = F.col("value") if clip is None else F.greatest(F.least("value", F.lit(clip)), F.lit(-clip))
    x = F.when(F.col("value").isNotNull(), x)
    std = F.stddev_pop(x)
    return panel.groupBy("series_id").agg(
        F.avg(x).alias("mean"), F.when(std < LEAST_STD, F.lit(1.0)).otherwise(std).alias("std"), F.count(x).alias("n")
    )


def standardise(panel: DataFrame, clip: float | None = None) -> DataFrame:
    """Add ``z``. The moments, one row a series, join back; Spark broadcasts them if they are small."""
    return panel.join(moments(panel, clip), "series_id", "left").withColumn("z", (F.col("value") - F.col("mean")) / F.col("std"))


def unstandardise(panel: DataFrame, z: str = "z") -> DataFrame:
    return panel.withColumn("value", F.col(z) * F.col("std") + F.col("mean"))


def safe_variance(panel: DataFrame) -> DataFrame:
    """Variance of each series; what is missing or below the floor is 1."""
    var = F.var_pop("value")
    return panel.groupBy("series_id").agg(F.when(var >= LEAST_VARIANCE, var).otherwise(F.lit(1.0)).alias("variance"))


def clean_variance(variances: DataFrame, default: float = 1.0, floor: float = 1e-8, value: str = "variance") -> DataFrame:
    """Bad variances get the median of the good ones (else the default); then the floor."""
    x = F.col(value)
    good = F.when((x >= 0) & ~F.isnan(x) & (x != float("inf")), x)
    middle = variances.agg(F.median(good)).scalar()
    return variances.withColumn("cleaned", F.greatest(F.coalesce(good, middle, F.lit(default)), F.lit(floor)))


def covariance_listwise(panel: DataFrame) -> DataFrame:
    """Sample covariance over the periods at which every series is observed."""
    sums = products(complete_periods(written(panel.select("t", "series_id", "value"))))
    value = F.try_divide(F.col("sxy") - F.try_divide(F.col("sx") * F.col("sy"), "n"), F.col("n") - 1)
    return sums.select("a", "b", value.alias("covariance"))


def covariance_pairwise(panel: DataFrame) -> DataFrame:
    """Population covariance over each pair's common periods.

    Under two of them it is 0, or 1 on the diagonal; the diagonal has a floor.
    """
    same, n = F.col("a") == F.col("b"), F.col("n")
    c = F.try_divide(F.col("sxy"), n) - F.try_divide(F.col("sx"), n) * F.try_divide(F.col("sy"), n)
    value = F.when(n < 2, F.when(same, 1.0).otherwise(0.0)).otherwise(F.when(same, F.greatest(c, F.lit(LEAST_VARIANCE))).otherwise(c))
    return products(panel).select("a", "b", value.alias("covariance"))


def common_factor(panel: DataFrame) -> DataFrame:
    """The mean of the standardised series at each period: a stand-in factor ``f``."""
    return standardise(panel).groupBy("t").agg(F.avg("z").alias("f")).where("f is not null")


def with_factor(panel: DataFrame) -> DataFrame:
    return standardise(panel).where("z is not null").join(common_factor(panel), "t")


def loadings_ls(panel: DataFrame) -> DataFrame:
    """Least-squares loading of each series on the factor, from two sums."""
    return with_factor(panel).groupBy("series_id").agg(F.try_divide(F.sum(F.col("z") * F.col("f")), F.sum(F.col("f") * F.col("f"))).alias("loading"))


def observation_variance(panel: DataFrame) -> DataFrame:
    """Mean squared residual of each series on the factor."""
    rows = with_factor(panel).join(loadings_ls(panel), "series_id")
    return rows.groupBy("series_id").agg(F.avg(F.pow(F.col("z") - F.col("loading") * F.col("f"), 2)).alias("variance"))


def sufficient_sums(panel: DataFrame) -> DataFrame:
    """S11, S00 and S10 of the factor and its lag. One row a period goes through one window."""
    f = common_factor(panel)
    lagged = f.join(f.select((F.col("t") + 1).alias("t"), F.col("f").alias("g")), "t")
    return lagged.agg(F.sum(F.col("f") * F.col("f")).alias("s11"), F.sum(F.col("g") * F.col("g")).alias("s00"), F.sum(F.col("f") * F.col("g")).alias("s10"))


def transition_update(panel: DataFrame) -> DataFrame:
    """The factor's AR coefficient and innovation variance from its sums: A = S10 / S00, Q = (S11 - A S10) / n."""
    sums = sufficient_sums(panel).withColumn("a", F.try_divide("s10", "s00"))
    n = common_factor(panel).agg(F.count(F.lit(1))).scalar() - 1
    return sums.select("a", (F.try_divide(F.col("s11") - F.col("a") * F.col("s10"), n)).alias("q"))


def ar1(panel: DataFrame, value: str = "z") -> DataFrame:
    """AR(1) coefficient, innovation variance and stationary variance of each standardised series.

    Neighbouring periods pair by position, so a gap never pairs across.
    """
    w = Window.partitionBy("series_id").orderBy("t")
    rows = standardise(panel).withColumn("before", F.lag(value).over(w)).where(f"{value} is not null and before is not null")
    fit = rows.groupBy("series_id").agg(
        F.try_divide(F.sum(F.col(value) * F.col("before")), F.sum(F.col("before") * F.col("before"))).alias("phi"),
        F.count(F.lit(1)).alias("n"),
    )
    q = rows.join(fit, "series_id").groupBy("series_id").agg(F.var_pop(F.col(value) - F.col("phi") * F.col("before")).alias("q"))
    return fit.join(q, "series_id").withColumn("stationary", F.try_divide("q", 1 - F.col("phi") * F.col("phi")))


def explained(panel: DataFrame) -> DataFrame:
    """1 - R / (R + variance of the factor's part), and the correlation of both with the series."""
    rows = with_factor(panel).join(loadings_ls(panel), "series_id").withColumn("fit", F.col("loading") * F.col("f"))
    resid = F.avg(F.pow(F.col("z") - F.col("fit"), 2))
    return rows.groupBy("series_id").agg(
        (1 - resid / (resid + F.var_pop("fit"))).alias("explained"), F.corr("z", "fit").alias("correlation"), F.sqrt(resid).alias("rmse"), F.avg(F.abs(F.col("z") - F.col("fit"))).alias("mae")
    )
