"""State space with one state, inside the JVM: a fold over each series' sorted values.

Each series becomes one array row (its length is the calendar's, not the data's), and the
recursion is an ``aggregate`` over it. Missing cells skip the update.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the catalogue's model.
A, Q, R, Z0, V0 = 0.8, 0.1, 0.5, 0.0, 1.0


def as_arrays(panel: DataFrame, value: str = "z") -> DataFrame:
    cells = F.array_sort(F.collect_list(F.struct("t", F.col(value).alias("y"))))
    return panel.groupBy("series_id").agg(F.transform(cells, lambda c: c["y"]).alias("ys"))


def _step(s: Column, y: Column, a: float, q: float, r: float) -> Column:
    zp, vp = F.lit(a) * s["z"], F.lit(a * a) * s["v"] + F.lit(q)
    f = vp + F.lit(r)
    seen = y.isNotNull()
    gain, miss = vp / f, y - zp
    return F.struct(
        F.when(seen, zp + gain * miss).otherwise(zp).alias("z"),
        F.when(seen, vp - gain * vp).otherwise(vp).alias("v"),
        zp.alias("zp"),
        vp.alias("vp"),
        (s["loglik"] + F.when(seen, F.lit(-0.5) * (F.log(f) + miss * miss / f)).otherwise(F.lit(0.0))).alias("loglik"),
    )


def _start(z0: float, v0: float) -> Column:
    return F.struct(*[F.lit(float(x)).alias(n) for n, x in (("z", z0), ("v", v0), ("zp", z0), ("vp", v0), ("loglik", 0.0))])


def kalman(arrays: DataFrame, a: float = A, q: float = Q, r: float = R, z0: float = Z0, v0: float = V0) -> DataFrame:
    """Last filtered mean and variance, and the log-likelihood without its constant."""
    end = F.aggregate("ys", _start(z0, v0), lambda s, y: _step(s, y, a, q, r))
    return arrays.select("series_id", end.alias("s")).select("series_id", "s.z", "s.v", "s.loglik")


def fold_path(items: Column, start: Column, step: Callable[[Column, Column], Column]) -> Column:
    """Every state of the fold but the first, in order.

    An array grows by copying, so the fold goes by chunks of about the root of the length: once
    from chunk to chunk, which gives each chunk its start, and once inside each.
    """
    n = F.size(items)
    width = F.greatest(F.lit(1), F.ceil(F.sqrt(n.cast("double"))).cast("int"))
    chunks = F.transform(F.sequence(F.lit(0), F.ceil(n / width).cast("int") - 1), lambda k: F.slice(items, k * width + 1, width))
    starts = F.aggregate(chunks, F.array(start), lambda path, chunk: F.concat(path, F.array(F.aggregate(chunk, F.element_at(path, -1), step))))

    def inside(first: Column, chunk: Column) -> Column:
        path = F.aggregate(chunk, F.array(first), lambda path, y: F.concat(path, F.array(step(F.element_at(path, -1), y))))
        return F.slice(path, 2, F.size(chunk))

    return F.flatten(F.zip_with(F.slice(starts, 1, F.size(chunks)), chunks, inside))


def _kept(arrays: DataFrame, a: float, q: float, r: float, z0: float, v0: float) -> DataFrame:
    """Every filtered state, in order; series without periods have none."""
    rows = arrays.where(F.size("ys") > 0)
    return rows.select("series_id", fold_path(F.col("ys"), _start(z0, v0), lambda s, y: _step(s, y, a, q, r)).alias("path"))


def filtered(arrays: DataFrame, a: float = A, q: float = Q, r: float = R, z0: float = Z0, v0: float = V0) -> DataFrame:
    """series_id, t, z, v of every period."""
    rows = _kept(arrays, a, q, r, z0, v0).select("series_id", F.posexplode("path").alias("t", "s"))
    return rows.select("series_id", "t", "s.z", "s.v")


def smoothed(arrays: DataFrame, a: float = A, q: float = Q, r: float = R, z0: float = Z0, v0: float = V0) -> DataFrame:
    """series_id, t, z, v given all observations: the backward fold over the filtered states."""
    names = ("z", "v", "zp", "vp")

    def back(after: Column, s: Column) -> Column:
        gain = s["v"] * F.lit(a) / after["vp"]
        z, v = s["z"] + gain * (after["z"] - after["zp"]), s["v"] + gain * gain * (after["v"] - after["vp"])
        return F.struct(*[c.alias(n) for n, c in zip(names, (z, v, s["zp"], s["vp"]), strict=True)])

    rows = _kept(arrays, a, q, r, z0, v0).select("series_id", F.reverse("path").alias("path"))
    last = F.element_at("path", 1)
    first = F.struct(*[last[n].alias(n) for n in names])
    # the first state stands for itself; a series of one period has no other
    earlier = F.slice("path", 2, F.size("path"))
    others = F.when(F.size("path") > 1, fold_path(earlier, first, back)).otherwise(F.slice(F.array(first), 1, 0))
    path = F.reverse(F.concat(F.array(first), others))
    return rows.select("series_id", F.posexplode(path).alias("t", "s")).select("series_id", "t", "s.z", "s.v")


def forecast(states: DataFrame, horizon: int, a: float = A) -> DataFrame:
    """The last state carried ``horizon`` periods on; needs z, mean and std of each series."""
    rows = states.select("*", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("h"))
    z = F.col("z") * F.pow(F.lit(a), F.col("h"))
    return rows.withColumn("z_forecast", z).withColumn("forecast", z * F.col("std") + F.col("mean"))
