"""Cross products of many series without a row for each pair of cells: blocks of series, multiplied tile by tile.

Series are dealt to blocks of about ``WIDTH``. The cells of a block over ``PERIODS`` periods are a
piece, a small dense matrix; two pieces of the same periods give a tile of counts, sums and cross
products, and tiles are added up over the periods. A cell travels once for each block of series,
not once for each series, and what comes out is the N x N result itself, a row a pair.

The leading eigenvectors of a covariance need no covariance: ``components`` multiplies the panel by
a few vectors and back, so that only numbers of the size of N x k and T x k ever meet.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written

WIDTH = 256
PERIODS = 512
_TILE = "a_block long, b_block long, n array<double>, sx array<double>, sy array<double>, sxy array<double>"


def series_blocks(panel: DataFrame, width: int = WIDTH) -> DataFrame:
    """series_id, block, place (from 0 in the block, by name) and mean: a row for every series."""
    means = panel.groupBy("series_id").agg(F.coalesce(F.avg("value"), F.lit(0.0)).alias("mean"))
    blocks = max(1, -(-panel.select("series_id").distinct().count() // width))
    dealt = means.withColumn("block", F.pmod(F.xxhash64("series_id"), F.lit(blocks)))
    return dealt.withColumn("place", F.row_number().over(Window.partitionBy("block").orderBy("series_id")) - 1)


def _tiles(pieces: DataFrame) -> DataFrame:
    """The products of every two pieces of the same periods, blocks a <= b."""
    side = lambda x: pieces.select("chunk", F.col("block").alias(f"{x}_block"), *[F.col(c).alias(f"{x}_{c}") for c in ("size", "place", "at", "value")])
    met = side("a").join(side("b"), "chunk").where("a_block <= b_block")

    def dense(row: tuple, x: str) -> tuple[np.ndarray, np.ndarray]:
        shape = (int(row[f"{x}_size"]), PERIODS)
        values, seen = np.zeros(shape), np.zeros(shape)
        values[row[f"{x}_place"], row[f"{x}_at"]] = row[f"{x}_value"]
        seen[row[f"{x}_place"], row[f"{x}_at"]] = 1.0
        return values, seen

    def multiplied(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.to_dict("records"):
                (x, p), (y, q) = dense(row, "a"), dense(row, "b")
                yield pd.DataFrame([(row["a_block"], row["b_block"], *((u @ v.T).ravel() for u, v in ((p, q), (x, q), (p, y), (x, y))))], columns=[c.split()[0] for c in _TILE.split(", ")])

    return met.mapInPandas(multiplied, _TILE)


def products(panel: DataFrame, width: int = WIDTH) -> DataFrame:
    """a, b, n, sx, sy, sxy for all series a <= b: sums over their common periods of x, y and x y, each less its series' mean.

    The panel is written first, so that what it is derived from is read once.
    """
    panel = written(panel.select("t", "series_id", "value"))
    names = written(series_blocks(panel, width))
    places = F.transform(F.array_sort(F.collect_list(F.struct("place", "series_id"))), lambda s: s["series_id"])
    blocks = written(names.groupBy("block").agg(F.count(F.lit(1)).alias("size"), places.alias("names")))
    cells = panel.where("value is not null").join(names, "series_id").select(
        "block", "place", F.expr(f"t div {PERIODS}").alias("chunk"), (F.col("t") % PERIODS).alias("at"), (F.col("value") - F.col("mean")).alias("value")
    )
    pieces = cells.groupBy("block", "chunk").agg(*[F.collect_list(c).alias(c) for c in ("place", "at", "value")]).join(blocks.select("block", "size"), "block")
    # every two blocks, should no period have both
    last = blocks.agg(F.max("block")).scalar()
    none = blocks.select(F.col("block").alias("a_block"), F.col("size").alias("a_size"), F.explode(F.sequence("block", last)).alias("b_block"))
    none = none.join(blocks.select(F.col("block").alias("b_block"), "size"), "b_block")
    zero = F.array_repeat(F.lit(0.0), (F.col("a_size") * F.col("size")).cast("int"))
    tiles = _tiles(pieces).unionByName(none.select("a_block", "b_block", *[zero.alias(c) for c in ("n", "sx", "sy", "sxy")]))
    for x in ("a", "b"):
        tiles = tiles.join(blocks.select(F.col("block").alias(f"{x}_block"), F.col("names").alias(f"{x}_names")), f"{x}_block")
    entries = F.posexplode(F.arrays_zip("n", "sx", "sy", "sxy")).alias("k", "e")
    rows = tiles.select((F.col("a_block") == F.col("b_block")).alias("same"), "a_names", "b_names", entries)
    x, y = F.get("a_names", F.expr("cast(k div size(b_names) as int)")), F.get("b_names", F.col("k") % F.size("b_names"))
    rows = rows.select("same", x.alias("x"), y.alias("y"), "e.*").where("not same or x <= y")
    turned = F.col("x") > F.col("y")
    first, second = (F.when(turned, F.col(d)).otherwise(F.col(c)) for c, d in (("sx", "sy"), ("sy", "sx")))
    return rows.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(
        F.sum("n").cast("long").alias("n"), F.sum(first).alias("sx"), F.sum(second).alias("sy"), F.sum("sxy").alias("sxy")
    )


def complete_periods(panel: DataFrame) -> DataFrame:
    """The rows of the periods at which every series is observed."""
    n = panel.select("series_id").distinct().agg(F.count(F.lit(1))).scalar()
    full = panel.groupBy("t").agg(F.count("value").alias("n")).where(F.col("n") == n).select("t")
    return panel.join(full, "t", "left_semi")


def _combined(columns: str, by: np.ndarray) -> Column:
    """The linear combinations of an array's entries, one for each column of ``by``."""
    return F.array(*[sum((F.get(columns, F.lit(i)) * float(w) for i, w in enumerate(row)), F.lit(0.0)) for row in by.T])


def _dots(left: str, right: str, r: int) -> list[Column]:
    return [F.sum(F.get(left, F.lit(i)) * F.get(right, F.lit(j))).alias(f"{left}{i}_{right}{j}") for i in range(r) for j in range(i, r)]


def components(panel: DataFrame, k: int = 1, more: int = 8, tolerance: float = 1e-7, max_iter: int = 200) -> tuple[DataFrame, np.ndarray]:
    """The ``k`` leading eigenvectors (series_id, k, value) and eigenvalues of the sample covariance over complete periods.

    Block iteration: ``k + more`` vectors are multiplied by the panel and back, made orthonormal, and
    turned to the covariance's own directions, until the residuals of the first ``k`` are below
    ``tolerance`` of the largest eigenvalue and the last step has not lowered them. Only sums of products of
    the vectors, (k + more)^2 numbers, reach the driver. Each vector's first entry that is not 0, by name, is positive.
    """
    panel = written(panel.select("t", "series_id", "value"))
    full = complete_periods(panel)
    means = full.groupBy("series_id").agg(F.avg("value").alias("mean"))
    z = written(full.join(means, "series_id").select("t", "series_id", (F.col("value") - F.col("mean")).alias("z")))
    n_periods, n_series = z.select("t").distinct().count(), panel.select("series_id").distinct().count()
    r, scale = min(k + more, n_series), 1.0 / max(n_periods - 1, 1)
    names = panel.select("series_id").distinct()
    start = F.array(*[F.xxhash64("series_id", F.lit(j)) / F.lit(2.0**63) for j in range(r)])
    vectors, best = written(names.select("series_id", start.alias("x"))), np.inf
    values, turn = np.zeros(r), np.eye(r)
    for step in range(max_iter):
        r = len(vectors.first()["x"])
        ahead = z.join(vectors, "series_id").groupBy("t").agg(*[F.sum(F.col("z") * F.get("x", F.lit(j))).alias(f"s{j}") for j in range(r)])
        back = z.join(ahead, "t").groupBy("series_id").agg(F.array(*[F.sum(F.col("z") * F.col(f"s{j}")) * scale for j in range(r)]).alias("y"))
        nothing = F.array_repeat(F.lit(0.0), r)
        both = written(vectors.join(back, "series_id", "left").withColumn("y", F.coalesce("y", nothing)))
        sums = both.agg(*(_dots("x", "y", r) if step else []), *_dots("y", "y", r)).first()
        square = lambda a, b: np.array([[sums[f"{a}{min(i, j)}_{b}{max(i, j)}"] for j in range(r)] for i in range(r)], float)
        yy = square("y", "y")
        if step:
            values, turn = np.linalg.eigh(square("x", "y"))  # X'CX, symmetric
            values, turn = values[::-1], turn[:, ::-1]
            left = max(float(turn[:, j] @ yy @ turn[:, j] - values[j] ** 2) for j in range(min(k, r)))
            worst = np.sqrt(max(left, 0.0)) / max(values[0], 1e-300)
            # as many vectors as series: their space is all there is
            if r == n_series or worst <= tolerance and worst >= 0.5 * best or values[0] <= 0:
                break
            best = worst
        sizes, axes = np.linalg.eigh(yy)
        kept = sizes > 1e-12 * sizes.max(initial=0.0)
        if not kept.any():
            break
        vectors = written(both.select("series_id", _combined("y", axes[:, kept] / np.sqrt(sizes[kept])).alias("x")))
    found = vectors.select("series_id", F.posexplode(_combined("x", turn[:, : min(k, r)])).alias("k", "value"))
    return _signed(found), values[: min(k, r)]


def _signed(vectors: DataFrame) -> DataFrame:
    lead = vectors.where(F.abs("value") > 1e-12).groupBy("k").agg(F.signum(F.min_by("value", "series_id")).alias("sign"))
    return vectors.join(lead, "k", "left").select("series_id", "k", (F.col("value") * F.coalesce("sign", F.lit(1.0))).alias("value"))
